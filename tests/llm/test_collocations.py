"""Phrase counts and scores against plain loops, and the query against its SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb

from groundling.llm import collocations as co

SF = "/root/testdata/sf0.001"


def counted(rows: list[tuple], most: int = 3) -> tuple[Counter, Counter]:
    f, n = Counter(), Counter()
    for text, lang in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    return f, n


def brute(rows: list[tuple], most: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> set[tuple]:
    f, n = counted(rows, most)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    scored: dict[str, list] = {}
    for (lang, p), a in candidates.items():
        inside = [b for (other, q), b in candidates.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= share * a for b in inside):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        scored.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, rows in scored.items() for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}


def made_rows(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "on", "é", "mat", "x" * 30, "na", "na"]
    glue = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", ";"]
    return [("".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None])) for _ in range(n)]


def test_against_loops(spark):
    rows = [*made_rows(1), (None, "en"), ("", "fr"), ("na " * 500, "en"), ("a b c " * 30, "xx"), ("a b c " * 30, "xx"), ("!!! ,,, \n\t", None)]
    docs = spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, phrase string, rank int").repartition(3)
    want = brute(rows)
    assert len(want) > 20 and any(len(r[2].split()) == 3 for r in want)
    assert {tuple(r) for r in co.collocations(docs).collect()} == want
    # many small blocks that meet over several levels say the same, and so does a limit on the phrases of a language
    small = co.collocations(docs, top=7, block_bytes=300, keys_per_range=200, fan_out=3)
    assert {tuple(r) for r in small.collect()} == brute(rows, top=7)
    assert co.collocations(docs.limit(0)).count() == 0


def test_longer_phrases_and_thresholds(spark):
    rows = made_rows(2, 40)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert {tuple(r) for r in co.collocations(docs, most=4, least=5, share=30).collect()} == brute(rows, most=4, least=5, share=30)


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_019
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, big + 1)], "lang string, phrase string, words int, a long")
    (row,) = co.score_phrases(counts).collect()
    assert row.score == 1_000_000 * big * big // ((big + 7) * (big + 1)) == 999_999 and (row.l, row.r) == (big + 7, big + 1)


def test_query_matches_sql(spark):
    con = duckdb.connect(config={"temp_directory": ""})
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {tuple(r) for r in con.execute(f"select lang, rank, phrase, a, l, r, n, score from ({co.ORACLE_SQL['op12_collocations']})").fetchall()}
    assert want and {tuple(r) for r in co.op12_collocations(spark, SF).collect()} == want
