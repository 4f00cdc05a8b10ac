"""Spelling variants against plain loops."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from groundling.llm import spelling as sp

SF = "/root/testdata/sf0.001"


def brute_counts(rows: list[tuple], shortest: int = 5, least: int = 3) -> dict[str, int]:
    found: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= least}


def brute_near(counts: dict[str, int]) -> dict[str, set[str]]:
    """Words that share a pattern with one character open, or one of which lacks a character."""
    by_pattern, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            by_pattern[w[:k], w[k + 1 :]].add(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in by_pattern.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(counts: dict[str, int]) -> set[tuple]:
    near, form = brute_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def groups(spark, counts: dict[str, int]) -> set[tuple]:
    return {tuple(r) for r in sp.spelling_groups(spark.createDataFrame(sorted(counts.items()), "word string, n long")).collect()}


def test_chains_ties_and_repeated_bigrams(spark):
    chain = {f"chain{'x' * k}": 3 * 2**k for k in range(12)}  # each word's form is the next
    ties = {"zebra": 10, "zebrb": 20, "zebrc": 20, "zebraa": 20, "zebr": 5, "ananas": 4, "anananas": 9, "anannas": 8, "annanas": 8, "aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 11, "étésé": 3, "étése": 6, "ÿtése": 6}
    counts = chain | ties
    got = groups(spark, counts)
    assert got == brute(counts)
    assert {r[2] for r in got if r[0] in chain} == {"chain" + "x" * 11}


def test_random_words_lose_no_pair(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("abc", k=rng.randrange(5, 8))) for _ in range(900)}
    for w in ["international", "telephone", "straightforward"]:
        for _ in range(60):
            k = rng.randrange(len(w))
            words.add(w[:k] + rng.choice(["", "q", w[k] * 2]) + w[k + 1 :])
    counts = {w: rng.choice([3, 3, 4, 9, 20, 50]) for w in words}
    assert groups(spark, counts) == brute(counts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=5, max_size=9), min_size=2, max_size=30, unique=True))
def test_three_rarest_bigrams_meet(words):
    """The filter itself, in Python: near words share a key."""
    often = Counter(w[k : k + 2] for w in words for k in range(len(w) - 1))
    keys = {}
    for w in words:
        rarest = sorted((often[w[k : k + 2]], w[k : k + 2], k) for k in range(len(w) - 1))[:3]
        keys[w] = {("<", w[: k + 2]) for _, _, k in rarest} | {(">", w[k:]) for _, _, k in rarest}
    for w, others in brute_near(dict.fromkeys(words, 3)).items():
        for other in others:
            assert keys[w] & keys[other]


def test_rows_and_edges(spark):
    rows = [(k, "Hellos WORLDS Écoles hel×os caféss; don't worlds2worlds") for k in range(3000)]
    rows += [(None, "hellos hellos hellos"), (1, None), (2, ""), (3, "ab " * 50_000 + "w" * 30_000), (3, "ab")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, word string")
    want = brute(brute_counts(rows))
    assert any(r[1] for r in want) and any("É" in r[0] for r in want)
    assert {tuple(r) for r in sp.spelling_variants(docs).collect()} == want
    assert sp.spelling_variants(docs.limit(0)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(brute_counts(rows))
    assert len(want) > 500 and {tuple(r) for r in sp.op13_spelling(spark, SF).collect()} == want
