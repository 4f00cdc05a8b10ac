import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundling.llm import packing as pk
from groundling.llm import token_counts as tc
from groundling.llm.tokens import encoder

ODD = ["", " ", "don't  stop\n\n\tnow ", "漢字 カナ é́ \U0001f680\U0001f468‍\U0001f469", "x" * 5000, "<|endoftext|> inside", "a\x00b\x85c d", "1234567 ½ ٣٤", "ａｂ", "'s'S'll"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_tokenizer_file(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_ids_are_those_of_the_tokenizer_file, "t") else test_ids_are_those_of_the_tokenizer_file.t
    t.encode_special_tokens = True
    test_ids_are_those_of_the_tokenizer_file.t = t
    assert encoder().ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts(reference):
    for text in ODD:
        assert encoder().ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def spans_by_force(reference, text):
    """Character spans of the tokens: a part of a character spans it whole."""
    enc, borders = encoder(), [0]
    raw = text.encode()
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    spans = []
    for token in reference.encode(text, add_special_tokens=False).ids:
        lo, hi = borders[-1], borders[-1] + int(enc.lengths[token])
        spans.append((lo, hi, char_of[lo], char_of[hi - 1] + 1))
        borders.append(hi)
    assert borders[-1] == len(raw)
    return spans


def test_attribution_matches_brute_force(spark, reference):
    rng = random.Random(5)
    rows = []
    for i, text in enumerate([*ODD, "The quick brown fox jumps over the lazy dog. " * 20, None]):
        n = len(text or "")
        cuts = [(f"s{k}", *sorted((rng.randrange(n + 1), rng.randrange(n + 1)))) for k in range(6)]
        rows.append((i, text, [dict(zip(("name", "start", "end"), c)) for c in cuts] + [{"name": "far", "start": n + 5, "end": n + 9}], 7))
    docs = spark.createDataFrame(rows, f"doc_id long, text string, sections {tc.SECTIONS}, n_first int")
    for r in tc.token_counts(docs, F.col("sections")).collect():
        text = rows[r["doc_id"]][1] or ""
        section = rows[r["doc_id"]][2][r["section"]]
        lo, hi = (min(section[k], len(text)) for k in ("start", "end"))
        spans = spans_by_force(reference, text)
        at = [len(text[:k].encode()) for k in range(len(text) + 1)]
        inside = lambda x: lo <= x < hi
        assert r["n_first"] == sum(inside(f) for _, _, f, _ in spans)
        assert r["n_middle"] == sum(inside((f + l - 1) // 2) for _, _, f, l in spans)
        assert r["n_split"] == pytest.approx(sum(max(0, min(b, at[hi]) - max(a, at[lo])) / (b - a) for a, b, _, _ in spans))
        assert r["n_crossing"] == (sum(f < hi and l > lo and not (f >= lo and l <= hi) for _, _, f, l in spans) if hi > lo else 0)
        assert r["doc_tokens"] == len(spans)


def test_lines_share_out_all_tokens(spark):
    docs = spark.createDataFrame(list(enumerate([*ODD, "a\nb\n\nc", "\n"])) + [(None, None)], "doc_id long, text string")
    rows = tc.token_counts(docs).groupBy("doc_id").agg(F.sum("n_first").alias("a"), F.sum("n_middle").alias("b"), F.sum("n_split").alias("c"), F.max("doc_tokens").alias("t"), F.count("*").alias("n")).collect()
    assert len(rows) == len(ODD) + 3 and all(r["a"] == r["b"] == r["t"] and r["c"] == pytest.approx(r["t"]) for r in rows)
    assert {r["doc_id"]: r["n"] for r in rows}[len(ODD)] == 4
    assert tc.token_counts(docs.limit(0)).count() == 0


def test_fields(spark):
    docs = spark.createDataFrame([(1, "Title here", None, "body é")], "doc_id long, title string, deck string, body string")
    text, sections = tc.field_sections(["title", "deck", "body"])
    rows = {r["name"]: r for r in tc.token_counts(docs.select("doc_id", text.alias("text"), sections.alias("s")), F.col("s")).collect()}
    assert [rows[k]["n_first"] for k in ("title", "deck", "body")] == [2, 0, len(encoder().ids("body é"))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_uses_every_piece_and_no_room_twice(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, int)
    used = np.zeros(41, int)
    for run, many in pk.plan(counts, 40):
        assert sum(run) <= 40 and many > 0
        for n in run:
            used[n] += many
    assert (used == counts).all()


def test_sum_index_counts_pairs():
    rng = np.random.default_rng(3)
    index = pk.SumIndex(rng.integers(0, 3, 30) * (np.arange(30) > 0))
    for _ in range(40):
        some = np.flatnonzero(index.left > 0)
        if not len(some):
            break
        index.take(int(rng.choice(some)), 1)
        for total in range(30):
            pairs = sum(index.left[a] > 0 and index.left[total - a] > (1 if 2 * a == total else 0) for a in range(1, total // 2 + 1))
            assert index.pairs[total] == pairs


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(1024, rng.lognormal(5.5, 1, 20_000).astype(int) + 1), minlength=1025)
    total = (counts * np.arange(1025)).sum()
    assert sum(many for _, many in pk.plan(counts, 1024)) <= -(-total // 1024) + 3


def test_packing_round_trip(spark, reference):
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.randrange(999)}" for _ in range(rng.choice([0, 3, 50, 400, 1500]))) for _ in range(60)] + [None, "", texts_twin := "twin text"] + [texts_twin]
    docs = spark.createDataFrame([(i if i < 62 else 62, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    rows = pk.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts[:62]):
        ids = reference.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 1024 for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and (len(ids) > 1024 or len(own) == 1)
    assert len(by_doc[62]) == 2
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert pk.pack(docs.limit(0)).count() == 0
