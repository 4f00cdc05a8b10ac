"""Byte-level BPE against the tokenizer library, text by text."""

from __future__ import annotations

import base64
import hashlib
import random
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundling.llm import bpe
from groundling.llm import textkernel as tk


@lru_cache
def library(name: str = "byte_bpe_50k"):
    import tiktoken

    with open(P.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts: list[str | None], name: str = "byte_bpe_50k") -> list[list[int]]:
    import pyarrow as pa

    raw, off = tk.utf8(pa.array(texts, pa.string()))
    ids, at = bpe.codec(name).encode(raw, off)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


SF = "/root/testdata/sf0.001"
ODD = ["", "'s", "'S", "''s", " 's", "\n's", "  's it", "don't we'll they've I'm you're he'd'd", "'re'", "'r", "'l", "'tis", "a  b", "a \n b", "\n\n", " ", "a ", "  a", "\t\ta", "a b", "a  b   c", "x\u0085y", "\x1c\x1d", "12 34ab5", "é'é", "日本語 テスト", "🙂🙂 🙂", "<|endoftext|>", "½²Ⅷ", "a" * 700, "ab" * 600 + " " + "!" * 300, " " * 999 + "x", "́́ á"]


def test_odd_texts():
    want = library()
    assert ids_of(ODD) == [want.encode_ordinary(t) for t in ODD]
    many = "byte_bpe_multi_50k"
    assert ids_of(ODD, many) == [library(many).encode_ordinary(t) for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("'strevmldSTab 12\n\t .,!é  ")), st.characters(exclude_categories=("Cs",))), max_size=40), max_size=6))
def test_any_texts(texts):
    want = library()
    assert ids_of(texts) == [want.encode_ordinary(t) for t in texts]
    code = bpe.codec("byte_bpe_50k")
    for text, ids in zip(texts, ids_of(texts), strict=True):
        assert code.decode(np.array(ids, np.int64)).tobytes() == text.encode()


def test_every_token_and_every_character():
    code, want = bpe.codec("byte_bpe_50k"), library()
    tokens = [t.decode() for t in code.ranks if t.isascii()]
    assert ids_of(tokens) == [want.encode_ordinary(t) for t in tokens]
    characters = ["a" + chr(c) + "1 " + chr(c) for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert ids_of(characters) == [want.encode_ordinary(t) for t in characters]


@pytest.mark.parametrize("alphabet", ["ab", "etaoinshrdlu", "".join(map(chr, range(33, 127))), "的一是不了人我在有他"])
def test_long_runs_without_a_border(alphabet):
    rng = random.Random(len(alphabet))
    text = "".join(rng.choices(alphabet, k=5_000))
    assert ids_of([text]) == [library().encode_ordinary(text)]
    code = bpe.codec("byte_bpe_50k")
    for piece in (text[:300], "the" * 200, " " * 500):
        raw = np.frombuffer(piece.encode(), np.uint8)
        by_rank = code.merge_long(code.byte_id[raw])
        rows, _ = code._matrix(raw, np.array([0]), np.array([len(raw)]), np.array([0]), len(raw))
        assert by_rank.tolist() == rows.tolist()


def test_very_long_text_is_cut_at_borders(monkeypatch, spark):
    monkeypatch.setattr(bpe, "PART_BYTES", 50)
    text = "It's a  long text, isn't it?\n\n  Yes 123" * 40 + "x" * 300
    raw = np.frombuffer(text.encode(), np.uint8)
    code = bpe.codec("byte_bpe_50k")
    cut = list(bpe.parts(raw, 50))
    assert len(cut) > 20 and cut[0][0] == 0 and cut[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
    ids = np.concatenate([code.encode(raw[a:b], np.array([0, b - a]))[0] for a, b in cut])
    assert ids.tolist() == library().encode_ordinary(text)


def test_rows_and_edges(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "y"), (2, None, "z"), (3, "", "z"), (None, "don't", "z"), (4, "a b " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.bpe_digests(docs).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        ids = library().encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.bpe_digests(docs.limit(0)).count() == 0
    encoded = bpe.bpe_ids(docs)
    back = {(r.doc_id, bytes(r.text).decode()) for r in bpe.bpe_decode(encoded).collect()}
    assert back == {(d, t or "") for d, t, _ in rows}


def test_query_against_the_library(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op11_bpe(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = library().encode_ordinary(row.text or "")
        assert got[row.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest())
