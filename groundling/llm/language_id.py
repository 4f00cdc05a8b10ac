"""Language ID as inference of a mixture of languages.

Byte trigrams of lower-cased words, hashed into cells, give each learned
language a table of log-probabilities; the tables count every training text in
full. They have ``BUCKETS`` cells a language for up to 64 languages and, so
that all tables together stay at ``CELLS``, fewer with more languages, down to
``LEAST_BUCKETS``: every language is learned, none is left out. A document is a
mixture: expectation-maximisation over its words estimates the share of each
language. Sets of the leading 1, 2, ... languages are then compared by
likelihood less ``penalty * log(words)`` for each further language; in the best
set the shares are estimated again, and its leading language is the prediction.

Memory follows words x languages of a slice, and slices get smaller with more
languages. A text longer than a slice is read in pieces, and what it repeats
(a word after a letter) is kept once with its count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundling.llm import textkernel as tk
from groundling.llm.docstats import fold

BUCKETS = 1 << 16
CELLS = 1 << 22
LEAST_BUCKETS = 1 << 10
UNDETERMINED = "und"
_SLICE = 2 << 20


@dataclass
class Profiles:
    languages: list[str]
    table: np.ndarray
    """Log-probability of each cell by language, float32."""

    @property
    def slice_bytes(self) -> int:
        """Bytes of text that are judged at once."""
        return max(1 << 16, _SLICE * 8 // max(8, len(self.languages)))


def buckets(languages: int) -> int:
    """Cells of a language's table: a power of two."""
    return max(LEAST_BUCKETS, min(BUCKETS, 1 << (CELLS // max(languages, 1)).bit_length() - 1))


def _grams(column: pa.Array, cells: int) -> tuple[tk.Words, np.ndarray]:
    """Words of the lower-cased texts and the cell of the trigram that ends at each byte."""
    return _cells(*tk.utf8(pc.utf8_lower(pc.fill_null(column, ""))), cells)


def _cells(raw: np.ndarray, off: np.ndarray, cells: int) -> tuple[tk.Words, np.ndarray]:
    words = tk.Words(raw, off)
    code = np.where(tk.SEPARATOR[raw], np.uint8(32), raw).astype(np.uint32)
    key = code.copy()
    key[1:] |= code[:-1] << np.uint32(8)
    key[2:] |= code[:-2] << np.uint32(16)
    # what stands before a text is a space
    for back in (1, 2):
        at = off[:-1][off[1:] > off[:-1]]
        at = np.unique(at[:, None] + np.arange(back))
        at = at[at < len(key)]
        shift = np.uint32(8 * back)
        key[at] = (key[at] & ~(np.uint32(255) << shift)) | (np.uint32(32) << shift)
    return words, ((key * np.uint32(2654435761)) >> np.uint32(16)) & np.uint32(cells - 1)


def fit_profiles(train: DataFrame) -> Profiles:
    """Profiles of every language, from all rows (``text, lang``); without any, no language is known."""
    rows = train.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # the names of the languages
    if not names:
        return Profiles([], np.zeros((0, BUCKETS), np.float32))
    n_cells = buckets(len(names))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in tk.slices(batches, "text", _SLICE):
            words, cells = _grams(part.column("text"), n_cells)
            inside = ~tk.SEPARATOR[words.raw]
            codes = part.column("lang").dictionary_encode()
            names = codes.dictionary.to_pylist()
            owner = np.repeat(codes.indices.to_numpy(zero_copy_only=False), np.diff(words.off))
            for k, name in enumerate(names):
                totals[name] = totals.get(name, 0) + np.bincount(cells[inside & (owner == k)], minlength=n_cells)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["lang", "cell", "n"])

    got = rows.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(names), n_cells), 0.5, np.float32)
    which = {name: k for k, name in enumerate(names)}
    lang = got.column("lang").combine_chunks().dictionary_encode()
    if isinstance(lang, pa.ChunkedArray):
        lang = lang.combine_chunks()
    place = np.array([which[x] for x in lang.dictionary.to_pylist()], int)
    if got.num_rows:
        table[place[lang.indices.to_numpy()], got.column("cell").to_numpy()] += got.column("n").to_numpy()
    return Profiles(names, np.log(table / table.sum(1, keepdims=True, dtype=float)).astype(np.float32))


def word_likelihoods(profiles: Profiles, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word by language (words x languages), and each document's first word."""
    words, cells = _grams(column, profiles.table.shape[1])
    return _likelihoods(profiles, words, cells), words.first


def _likelihoods(profiles: Profiles, words: tk.Words, cells: np.ndarray) -> np.ndarray:
    out = np.empty((len(words.start), len(profiles.languages)))
    for k, table in enumerate(profiles.table):
        total = np.zeros(len(cells) + 1)
        np.cumsum(table[cells], out=total[1:])
        out[:, k] = total[words.end] - total[words.start]
    return out


def long_likelihoods(profiles: Profiles, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of a single text's distinct words, each by the letter that it follows, and how often they stand there."""
    raw, _ = tk.utf8(pc.utf8_lower(pc.fill_null(text, "")))
    borders = np.flatnonzero(tk.SEPARATOR[raw])
    keys, rows, counts = np.zeros(0, np.uint64), np.zeros((0, len(profiles.languages))), np.zeros(0)
    at = 0
    while at < len(raw):
        k = int(np.searchsorted(borders, at + profiles.slice_bytes))
        to = int(borders[k]) if k < len(borders) else len(raw)
        lo = max(at - 1, 0)  # the byte before the space that the piece begins with
        piece = raw[lo:to]
        words, cells = _cells(piece, np.array([0, len(piece)]), profiles.table.shape[1])
        own = words.start + lo >= at
        code = np.where(tk.SEPARATOR[piece], np.uint8(32), piece).astype(np.uint64)
        before = np.where(words.start >= 2, code[np.maximum(words.start - 2, 0)], np.uint64(32)) + np.uint64(256) * np.where(words.start >= 1, code[np.maximum(words.start - 1, 0)], np.uint64(32))
        key = tk.combine([tk.hash_spans(piece, words.start, words.end), before])[own]
        each = _likelihoods(profiles, words, cells)[own]
        keys, first, inverse = np.unique(np.concatenate([keys, key]), return_index=True, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, np.ones(len(key))]), minlength=len(keys))
        rows = np.concatenate([rows, each])[first]
        at = max(to, at + 1)
    return rows, counts


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over each document's words; zero without words."""
    out = np.zeros((len(first) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


def mixtures(loglik: np.ndarray, first: np.ndarray, penalty: float = 2.0, rounds: int = 12, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the languages by EM, which languages the penalised likelihood selects, and the shares within that selection.

    ``weight`` says how often each row of ``loglik`` stands in its document.
    """
    n, k = len(first) - 1, loglik.shape[1]
    weight = np.ones(len(loglik)) if weight is None else weight
    rows = np.repeat(np.arange(n), np.diff(first))
    count = np.bincount(rows, weight, minlength=n)
    top = loglik.max(axis=1)
    like = np.exp(loglik - top[:, None])

    def em(share: np.ndarray, rows: np.ndarray, like: np.ndarray, times: np.ndarray, at: np.ndarray, turns: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares after ``turns`` and the log-likelihood (less ``top``) under them."""
        n_words = np.maximum(_sums(times, at), 1)[:, None]
        for _ in range(turns):
            joint = like * share[rows]
            joint *= (times / joint.sum(axis=1))[:, None]
            share = _sums(joint, at) / n_words
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        return share, _sums(times * np.log(np.maximum((like * share[rows]).sum(axis=1), 1e-300)), at)

    share, full = em(np.full((n, k), 1.0 / k), rows, like, weight, first, rounds)
    share[count == 0] = 0
    order = np.argsort(-share, axis=1, kind="stable")
    fee = penalty * np.log(np.maximum(count, 2))
    best = np.take_along_axis(_sums(weight[:, None] * (loglik - top[:, None]), first), order[:, :1], axis=1)[:, 0]
    size = np.ones(n, int)
    final = np.zeros((n, k))
    np.put_along_axis(final, order[:, :1], 1.0, axis=1)
    for s in range(2, k + 1):
        # no larger set can beat the full mixture's likelihood
        open_rows = np.flatnonzero((full - fee * (s - 1) > best) & (count > 0))
        if not len(open_rows):
            break
        mask = np.zeros((len(open_rows), k))
        np.put_along_axis(mask, order[open_rows, :s], 1.0, axis=1)
        words = np.concatenate([np.arange(first[r], first[r + 1]) for r in open_rows])
        lengths = np.diff(first)[open_rows]
        at = np.concatenate([[0], np.cumsum(lengths)])
        some = np.maximum(share[open_rows], 1e-6) * mask
        some /= some.sum(axis=1, keepdims=True)
        some, value = em(some, np.repeat(np.arange(len(open_rows)), lengths), like[words], weight[words], at, 6)
        value = value - fee[open_rows] * (s - 1)
        better = value > best[open_rows]
        chosen = open_rows[better]
        best[chosen], size[chosen], final[chosen] = value[better], s, some[better]
    selected = np.zeros((n, k), bool)
    np.put_along_axis(selected, order, np.arange(k)[None, :] < size[:, None], axis=1)
    final[count == 0] = 0
    return share, selected, final


def language_id(docs: DataFrame, profiles: Profiles, penalty: float = 2.0) -> DataFrame:
    """Language of every whole text.

    One row per input row: doc_id, lang_pred (``und`` without a letter, for
    nulls, or when no language was learned), score (share of that language in
    the selected mixture, 0 to 1; 0 for ``und``), languages (the selected set,
    joined by commas in falling order of share; empty for ``und``). Of
    languages with equal shares the first by name leads. Repeated rows are
    judged alike; other columns, also ``lang``, are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(profiles)  # CELLS floats, or LEAST_BUCKETS a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text", shipped.value.slice_bytes):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *judge(shipped.value, part.column("text"), penalty)], ["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")


def judge(known: Profiles, text: pa.Array, penalty: float) -> list[pa.Array]:
    """Predicted language, its share and the selected languages of each text."""
    n = len(text)
    judged = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    names, scores, sets = np.full(n, UNDETERMINED, object), np.zeros(n), np.full(n, "", object)
    if known.languages:
        weight = None
        if n == 1 and (pc.binary_length(text)[0].as_py() or 0) > known.slice_bytes:
            loglik, weight = long_likelihoods(known, text)
            first = np.array([0, len(loglik)])
        else:
            loglik, first = word_likelihoods(known, text)
        _, chosen, share = mixtures(loglik, first, penalty, weight=weight)
        order = np.argsort(-share, axis=1, kind="stable")
        for row in np.flatnonzero(judged):
            names[row] = known.languages[order[row, 0]]
            scores[row] = min(1.0, share[row, order[row, 0]])
            sets[row] = ",".join(known.languages[k] for k in order[row] if chosen[row, k])
    return [pa.array(names, pa.string()), pa.array(scores), pa.array(sets, pa.string())]


def keep_known_language(docs: DataFrame, profiles: Profiles, least_share: float = 0.3, penalty: float = 2.0) -> DataFrame:
    """Rows of ``docs`` whose text has a language of at least ``least_share``; columns and repeated rows stay."""
    shipped = docs.sparkSession.sparkContext.broadcast(profiles)
    added = [("lang_pred", T.StringType()), ("share", T.DoubleType()), ("languages", T.StringType())]
    judged = tk.annotate(docs, added, lambda text: judge(shipped.value, text, penalty), limit=profiles.slice_bytes)
    return tk.restore(judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("share") >= least_share)), docs)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that the query may learn from."""
    return docs.where(F.coalesce(fold(5) != 0, F.lit(True)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_id(docs, fit_profiles(training_rows(docs)))
    held: Column = F.coalesce(fold(5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")


QUERIES = {"op6_language_id": op6_language_id}
ORACLE_SQL: dict[str, str] = {}
