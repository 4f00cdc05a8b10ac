"""Per-document statistics that the quality operators share; one pass over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundling.llm import textkernel as tk

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_bang", "n_punct", "n_nonascii", "n_distinct"]

_SYMBOL, _UPPER, _LETTER, _DIGIT, _PUNCT = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_PUNCT[list(b".,;:?")] = True


def _same_before(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How often each (row, hash) occurs, in the order given."""
    key = tk.mix(hashes + tk.mix(rows.astype(np.uint64) + np.uint64(1)))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inverse]


def slice_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text of a column."""
    raw, off = tk.utf8(column)
    n = len(off) - 1
    words = tk.Words(raw, off)
    hashes = tk.hash_spans(raw, words.start, words.end)
    document = words.document()
    out = {"n_words": words.count.astype(np.int64)}
    inside = ~tk.SEPARATOR[raw]
    out["word_chars"] = tk.per_document(inside & ((raw & 0xC0) != 0x80), off)
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_digits", _DIGIT), ("n_punct", _PUNCT)):
        out[name] = tk.per_document(table[raw], off)
    out["n_bang"] = tk.per_document(raw == ord("!"), off)
    out["n_nonascii"] = tk.per_document(raw >= 0xC0, off)
    # lines that hold a word: those in which some word starts
    feeds = np.flatnonzero(raw == 0x0A)
    borders = np.unique(np.concatenate([off, feeds, feeds + 1]))
    lo, hi = borders[:-1], borders[1:]
    real = np.searchsorted(words.start, hi) > np.searchsorted(words.start, lo)
    lo, hi = lo[real], hi[real]
    rows = np.searchsorted(off, lo, "right") - 1
    lines = tk.hash_spans(raw, lo, hi)
    _, line_at = np.unique(tk.mix(lines + tk.mix(rows.astype(np.uint64) + np.uint64(1))), return_index=True)
    out["n_lines"] = np.bincount(rows, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(rows[line_at], minlength=n)
    # words inside a five-word window that the text holds twice or more
    windows, window_rows = tk.shingles(hashes, words.first, 5, short=False)
    covered = np.zeros(len(hashes) + 1, np.int32)
    if len(windows):
        counts = words.count
        place = np.arange(len(hashes)) - np.repeat(words.first[:-1], counts)
        at = np.flatnonzero(place + 5 <= np.repeat(counts, counts))
        at = at[_same_before(window_rows, windows) >= 2]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 5, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.bincount(document[repeated], minlength=n)
    _, word_at = np.unique(tk.mix(hashes + tk.mix(document.astype(np.uint64) + np.uint64(1))), return_index=True)
    out["n_distinct"] = np.bincount(document[word_at], minlength=n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_class`` (MD5 of the text) and COUNTS (long) of every whole text; a null text counts as empty, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text"):
            stats = slice_stats(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("text_class"), *(pa.array(stats[k]) for k in COUNTS)], ["doc_id", "text_class", *COUNTS])

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(text, F.lit(""))).alias("text_class"), text.alias("text"))
    return source.mapInArrow(run, "doc_id long, text_class string, " + ", ".join(f"{k} long" for k in COUNTS))


def one_label(labels: DataFrame, column: str, keep: str = "min", id_col: str = "doc_id") -> DataFrame:
    """One row per labelled document (``doc_id``, ``label`` 0 or 1); nulls are no label, of several the ``keep`` one holds."""
    value = F.col(column).cast("int")
    return labels.where(value.isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(getattr(F, keep)(value).alias("label"))


def fold(modulus: int) -> "F.Column":
    """crc32 of the document id as text, by ``modulus``; the folds that the queries hold out."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus
