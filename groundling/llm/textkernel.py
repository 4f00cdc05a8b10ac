"""Vectorised text primitives on the UTF-8 buffers of Arrow string columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D, which is the same as
runs of characters other than those six, as UTF-8 never uses these bytes
inside a longer character. No Python string is made: word borders, hashes and
shingles are numpy arrays over a whole slice of documents. A slice holds about
``SLICE_BYTES`` of text (a longer document is a slice of its own), so memory
follows the slice and not the batch or the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20
_HASH_SPAN = 1 << 18
_MASK = (1 << 64) - 1

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _IPOW = _powers(_BASE, _HASH_SPAN), _powers(_INVERSE, _HASH_SPAN)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        ends = np.cumsum(size)
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def per_document(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set flags between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[off])


class Words:
    """Word borders of a slice: ``start``, ``end`` (bytes), ``first`` (index of each document's first word; one more than documents)."""

    __slots__ = ("raw", "off", "start", "end", "first")

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.raw, self.off = raw, off
        inside = ~SEPARATOR[raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = off[:-1][off[1:] > off[:-1]]
        begins[full] = inside[full]
        last = off[1:][off[1:] > off[:-1]] - 1
        ends[last] = inside[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.count)


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit content hash of each span of bytes; spans are in order and disjoint."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        to = int(np.searchsorted(end, base + _HASH_SPAN, "right"))
        if to <= at:  # a span longer than the table: by pieces
            value, scale = 0, 1
            for lo in range(int(base), int(end[at]), _HASH_SPAN):
                piece = raw[lo : min(lo + _HASH_SPAN, int(end[at]))]
                value = (value + scale * int((_BYTE[piece] * _POW[: len(piece)]).sum(dtype=np.uint64))) & _MASK
                scale = scale * pow(_BASE, _HASH_SPAN, 1 << 64) & _MASK
            out[at] = value
            at += 1
            continue
        piece = raw[base : end[to - 1]]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * _POW[: len(piece)], out=total[1:])
        lo = start[at:to] - base
        out[at:to] = (total[end[at:to] - base] - total[lo]) * _IPOW[np.minimum(lo, _HASH_SPAN - 1)]
        at = to
    return mix(out ^ ((end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive hash of aligned columns of hashes."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = (out ^ part) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words and the row each belongs to.

    A document with fewer words, but at least one, has one shingle of all its
    words when ``short``, and none otherwise.
    """
    count = np.diff(first)
    rows = np.repeat(np.arange(len(count)), np.maximum(count - width + 1, 0))
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        place = np.arange(len(hashes)) - np.repeat(first[:-1], count)
        keep = (place + width <= np.repeat(count, count))[:n]
        full = combine([hashes[k : n + k] for k in range(width)])[keep]
    else:
        full = np.zeros(0, np.uint64)
    if not short:
        return full, rows
    extra, extra_rows = [full], [rows]
    for k in range(1, width):
        at = np.flatnonzero(count == k)
        if len(at):
            extra.append(combine([hashes[first[at] + j] for j in range(k)]))
            extra_rows.append(at)
    if len(extra) == 1:
        return full, rows
    rows, full = np.concatenate(extra_rows), np.concatenate(extra)
    order = np.argsort(rows, kind="stable")
    return full[order], rows[order]


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs in row order with their counts; ``rows`` ascend."""
    if not len(rows):
        return rows, hashes, np.zeros(0, np.int64)
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return r[at], h[at], np.diff(np.append(at, len(r)))


def annotate(docs: DataFrame, added: list[tuple[str, T.DataType]], compute: Callable[[pa.Array], list[pa.Array]], text_col: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with further columns that ``compute`` makes of its texts.

    Rows and columns pass through as they are, so a filter on the new columns
    needs no join back to the texts. Columns travel by place: a column of
    ``docs`` may have any name, also one of those added.
    """
    names = docs.columns
    places = [f"c{k}" for k in range(len(names))]
    text_at = places[names.index(text_col)]
    fields = [T.StructField(p, f.dataType, True) for p, f in zip(places, docs.schema.fields, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_at, limit):
            yield pa.RecordBatch.from_arrays([*part.columns, *compute(part.column(text_at))], [*places, *(name for name, _ in added)])

    out = docs.toDF(*places).mapInArrow(run, T.StructType([*fields, *(T.StructField(n, t, True) for n, t in added)]))
    return out


def restore(annotated: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` of what :func:`annotate` returned."""
    return annotated.select(*(f"c{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)
