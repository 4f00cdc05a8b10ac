"""Best-fit packing by exact complements.

Only lengths matter to a packing, and there are at most ``capacity`` of them:
the plan is made on the histogram of lengths, whose size does not grow with
the corpus. An index holds which lengths are left, and for each sum how many
pairs of lengths make it. A sequence opens with the longest length left; its
gap is closed exactly by a single length, a pair, or a triple (a length whose
rest is an indexed pair), as often as the counts allow. Where no combination
fits exactly, the longest length that fits is added (best fit) and the search
goes on with the smaller gap. Each run of equal sequences is one row of the
plan, and a piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundling.llm import textkernel as tk
from groundling.llm.tokens import VOCABULARY, encoder
from groundling.session import materialise

CAPACITY = 1024
END = 2


class SumIndex:
    """Which lengths are left, and how many pairs of lengths make each sum."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        size = len(counts)
        have = (self.left > 0).astype(np.int64)
        both = np.convolve(have, have)[:size]  # ordered pairs; a length with itself is in once
        twice = np.zeros(size, np.int64)
        some = np.flatnonzero(self.left > 0)
        np.add.at(twice, 2 * some[2 * some < size], 1)
        double = np.zeros(size, np.int64)
        some = np.flatnonzero(self.left > 1)
        np.add.at(double, 2 * some[2 * some < size], 1)
        self.pairs = (both - twice) // 2 + double

    def take(self, length: int, n: int) -> None:
        before = self.left[length]
        self.left[length] = after = before - n
        size = len(self.left)
        if before >= 2 > after and 2 * length < size:
            self.pairs[2 * length] -= 1
        if before > 0 >= after:
            others = np.flatnonzero(self.left[: size - length] > 0)
            self.pairs[others + length] -= 1

    def pair(self, total: int) -> tuple[int, int] | None:
        """The pair of that sum with the longest first length."""
        if total < 2 or not self.pairs[total]:
            return None
        a = np.arange(total - 1, (total - 1) // 2, -1)
        ok = np.flatnonzero((self.left[a] > 0) & (self.left[total - a] > np.where(2 * a == total, 1, 0)))
        return (int(a[ok[0]]), int(total - a[ok[0]])) if len(ok) else None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        if self.left[gap] > 0:
            return (gap,)
        if found := self.pair(gap):
            return found
        thirds = np.arange(gap - 2, 0, -1)
        for third in thirds[(self.left[thirds] > 0) & (self.pairs[gap - thirds] > 0)]:
            if (rest := self.pair(gap - int(third))) and all(self.left[x] >= (third, *rest).count(x) for x in rest):
                return (int(third), *rest)
        return None

    def longest(self, limit: int) -> int:
        found = np.flatnonzero(self.left[1 : limit + 1] > 0)
        return int(found[-1]) + 1 if len(found) else 0


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), all pieces used; ``counts[n]`` pieces have length n."""
    index, runs = SumIndex(np.asarray(counts)), []
    while longest := index.longest(capacity):
        room = capacity // longest
        many = -(-int(index.left[longest]) // room)
        index.take(longest, many)
        open_runs = [((longest,), capacity - longest, many)]
        while open_runs:
            lengths, gap, many = open_runs.pop()
            if not gap:
                runs.append((lengths, many))
                continue
            rest = index.complement(gap) or ((best,) if (best := index.longest(gap)) else None)
            if rest is None:
                runs.append((lengths, many))
                continue
            n = min(many, *(int(index.left[x]) // rest.count(x) for x in rest))
            for x in set(rest):
                index.take(x, n * rest.count(x))
            if n < many:
                open_runs.append((lengths, gap, many - n))
            open_runs.append((lengths + rest, gap - sum(rest), n))
    return runs


def places(runs: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset) in order of rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, many in runs:
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + many
            offset += n
        sequence += many
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of every whole text: only texts of over ``capacity`` ids are cut, and only the first piece may then be shorter.

    ``deal`` is a number of the row by itself, mixed, so that rows can be dealt
    evenly even where all else is equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        number = np.uint64(TaskContext.get().partitionId() << 40)
        for part in tk.slices(batches, "text"):
            rows: list[list[int]] = [[], [], [], [], []]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = enc.ids(text, end)
                at, stop, n = 0, (len(ids) - 1) % capacity + 1, 0
                while at < len(ids):
                    for column, value in zip(rows, (doc_id, n, at, stop - at, zlib.crc32(ids[at:stop].tobytes())), strict=True):
                        column.append(value)
                    at, stop, n = stop, stop + capacity, n + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            deal = tk.mix(np.arange(len(rows[0]), dtype=np.uint64) + number + np.uint64(1)).view(np.int64)
            number += np.uint64(len(rows[0]))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(rows, types, strict=True)), pa.array(deal)], ["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")


def ranked(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """Number the rows of each length from 0 (``rank``); ``counts[n]`` rows have length n.

    Rows of a length are dealt by ``deal`` to groups, also where many are equal
    in all else; a group is numbered by itself and moved by the sum of those
    before it. A group holds about the square root of all rows, so that
    neither a group nor the list of a length's groups is longer than that.
    """
    size = max(1, math.isqrt(int(counts.sum())))
    groups = F.element_at(F.array(*(F.lit(max(1, -(-int(n) // size))) for n in counts)), F.col("length").cast("int") + 1)
    dealt = rows.withColumn("group", F.pmod("deal", groups).cast("int"))
    sizes = dealt.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = sizes.select("length", "group", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "group").orderBy("deal", "doc_id", "piece"))
    return dealt.withColumn("own", own).join(before, ["length", "group"]).withColumn("rank", F.col("own") - 1 + F.col("before"))


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """Place every piece of every whole text in sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. A null text is an empty one, whose only id is ``end``. Rows that
    repeat a doc_id are packed each; other columns are ignored; an empty table
    gives no rows.
    """
    cut = materialise(pieces(docs, capacity, end, vocabulary), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # capacity rows at most
        counts[row["length"]] = row["count"]
    where = places(plan(counts, capacity))
    shipped = docs.sparkSession.sparkContext.broadcast(where)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                table = known[int(n)]
                at = np.searchsorted(table[:, 0], rank[mine], "right") - 1
                sequence[mine] = table[at, 1] + rank[mine] - table[at, 0]
                offset[mine] = table[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranked(cut, counts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
