"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item of some ten to a few hundred five-word shingles can stand anywhere
in a document of any length, where a signature of the whole document would not
show it. So items are partitioned by size (powers of two of their distinct
shingles) and, for each size class ``[2^c, 2^(c+1))`` that occurs, a document
is cut into windows of ``2^(c+2)`` shingles that overlap by half: an item of
the class lies whole in some window, and is at least a fixed share of it.

Windows and items have one-permutation MinHash signatures of ``16 * 2^c``
bins (a bin's smallest shingle hash). An item and a window are candidates when
some bin agrees. There are four times as many bins as a window has shingles, so
that a bin of a contained item agrees with a probability of nearly 0.9. Of an
item's bins those whose shingles the fewest items share are used, as many as
may be missing and ``SURE`` more: at least ``SURE`` used bins stand in the
document, and boilerplate of many items is no candidate's only ground. In
100,000 simulated searches each, no item of eight or eleven shingles was missed,
whole or contained to 0.8 (tests repeat a smaller simulation).

An item so small that a window's neighbours could hide all of it (fewer than
seven shingles must be there) has its rarest shingles as signature, one more
than may be missing, and meets every document that has one of them: a document
without any cannot contain it, so this search misses nothing.

Candidates, and only they, are verified by exact containment of the item's set
of shingle strings in the document's. Before any signature is made, a filter of
fixed size drops shingles that no item has, and a document without any is done:
a shingle that no item has can neither be the minimum of an item's bin nor
count for containment, but it can hide one in a window's bin, which is why
windows are cut and signed from all shingles of the documents that remain. A
document with no value of any item's signature is done then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundling.llm import textkernel as tk
from groundling.llm.skew import spread_join
from groundling.session import discard, materialise

WIDTH = 5
CONTAINMENT = 0.8
#: Used bins that stand in a document which contains the item.
SURE = 8
#: Size class of the items that have their rarest shingles as signature.
SMALL = -1
FILTER_BITS = 1 << 23
_SALT = np.uint64(0x2545F4914F6CDD1D)


def _bins(size_class: int) -> int:
    return 16 << size_class


def _place(hashes: np.ndarray) -> np.ndarray:
    """Where each hash stands in the permutation, 63 bits."""
    return (tk.mix(hashes ^ _SALT) >> np.uint64(1)).view(np.int64)


def signatures(rows: np.ndarray, hashes: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin, smallest hash) of one-permutation MinHash; bins without a hash are left out."""
    if not len(hashes):
        return rows, np.zeros(0, np.int64), hashes
    place = _place(hashes)
    bin_of = place % bins
    order = np.lexsort((place, bin_of, rows))
    r, b = rows[order], bin_of[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (b[1:] != b[:-1])
    at = order[new]
    return rows[at], bin_of[at], hashes[at]


class _Shingled:
    """Shingle hashes of a slice by row, in the order of the text."""

    def __init__(self, column: pa.Array):
        self.raw, off = tk.utf8(column)
        self.words = tk.Words(self.raw, off)
        self.of_words = tk.hash_spans(self.raw, self.words.start, self.words.end)
        self.hash, self.row = tk.shingles(self.of_words, self.words.first, WIDTH)
        self.first = np.searchsorted(self.row, np.arange(len(off)))

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row and first word of every run of ``width`` words."""
        hashes, rows = tk.shingles(self.of_words, self.words.first, width, short=False)
        count = self.words.count
        place = np.arange(len(self.of_words)) - np.repeat(self.words.first[:-1], count)
        return hashes, rows, np.flatnonzero(place + width <= np.repeat(count, count))

    def strings(self, row: int, at: np.ndarray | list[int], width: int = WIDTH) -> list[str]:
        """Text of the shingles that start at words ``at`` of a row (joined by single spaces)."""
        last, words = self.words.first[row + 1], self.words
        return [" ".join(self.raw[words.start[j] : words.end[j]].tobytes().decode() for j in range(i, min(i + width, last))) for i in at]


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, shingle, value, place, n_shingles): distinct shingles of all items, their hash and its place in the permutation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text"):
            s = _Shingled(part.column("text"))
            ids = part.column("item_id").to_pylist()
            for k in range(part.num_rows):
                unique, at = np.unique(s.hash[s.first[k] : s.first[k + 1]], return_index=True)
                texts = s.strings(k, at + s.words.first[k])
                yield pa.RecordBatch.from_arrays([pa.array([ids[k]] * len(unique), pa.int64()), pa.array(texts, pa.string()), pa.array(unique.view(np.int64)), pa.array(_place(unique))], ["item_id", "shingle", "value", "place"])

    source = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows = source.mapInArrow(run, "item_id long, shingle string, value long, place long").dropDuplicates(["item_id", "shingle"])
    return rows.withColumn("n_shingles", F.count("*").over(Window.partitionBy("item_id")))


def item_signatures(shingles: DataFrame, threshold: float) -> DataFrame:
    """(size_class, bin, value, item_id): what a document must share one of to be a candidate."""
    least = F.ceil(F.col("n_shingles") * threshold - 1e-9)
    signed = least >= SURE - 1
    size_class = F.when(signed, F.length(F.bin("n_shingles")) - 1).otherwise(SMALL).cast("int")
    binned = shingles.select("item_id", "value", "n_shingles", "place", size_class.alias("size_class"))
    bins = F.expr("shiftleft(16L, greatest(size_class, 0))")
    binned = binned.withColumn("bin", F.when(F.col("size_class") == SMALL, 0).otherwise(F.pmod("place", bins)).cast("int"))
    first = F.row_number().over(Window.partitionBy("item_id", "bin").orderBy("place", "value"))
    minima = binned.withColumn("nth", first).where((F.col("size_class") == SMALL) | (F.col("nth") == 1))
    common = shingles.groupBy("value").agg(F.count("*").alias("items"))
    used = F.col("n_shingles") - least + F.when(F.col("size_class") == SMALL, 1).otherwise(SURE)
    ranked = minima.join(common, "value").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("items", "place", "value")))
    return ranked.where(F.col("rank") <= used).select("size_class", "bin", "value", "item_id")


def value_filter(values: DataFrame) -> np.ndarray:
    """Bitmap of FILTER_BITS bits with those of all values set: 64-bit words, added up before the driver sees them."""
    bit = F.pmod("probe", F.lit(FILTER_BITS))
    probes = values.select(F.explode(F.array(F.col("value"), F.shiftrightunsigned("value", 32))).alias("probe"))
    words = probes.select(F.floor(bit / 64).cast("int").alias("w"), F.pmod(bit, F.lit(64)).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    got = words.toArrow()  # FILTER_BITS / 64 rows at most
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def passes(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through: both of their bits are set."""
    out = known[(hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
    some = np.flatnonzero(out)
    out[some] = known[((hashes[some] >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
    return out


def _windows(first: np.ndarray, rows: np.ndarray, size_class: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of shingles and the window of each, for the given rows: windows of 2^(c+2) that overlap by half."""
    stride = 2 << size_class
    index, window, n = [], [], 0
    for row in rows:
        lo, hi = first[row], first[row + 1]
        place = np.arange(hi - lo)
        last = max(0, -(-(hi - lo) // stride) - 2)  # the last window that has a shingle of its own
        for back in (0, 1):
            at = place // stride - back
            ok = (at >= 0) & (at <= last)
            index.append(lo + place[ok])
            window.append(n + at[ok])
        n += last + 1
    if not index:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(index), np.concatenate(window)


def probes(docs: DataFrame, shingles: DataFrame, signs: DataFrame) -> DataFrame:
    """What documents have of the items: rows (doc_id, size_class, bin, value) of signatures and, of the documents with such a row, rows (doc_id, shingle)."""
    spark = docs.sparkSession
    classes = sorted(r[0] for r in signs.select("size_class").distinct().collect())  # some twenty at most
    n_words = F.size(F.split("shingle", " "))
    widths = sorted(r[0] for r in shingles.select(n_words.alias("n")).where(F.col("n") < WIDTH).distinct().collect())  # 1 to 4
    shipped = spark.sparkContext.broadcast(tuple(np.packbits(value_filter(t.select("value")), bitorder="little") for t in (shingles, signs)))  # FILTER_BITS flags each, whatever the items
    schema = "doc_id long, size_class int, bin int, value long, shingle string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signed = (np.unpackbits(x, bitorder="little").astype(bool) for x in shipped.value)
        for part in tk.slices(batches, "text"):
            s = _Shingled(part.column("text"))
            ids = part.column("doc_id").to_pylist()
            out: list[list] = [[], [], [], [], []]
            found: list[np.ndarray] = []
            for width in widths:  # items shorter than a shingle: runs of their length
                runs, of, at = s.runs(width)
                mine = np.flatnonzero(passes(signed, runs))
                values, first = np.unique(np.rec.fromarrays([of[mine], runs[mine].view(np.int64)]), return_index=True)
                for row, value, k in zip(values["f0"].tolist(), values["f1"].tolist(), at[mine][first].tolist(), strict=True):
                    for column, x in zip(out, ((ids[row],) * 2, (SMALL, None), (0, None), (value, None), (None, *s.strings(row, [k], width))), strict=True):
                        column.extend(x)
            hit = np.flatnonzero(passes(known, s.hash))
            rows = np.unique(s.row[hit])
            for c in classes:
                if c == SMALL:
                    of, bins, values = s.row[hit], np.zeros(len(hit), np.int64), s.hash[hit]
                else:
                    at, window = _windows(s.first, rows, c)
                    w, bins, values = signatures(window, s.hash[at], _bins(c))
                    owner = np.zeros(int(window.max()) + 1 if len(window) else 0, np.int64)
                    owner[window] = s.row[at]
                    of = owner[w]
                keep = passes(signed, values)
                each = np.unique(np.rec.fromarrays([of[keep], bins[keep], values[keep].view(np.int64)]))
                found.append(each["f0"])
                out[0].extend(ids[r] for r in each["f0"])
                out[1].extend([c] * len(each))
                out[2].extend(each["f1"].tolist())
                out[3].extend(each["f2"].tolist())
                out[4].extend([None] * len(each))
            for row in np.unique(np.concatenate(found)).astype(np.int64) if found else ():
                mine = hit[np.searchsorted(hit, s.first[row]) : np.searchsorted(hit, s.first[row + 1])]
                texts = sorted(set(s.strings(row, mine - s.first[row] + s.words.first[row])))
                out[0].extend([ids[row]] * len(texts))
                for column in out[1:4]:
                    column.extend([None] * len(texts))
                out[4].extend(texts)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["doc_id", "size_class", "bin", "value", "shingle"])

    source = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def candidates(found: DataFrame, signs: DataFrame) -> DataFrame:
    """(doc_id, item_id) that share a value of a signature; ``found`` is the written table of :func:`probes`."""
    rows = found.where("bin is not null").select("doc_id", "size_class", "bin", "value")
    return spread_join(rows, signs, ["size_class", "bin", "value"]).select("doc_id", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """Pairs of a document and a test item that it contains.

    One row per pair with containment (distinct item shingles that the
    document has, over all distinct item shingles) of ``threshold`` or more:
    doc_id, item_id, n_shingles, n_shared (long), containment (double).
    Shingles are runs of five words. An item of one to four words is a single
    shingle of all of them, which a document has where these words stand in a
    run. Null, empty and wordless texts contain nothing and are contained in
    nothing. Rows that repeat a doc_id are one document with
    the shingles of all, and so are rows that repeat an item_id; rows without
    an id are left out, as are other columns.
    """
    shingles = materialise(item_shingles(items), "items")
    signs = materialise(item_signatures(shingles, threshold), "signs")
    found = materialise(probes(docs, shingles, signs), "probes")
    met = materialise(candidates(found, signs), "candidates")
    # only candidates' shingles are looked up: no document meets an item for a shingle that many have
    asked = spread_join(met, shingles.select("item_id", "shingle", "n_shingles"), ["item_id"])
    shared = asked.join(found.where("shingle is not null").select("doc_id", "shingle").distinct(), ["doc_id", "shingle"])
    counted = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.max("n_shingles").alias("n_shingles"))
    exact = counted.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles"))
    out = materialise(exact.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment")), "contained")
    for table in (shingles, signs, found, met):
        discard(table)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """Rows of ``docs`` that contain no test item; rows without a doc_id stay."""
    found = decontaminate(docs, items, threshold).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == F.col("_leak"), "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
ORACLE_SQL = {
    "op2_benchmark_decontamination": r"""
with i as (select distinct item_id, text from benchmark where text is not null and item_id is not null),
iw as (select item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') w from i),
ish as (select item_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from iw),
items as (select distinct item_id, s from ish),
sizes as (select item_id, count(*) n_shingles from items group by item_id),
dw as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') w from documents where text is not null and doc_id is not null),
short as (select distinct len(w) k from iw where len(w) between 1 and 4),
dsh as (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from dw
    union all select doc_id, unnest(list_transform(range(1, (len(w) - k + 2)::bigint), lambda i: array_to_string(w[i:i+k-1], ' '))) s from dw, short where len(w) >= k),
shared as (select d.doc_id, x.item_id, count(distinct x.s) n_shared from dsh d join items x using (s) group by all)
select doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles as containment from shared join sizes using (item_id) where n_shared >= 0.8 * n_shingles
""",
}
