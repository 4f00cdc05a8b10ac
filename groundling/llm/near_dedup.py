"""Near-duplicate groups by ProbMinHash, banding and exact verification.

A document is its five-word shingles, weighted by ``1 + ln(count)``. Each
shingle runs a Poisson process of that rate: arrival times are sums of
exponentials drawn from the shingle's hash, each arrival falls on one of
``m`` components, and a component keeps the shingle that came first. Two
documents agree in a component with the probability Jaccard of their weights.
A shingle stops as soon as its next arrival is later than the latest first
arrival (early termination), so a document costs about its shingles plus
``m log m`` and not their product.

Copies are one class (MD5 of the text). Class representatives meet in the
buckets of ``bands`` bands of that signature, and of a second one with all
weights 1, which agrees with the plain Jaccard: repetitions can keep two texts
apart in the first whose shingle sets are near. A text that repeats no shingle
has one and the same signature by both. No pairs of a bucket are emitted: each bucket
compares its members with one leader, the member that meets most others, and
verified links join components. Members of buckets that still hold more than
one component are then joined exactly, on the rarest shingles of each (prefix
and position filter, by number for plain and by weight for probability Jaccard)
and across components only. A link is an exact probability
Jaccard, or plain Jaccard of the shingle sets, of the threshold or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundling.llm import textkernel as tk
from groundling.llm.skew import spread_join
from groundling.session import discard, materialise

WIDTH = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 25, 5
ROUNDS = 1
LEADERS = 3
FILTER_BITS = 1 << 27
_LEAST = -(1 << 63)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def weights(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def prob_minhash(rows: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """Signatures (n_rows x m, uint64) of weighted sets given as distinct (row, hash); zero for an empty set."""
    first = np.full(n_rows * m, np.inf)
    winner = np.zeros(n_rows * m, np.uint64)
    time = np.zeros(len(rows))
    seed, rate, row = tk.mix(hashes), weight, rows
    drawn, turn = 0, 1
    while len(row):
        # `turn` further arrivals of every process that goes on
        step = np.arange(drawn + 1, drawn + turn + 1, dtype=np.uint64) * _STEP
        draw = tk.mix(seed[:, None] + step[None, :])
        gap = -np.log1p(-((draw >> np.uint64(11)).astype(float) * 2.0**-53)) / rate[:, None]
        when = np.cumsum(gap, axis=1) + time[:, None]
        component = ((tk.mix(draw ^ _STEP) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        at = (row[:, None] * m + component).ravel()
        flat = when.ravel()
        np.minimum.at(first, at, flat)
        won = np.flatnonzero(first[at] == flat)
        winner[at[won]] = seed[won // turn]
        time = when[:, -1]
        alive = np.unique(row)
        latest = np.zeros(n_rows)
        latest[alive] = first.reshape(n_rows, m)[alive].max(axis=1)
        on = time < latest[row]
        row, seed, rate, time = row[on], seed[on], rate[on], time[on]
        drawn += turn
        if drawn > 1:
            turn = min(turn * 2, 256)
    return winner.reshape(n_rows, m)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """Bucket of each band (rows x bands, uint64)."""
    r = signature.shape[1] // bands
    return np.stack([tk.combine([np.full(len(signature), k, np.uint64), *(signature[:, k * r + j] for j in range(r))]) for k in range(bands)], axis=1)


def _weighted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle, count) of a text column."""
    raw, off = tk.utf8(column)
    words = tk.Words(raw, off)
    hashes, rows = tk.shingles(tk.hash_spans(raw, words.start, words.end), words.first, WIDTH)
    return tk.distinct(rows, hashes)


def sketches(docs: DataFrame, bands: int, band_rows: int) -> DataFrame:
    """doc_id, class (MD5 of the text), keys (buckets of the bands by weight and of those by plain sets, each once; null for a text without a word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text", 2 << 20):
            rows, hashes, counts = _weighted(part.column("text"))
            keys = band_keys(prob_minhash(rows, hashes, weights(counts), part.num_rows, bands * band_rows), bands)
            full = np.zeros(part.num_rows, bool)
            full[rows] = True
            use = np.repeat(full[:, None], 2 * bands, axis=1)
            use[:, bands:] = False
            both = np.concatenate([keys, keys], axis=1)
            again = np.unique(rows[counts > 1])  # only these have other buckets by plain sets
            if len(again):
                own = np.isin(rows, again)
                both[again, bands:] = band_keys(prob_minhash(np.searchsorted(again, rows[own]), hashes[own], np.ones(int(own.sum())), len(again), bands * band_rows), bands)
                use[:, bands:] = both[:, bands:] != keys
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(use.sum(axis=1))]).astype(np.int32)), pa.array(both[use].view(np.int64)))
            lists = pa.array([x if ok else None for x, ok in zip(lists, full, strict=True)], pa.list_(pa.int64())) if not full.all() else lists
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("class"), lists], ["doc_id", "class", "keys"])

    return _classed(docs).mapInArrow(run, "doc_id long, class binary, keys array<long>")


def _classed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("class"), text.alias("text"))


def node_key(rep: Column, kind: Column) -> Column:
    """Name of a class: its least doc_id (null last) and its MD5, so that of two names the lesser has the lesser doc_id."""
    value = F.unhex(F.lpad(F.hex(rep.bitwiseXOR(F.lit(_LEAST))), 16, "0"))
    return F.concat(F.when(rep.isNull(), F.unhex(F.lit("01" + 16 * "F"))).otherwise(F.concat(F.unhex(F.lit("00")), value)), kind)


def rep_of(node: Column) -> Column:
    """The least doc_id of a class, from its name."""
    value = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_LEAST))
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", value)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes, counts) of the classes ``wanted`` (node).

    Texts are read again where they lie. A filter made of the wanted classes'
    names passes their least documents and a few others, which the join drops;
    only what passes is shuffled. The filter grows with the classes up to
    ``FILTER_BITS``; beyond that it passes more, and the join still decides.
    """
    bits = min(FILTER_BITS, max(1 << 16, 1 << (8 * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64("node"), F.lit(bits))
    words = wanted.select(F.floor(bit / 64).cast("int").alias("w"), F.pmod(bit, F.lit(64)).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    table = np.zeros(bits // 64, np.uint64)
    got = words.toArrow()  # FILTER_BITS / 64 rows at most
    table[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    shipped = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        seen: set[bytes] = set()  # wanted classes that this task has sent: copies without an id, or with the same one
        for batch in batches:
            name = batch.column("name").to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)
            ok = (known[(name >> np.uint64(3)).astype(np.int64)] >> (name & np.uint64(7)).astype(np.uint8)) & 1
            chosen = []
            for k in np.flatnonzero(ok):
                node = batch.column("node")[int(k)].as_py()
                if node not in seen:
                    seen.add(node)
                    chosen.append(k)
            for part in tk.slices(iter([batch.take(pa.array(chosen, pa.int64()))]), "text"):
                rows, hashes, counts = _weighted(part.column("text"))
                at = np.searchsorted(rows, np.arange(part.num_rows + 1))
                blobs = [[a[at[k] : at[k + 1]].astype(t).tobytes() for k in range(part.num_rows)] for a, t in ((hashes, np.uint64), (counts, np.uint32))]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], ["node", "hashes", "counts"])

    source = _classed(docs).select(node_key(F.col("doc_id"), F.col("class")).alias("node"), "text").withColumn("name", F.xxhash64("node"))
    sets = source.mapInArrow(run, "node binary, hashes binary, counts binary")
    return sets.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Exact probability Jaccard and plain Jaccard of two weighted sets (sorted hashes, weights)."""
    (ha, wa), (hb, wb) = a, b
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0, 0.0
    plain = len(common) / (len(ha) + len(hb) - len(common))
    # sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d): sorted by the ratio b / a
    ratio = wb[ib] / wa[ia]
    order = np.argsort(ratio)
    r, x, y = ratio[order], wa[ia][order], wb[ib][order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # e with ratio_e <= ratio_d contribute a_e / a_d, the others b_e / b_d
    below = np.cumsum(x)
    above = y.sum() - np.cumsum(y)
    return float((1 / ((only_a + below) / x + (only_b + above) / y)).sum()), plain


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs``, a written table, whose exact similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c) for c in ("ha", "ca", "hb", "cb")}
            ok = []
            for k in range(batch.num_rows):  # views of the batch's buffers, no copies
                sides = [(np.frombuffer(column[h][k].as_buffer(), np.uint64), weights(np.frombuffer(column[c][k].as_buffer(), np.uint32).astype(float))) for h, c in (("ha", "ca"), ("hb", "cb"))]
                ok.append(max(similarity(*sides)) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    # a leader is in many pairs, on either side
    total = pairs.count()
    by_b = pairs.groupBy("b").agg(F.count("*").alias("n"))
    met = spread_join(spread_join(pairs, left, ["a"], total=total), right, ["b"], counts=by_b, total=total)
    return met.select("a", "b", "ha", "ca", "hb", "cb").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the least node that it is connected with.

    Alternating large and small stars: every step gives each node's neighbours
    its least neighbour, until all edges lead to the least node of their
    component. A node with a large share of all edges is dealt over several
    tasks in each step.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.where("b < a")
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        joined = spread_join(near, least.select("a", "m"), ["a"], counts=least.select("a", "n"))
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return materialise(out.where("a != b").distinct(), "edges")

    current = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        for large in (True, False):
            after = star(current, large)
            discard(current)
            current = after
        # done when every node has one edge, to a node that has none
        parents = current.groupBy("a").agg(F.count("*").alias("n"))
        if parents.where("n > 1").isEmpty() and current.select("b").distinct().join(current.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def rare_prefix_pairs(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, component) of different components that may reach the threshold by plain or by probability Jaccard: their rarest shingles meet.

    Let ``u`` and ``v`` be the shares of the two texts' weights that their common
    shingles have. Probability Jaccard is at most ``1 / (1/u + 1/v - 1)``: a
    common shingle of shares x and y adds no more than ``1 / (1/x + (1 - v)/y)``,
    which is concave and homogeneous, so the sum is no more than its value at
    (u, v). So u and v reach the threshold, and the first common shingle stands
    where that much weight is left in both. Two even texts (each with one count
    for all its shingles) have one similarity by both, and the closer bound by
    number finds them.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, blob, counts in zip(batch.column("node"), batch.column("hashes"), batch.column("counts"), strict=True):
                node, hashes = node.as_py(), np.frombuffer(blob.as_buffer(), np.int64)
                weight = weights(np.frombuffer(counts.as_buffer(), np.uint32).astype(float))
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(hashes), pa.binary()), pa.array(np.full(len(hashes), len(hashes), np.int64)), pa.array(hashes), pa.array(weight / weight.sum()), pa.array(np.full(len(hashes), weight.min() == weight.max()))], ["node", "n", "shingle", "share", "even"])

    rows = sets.join(nodes.select("node"), "node", "left_semi").mapInArrow(spread, "node binary, n long, shingle long, share double, even boolean")
    seen = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("node")
    order = own.orderBy(F.coalesce("df", F.lit(1)), "shingle")
    placed = rows.join(seen, "shingle", "left").withColumn("place", F.row_number().over(order)).withColumn("common", F.count("df").over(own))
    # what of the weight stands before a shingle, and how much of it other nodes have
    placed = placed.withColumn("left", 1 - (F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("share"))).withColumn("known", F.sum(F.when(F.col("df").isNotNull(), F.col("share"))).over(own))
    # a node whose shared shingles are too few, and too light, for the threshold has no partner; the others meet in their rarest
    by_set = (F.col("common") >= F.col("n") * threshold - 1e-9) & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    by_weight = (F.col("known") >= threshold - 1e-9) & (F.col("left") >= threshold - 1e-9)
    # of two that reach the threshold, one has this much left after the first common shingle: the smaller, and the one with more weight left
    half = 2 * threshold / (1 + threshold)
    able = placed.where(F.col("df").isNotNull()).withColumn("by_set", by_set).withColumn("by_weight", by_weight)
    able = able.withColumn("first", (F.col("by_set") & (1 + F.col("n") - F.col("place") >= F.col("n") * half - 1e-9)) | (F.col("by_weight") & (F.col("left") >= half - 1e-9)))
    prefix = able.where("by_set or by_weight").select("node", "shingle", "n", "place", "left", "by_set", "by_weight", "even", "first").join(nodes, "node")
    # a shingle that only one component has, or that nobody may meet others in, joins nothing new
    across = prefix.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("first").alias("any")).where("lo != hi and any").select("shingle")
    prefix = materialise(prefix.join(across, "shingle"), "prefix")
    other = prefix.where("first").select(F.col("node").alias("b"), "shingle", F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("left").alias("lb"), F.col("by_set").alias("sb"), F.col("by_weight").alias("wb"), F.col("even").alias("eb"), F.col("component").alias("cb"))
    # from the first common shingle on, no more than the shorter rest, or the lighter, can be common
    enough = F.col("by_set") & F.col("sb") & (1 + F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("pb")) >= (F.col("n") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    heavy = ~(F.col("even") & F.col("eb")) & F.col("by_weight") & F.col("wb") & (1 / F.col("left") + 1 / F.col("lb") - 1 <= 1 / threshold + 1e-9)
    met = spread_join(prefix, other, ["shingle"]).where("node != b and component != cb and not (first and node > b)").where(enough | heavy)
    pairs = materialise(met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), "pairs")
    discard(prefix)
    return pairs


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """Class and group of every document.

    One row per input row: doc_id, class_id (string, equal for equal texts),
    group_id (long, the least doc_id of the group), copies (long, rows of the
    class). Copies are a group, and so are texts connected by links. A text of
    one to four words has one shingle of all of them. Null, empty and wordless
    texts are compared with nothing: class_id is null and group_id their own
    doc_id. Rows without a doc_id take part; a group of only such rows has a
    null group_id. Other columns are ignored.
    """
    sketched = materialise(sketches(docs, bands, band_rows), "sketches")
    worded = sketched.where("keys is not null")
    classes = worded.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("keys").alias("keys"))
    classes = materialise(classes.select("class", node_key(F.col("rep"), F.col("class")).alias("node"), "copies", "keys"), "classes")
    used = [classes]
    buckets = classes.select("node", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(buckets.join(shared, "key"), "members")
    wanted = materialise(members.select("node").distinct(), "wanted")
    sets = materialise(shingle_sets(docs, wanted), "sets")
    used += [members, wanted, sets]
    links, group = None, None
    for turn in range(ROUNDS + 1):
        placed = members.withColumn("component", F.col("node")) if group is None else members.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # the leader is the member that meets most others in all its buckets: a family's base rather than one of its variants
        degrees = placed.groupBy("node").agg(F.sum("n").alias("degree"))
        rank = F.struct(-F.col("degree"), F.xxhash64("node", F.pmod("key", F.lit(LEADERS))), "node", "component")
        placed = materialise(placed, "placed")
        leads = placed.join(degrees, "node").groupBy("key").agg(F.min(rank).alias("lead"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
        leads = materialise(leads.select("key", F.col("lead.node").alias("leader"), F.col("lead.component").alias("own")), "leads")
        sizes = placed.select("key", "n").distinct()
        met = materialise(spread_join(placed, leads, ["key"], counts=sizes).where("node != leader"), "met")
        used += [placed, leads, met]
        if met.isEmpty():
            break
        if turn == ROUNDS:
            rest = materialise(met.select("node", "component").union(met.select("leader", "own")).distinct(), "rest")
            pairs = rare_prefix_pairs(rest, sets, threshold)
            used.append(rest)
        else:
            pairs = materialise(met.where("component != own").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "pairs")
        found = materialise(verified(pairs, sets, threshold), "links")
        links = found if links is None else links.unionByName(found)
        group = materialise(components(links), "groups")
        members = met.select("key", "node", "n")
        used += [pairs, found, group]
    grouped = classes.select("class", "node", "copies")
    if group is not None:
        grouped = grouped.join(group, "node", "left").withColumn("node", F.coalesce("component", "node"))
    grouped = materialise(grouped.select("class", "copies", rep_of(F.col("node")).alias("group_id")), "grouped")
    for table in used:
        discard(table)
    # a class of copies may be a large share of all documents, and so may texts without a word
    out = spread_join(worded.select("doc_id", "class"), grouped, ["class"], counts=grouped.select("class", F.col("copies").alias("n")))
    out = out.select("doc_id", F.lower(F.hex("class")).alias("class_id"), "group_id", "copies")
    return out.unionByName(sketched.where("keys is null").select("doc_id", F.lit(None).cast("string").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("copies")))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of each group: that of its least doc_id, and of its repetitions one.

    A row is known by doc_id and text, so an id that stands on several texts
    loses only those that are copies. Rows without a doc_id stay.
    """
    groups = near_duplicates(docs, threshold)
    gone = groups.where("doc_id is not null and doc_id != group_id").select(F.col("doc_id").alias("_gone"), F.col("class_id").alias("_class")).distinct()
    out = docs.join(gone, (docs["doc_id"].cast("long") == F.col("_gone")) & (F.md5(docs["text"].cast("string")) == F.col("_class")), "left_anti")
    twice = groups.where("doc_id is not null and class_id is not null").groupBy("doc_id", "class_id").count().where("count > 1")
    if not twice.isEmpty():
        named, none = out.where("doc_id is not null"), out.where("doc_id is null")
        out = named.dropDuplicates(["doc_id", "text"]).unionByName(none)
    return out


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLE_SQL: dict[str, str] = {}
