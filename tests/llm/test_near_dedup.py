import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundling.llm import near_dedup as nd
from groundling.llm import skew
from groundling.llm import textkernel as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def groups_by_force(texts, threshold=0.8):
    """Components of links of plain Jaccard."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and (texts[i] == texts[j] or jaccard(sets[i], sets[j]) >= threshold):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def make_texts(seed=3):
    rng = random.Random(seed)
    texts = []
    for size, copies, edits in ((60, 6, 1), (300, 30, 6), (120, 4, 2), (40, 3, 3), (8, 2, 1)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(copies):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(40)]
    texts += [texts[0], texts[0], "a b", "a b", "a  b", "solo", "", None, " \n "]
    return texts


def test_groups_match_brute_force(spark):
    texts = make_texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, class_id string, node int")
    rows = {r["doc_id"]: r for r in nd.near_duplicates(docs).collect()}
    expected = groups_by_force(texts)
    assert [rows[i]["group_id"] for i in range(len(texts))] == expected
    assert all(rows[i]["class_id"] is None for i, t in enumerate(texts) if not shingle_set(t))
    assert rows[0]["copies"] == 3


def test_small_buckets_chain(spark):
    """A family whose members are close to their base only is one group whichever leads."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base)]
    for k in range(25):
        other = list(base)
        for place in range(6):  # some 30 of 196 shingles: 0.74 to 0.85 with the base, less with each other
            other[(k * 7 + place * 31) % 200] = f"y{rng.randrange(10**9)}"
        texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["group_id"] for r in nd.near_duplicates(docs, threshold=0.7).collect()}
    assert [rows[i] for i in range(len(texts))] == groups_by_force(texts, 0.7)


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    hashes = tk.mix(np.arange(300, dtype=np.uint64))
    a = (hashes[:200], rng.integers(1, 9, 200).astype(float))
    b = (hashes[60:260], rng.integers(1, 9, 200).astype(float))
    m = 4096
    sig = [nd.prob_minhash(np.zeros(200, np.int64), h, w, 1, m)[0] for h, w in (a, b)]
    order = [np.argsort(h) for h, _ in (a, b)]
    exact = nd.similarity(*[(h[o], w[o]) for (h, w), o in zip((a, b), order)])[0]
    by_rule = 0.0
    wa, wb = dict(zip(*a)), dict(zip(*b))
    for d in set(wa) & set(wb):
        by_rule += 1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in set(wa) | set(wb))
    assert exact == pytest.approx(by_rule)
    assert np.mean(sig[0] == sig[1]) == pytest.approx(exact, abs=0.03)
    equal = nd.similarity((a[0], np.ones(200)), (a[0], np.ones(200)))
    assert equal == (pytest.approx(1), 1)


def test_rare_prefix_finds_every_link(spark):
    texts = [t for t in make_texts(9) if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").where("text is not null")
    sk = nd.sketches(docs, nd.BANDS, nd.BAND_ROWS).where("keys is not null")
    classes = sk.groupBy("class").agg(F.min("doc_id").alias("rep")).select("rep", nd.node_key(F.col("rep"), F.col("class")).alias("node"))
    sets = nd.shingle_sets(docs, classes.select("node"))
    pairs = nd.verified(nd.rare_prefix_pairs(classes.select("node", classes["node"].alias("component")), sets, 0.8), sets, 0.8)
    names = {bytes(r["node"]): r["rep"] for r in classes.collect()}
    got = {tuple(sorted((names[bytes(r["a"])], names[bytes(r["b"])]))) for r in pairs.collect()}
    reps = sorted(names.values())
    want = {(i, j) for i in reps for j in reps if i < j and jaccard(shingle_set(texts[i]), shingle_set(texts[j])) >= 0.8}
    assert want <= got


def test_empty_table_and_odd_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, None)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["group_id"] or 0, r["copies"]) for r in nd.near_duplicates(docs).collect())
    assert rows == [(0, 0, 1), (0, 1, 3), (1, 1, 3), (1, 1, 3), (2, 2, 1)]


def test_one_row_of_each_group_stays(spark):
    same = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(0, other, "a"), (1, same, "a"), (1, same, "a"), (1, other, "b"), (2, same, "a"), (2, "short own text", "c"), (3, None, "d"), (3, None, "d"), (None, same, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    kept = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["text"] or "", r["class_id"]) for r in nd.keep_one(docs).collect())
    assert kept == sorted([(0, other, "a"), (1, same, "a"), (2, "short own text", "c"), (3, "", "d"), (-1, same, "e")])


def test_repeated_lines_do_not_hide_plain_links(spark):
    """One half of the lines stands 50 times in one text, the other half in the other: near by plain Jaccard, far by weight."""
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2)]
        own = [" ".join(f"x{rng.randrange(10**6)}" for _ in range(5)) for _ in range(2)]
        texts.append(" ".join([lines[0]] * 50 + [lines[1], own[0]]))
        texts.append(" ".join([lines[0]] + [lines[1]] * 50 + [own[1]]))
    texts.append(" ".join(f"u{k}" for k in range(60)))
    expected = groups_by_force(texts)
    assert expected == [k - k % 2 for k in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["group_id"] for r in nd.near_duplicates(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == expected


def weighted_texts(seed=6):
    """Families that share a passage repeated 2 to 50 times and have private words, so that weight and number part."""
    rng = random.Random(seed)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(70)]
        for _ in range(8):
            part = base[: rng.choice([70, 70, 66, 60, 45])]
            texts.append(" ".join(part * rng.choice([2, 10, 50]) + [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([5, 15, 25, 40]))]))
    return texts


def weighted_links(spark, texts, threshold=0.8):
    """Pairs of documents that reach the threshold by one similarity, and those of them that only the weight links."""
    from itertools import combinations

    import pyarrow as pa

    rows, hashes, counts = nd._weighted(pa.array(texts))
    sets = [(hashes[rows == k], nd.weights(counts[rows == k])) for k in range(len(texts))]
    found = {(i, j): nd.similarity(sets[i], sets[j]) for i, j in combinations(range(len(texts)), 2)}
    return {p for p, s in found.items() if max(s) >= threshold}, {p for p, (weighted, plain) in found.items() if weighted >= threshold > plain}


def test_rare_prefix_finds_links_by_weight(spark):
    texts = weighted_texts()
    want, by_weight = weighted_links(spark, texts)
    assert len(by_weight) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sk = nd.sketches(docs, nd.BANDS, nd.BAND_ROWS)
    classes = sk.select(nd.node_key(F.col("doc_id"), F.col("class")).alias("node"), F.col("doc_id").alias("rep"))
    sets = nd.shingle_sets(docs, classes.select("node"))
    pairs = nd.verified(nd.rare_prefix_pairs(classes.select("node", classes["node"].alias("component")), sets, 0.8), sets, 0.8)
    names = {bytes(r["node"]): r["rep"] for r in classes.collect()}
    assert {tuple(sorted((names[bytes(r["a"])], names[bytes(r["b"])]))) for r in pairs.collect()} == want


def test_a_leader_that_links_to_neither_parts_nothing(spark):
    """One band of one row: buckets of many texts, whose leader has few of the links among the rest."""
    texts = weighted_texts(8)
    links, _ = weighted_links(spark, texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r["doc_id"]: set(r["keys"]) for r in nd.sketches(docs, 1, 1).collect()}
    component = list(range(len(texts)))
    for i, j in sorted(links):
        if keys[i] & keys[j]:
            lo, hi = sorted((component[i], component[j]))
            component = [lo if c == hi else c for c in component]
    rows = {r["doc_id"]: r["group_id"] for r in nd.near_duplicates(docs, bands=1, band_rows=1).collect()}
    assert [rows[i] for i in range(len(texts))] == component


def test_names_of_classes_sort_by_id(spark):
    ids = [None, -(1 << 63), -7, -1, 0, 3, 255, 256, (1 << 63) - 1]
    rows = spark.createDataFrame([(i, bytes([k] * 16)) for k, i in enumerate(ids)], "rep long, kind binary").select("rep", nd.node_key(F.col("rep"), F.col("kind")).alias("node"))
    got = [(r["rep"], r["back"]) for r in rows.withColumn("back", nd.rep_of(F.col("node"))).orderBy("node").collect()]
    assert [r for r, _ in got] == [*ids[1:], None] and all(a == b for a, b in got)


def test_near_copies_without_an_id_are_linked(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    near = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in (5, 40, 75)]
    rows = [(7, " ".join(base)), (None, near[0]), (None, near[0]), (None, near[1]), (9, near[2]), (None, "some other words that stand alone here"), (None, " ".join(base[:40])), (None, " ".join([*base[:39], "z"]))]
    got = sorted((r["group_id"] is None, r["group_id"] or 0, r["copies"]) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 7, 1)] * 3 + [(False, 7, 2)] * 2 + [(True, 0, 1)] * 3


def test_a_hot_key_loses_and_doubles_nothing(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    values = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(values, "k", how).select("k", "v", F.coalesce("x", F.lit(-1))).collect()))
        assert sorted(map(tuple, skew.spread_join(rows, values, ["k"], how).select("k", "v", F.coalesce("x", F.lit(-1))).collect())) == want
    assert skew.spread_join(rows.limit(0), values, ["k"]).count() == 0


def test_every_link_of_a_table_with_repetitions(spark):
    """sf0.01 with planted near copies that repeat lines: groups are those of all pairs."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(2)
    for k, (_, text) in enumerate(docs[:200]):
        words = WORD.findall(text or "")
        if len(words) >= 30:
            at = rng.randrange(len(words) - 8)
            docs.append((10**6 + k, " ".join([*words, *(words[at : at + 8] * rng.choice([1, 20, 60]))])))
    got = {r["doc_id"]: r["group_id"] for r in nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    rows, hashes, counts = nd._weighted(__import__("pyarrow").array([t for _, t in docs]))
    first = np.searchsorted(rows, np.arange(len(docs) + 1))
    sets = [(hashes[a:b], nd.weights(counts[a:b])) for a, b in zip(first[:-1], first[1:])]
    owners, links = {}, set()
    for i, (own, _) in enumerate(sets):
        for h in own.tolist():
            owners.setdefault(h, []).append(i)
    shared = {}
    for each in owners.values():
        for x in range(len(each)):
            for y in range(x):
                shared[each[y], each[x]] = shared.get((each[y], each[x]), 0) + 1
    for (i, j), n in shared.items():
        if n >= 0.3 * max(len(sets[i][0]), len(sets[j][0])) and max(nd.similarity(sets[i], sets[j])) >= 0.8:
            links.add((i, j))
    group = list(range(len(docs)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in links:
        group[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    assert len(links) > 150 and all(got[d] == least[find(i)] for i, (d, _) in enumerate(docs))
