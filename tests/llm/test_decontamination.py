import random
import re

import numpy as np

from groundling.llm import decontamination as dc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def by_force(docs, items, threshold=0.8):
    out = set()
    for d, text in docs:
        for i, item in items:
            s = shingle_set(item)
            width = min(5, len(WORD.findall(item or "")))
            w = WORD.findall(text or "")
            runs = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
            if s and w and len(s & runs) >= threshold * len(s):
                out.add((d, i))
    return out


def make(seed=4):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**5)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([12, 15, 20, 40, 90, 200])))) for i in range(60)]
    docs = []
    for d in range(250):
        words = [word() for _ in range(rng.choice([5, 30, 300, 3000]))]
        if d % 2:
            for _ in range(rng.choice([1, 1, 2])):
                item = items[rng.randrange(60)][1].split()
                if d % 3 == 0:  # a part or a changed word
                    item = item[: int(len(item) * rng.choice([0.5, 0.7, 0.9, 0.95]))]
                at = rng.randrange(len(words))
                words[at:at] = item
        docs.append((d, " ".join(words)))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = make()
    got = dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == by_force(docs, items)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got}) > 80


def test_small_items_are_not_missed():
    rng = np.random.default_rng(0)
    for size, shared in ((8, 8), (8, 7), (11, 9)):
        c, trials = int(np.log2(size)), 5000
        width = 4 << c
        drawn = rng.integers(0, 2**64, (trials, width + size), dtype=np.uint64)
        item = np.concatenate([drawn[:, :shared], drawn[:, width : width + size - shared]], axis=1)
        window_at, _, window = dc.signatures(np.repeat(np.arange(trials), width), drawn[:, :width].ravel(), dc._bins(c))
        item_at, _, own = dc.signatures(np.repeat(np.arange(trials), size), item.ravel(), dc._bins(c))
        known = set(zip(window_at.tolist(), window.tolist()))
        found = {r for r, v in zip(item_at.tolist(), own.tolist()) if (r, v) in known}
        assert len(found) == trials


def test_items_of_few_shingles_in_long_documents(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(5 + i % 7))) for i in range(1400)]
    docs = []
    for d in range(20):
        words = [word() for _ in range(3000)]
        for _, text in items[d::20]:
            at = rng.randrange(len(words))
            words[at:at] = text.split() if rng.random() < 0.8 else text.split()[:-1]
        docs.append((d, " ".join(words)))
    of_docs, of_items = [(d, shingle_set(t)) for d, t in docs], [(i, shingle_set(t)) for i, t in items]
    want = {(d, i): len(s & own) for d, own in of_docs for i, s in of_items if len(s & own) >= 0.8 * len(s)}
    got = dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_shared"] for r in got} == want and len(got) == len(want) > 1000


def test_only_candidates_are_read(spark):
    """Boilerplate that all items and all documents share makes no pairs; without signatures, nothing is found."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    common = " ".join(word() for _ in range(9))
    items = [(i, f"{common} " + " ".join(word() for _ in range(20))) for i in range(150)]
    docs = [(d, " ".join(word() for _ in range(40)) + f" {common} " + (items[d][1] if d < 30 else "")) for d in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    shingles = dc.item_shingles(spark.createDataFrame(items, "item_id long, text string")).cache()
    signs = dc.item_signatures(shingles, 0.8).cache()
    found = dc.probes(table, shingles, signs).cache()
    pairs = {tuple(r) for r in dc.candidates(found, signs).collect()}
    assert {(d, d) for d in range(30)} <= pairs and len(pairs) < 60
    assert found.where("shingle is not null").select("doc_id").distinct().count() < 60
    got = dc.decontaminate(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, d) for d in range(30)} == by_force(docs, items)
    assert dc.candidates(found, signs.limit(0)).count() == 0


def test_short_items_inside_documents(spark):
    """Items of one to four words are runs of words, at any place of a document."""
    rng = random.Random(13)
    long = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    docs = [(1, "a b c d e f g h"), (2, "b c d"), (3, "x y b c d e f z"), (4, " ".join([*long, "q", "r"])), (5, "d"), (6, "b  c\nd x"), (7, "bc d")]
    items = [(1, "b c d"), (2, "b c d e f"), (3, "c d e f g h"), (4, "d"), (5, "q r"), (6, " ".join(long[9000:9004])), (7, "c b"), (8, "d")]
    got = dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found == by_force(docs, items) and len(got) == len(found) and {(1, 1), (2, 1), (6, 1), (4, 5), (4, 6), (5, 4), (5, 8)} <= found and (7, 1) not in found


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c"), (5, "x " * 5000 + "a b c d e f")]
    items = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "a b c d e f"), (None, "a b c"), (5, "a b c d e f")]
    table = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, item_id string, bin int")
    got = dc.decontaminate(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(3, 1), (4, 1), (5, 1), (4, 4), (4, 5), (5, 4), (5, 5)} and len(got) == 7
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(table, none).count() == 0
    assert dc.decontaminate(table.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
