import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from groundling.llm import lm_scoring as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + [None]


def make():
    rng = random.Random(8)
    texts = []
    for i in range(400):
        words = ["the", "cat", "sat", "on", "a", "Mat."] * rng.randrange(0, 6) + [f"w{rng.randrange(200)}" for _ in range(rng.randrange(20))]
        texts.append((i, " ".join(words)))
    return texts + [(400, None), (401, ""), (402, " \n"), (3, "the cat")]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


class Model:
    """The mixture by plain counters, with the weights that EM found."""

    def __init__(self, texts, weights):
        self.one, self.two, self.three, self.weights = Counter(), Counter(), Counter(), weights
        for text in texts:
            t = ["<s>", "<s>", *tokens(text)]
            self.one.update(t[2:])
            self.two.update(zip(t[1:], t[2:]))
            self.three.update(zip(t, t[1:], t[2:]))
        self.docs, self.n, self.v = len(texts), sum(self.one.values()), len(self.one)

    def p(self, u, v, w):
        one = self.docs if v == "<s>" else self.one[v]
        two = self.docs if v == "<s>" else self.two[u, v]
        b = lm._BUCKETS + int(math.log2(two)) + 1 if two else int(math.log2(one)) + 1 if one else 0
        a = self.weights[b]
        return a[0] * self.three[u, v, w] / max(two, 1) + a[1] * self.two[v, w] / max(one, 1) + a[2] * self.one[w] / self.n + a[3] / (self.v + 1)

    def score(self, text):
        t = ["<s>", "<s>", *tokens(text)]
        return sum(math.log10(self.p(*t[k : k + 3])) for k in range(len(t) - 2))


def scored(spark, monkeypatch, rows, when, **how):
    """Scores of all rows, and the weights and events of EM."""
    kept = {}
    fit = lm.fit_weights

    def spy(events, vocabulary, rounds=200):
        kept["weights"], kept["events"] = fit(events, vocabulary, rounds), events
        return kept["weights"]

    monkeypatch.setattr(lm, "fit_weights", spy)
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), train_when=when, **how).collect()
    monkeypatch.setattr(lm, "fit_weights", fit)
    return got, kept["weights"], kept["events"]


def test_counts_and_scores_match_brute_force(spark, monkeypatch):
    rows = make()
    got, weights, _ = scored(spark, monkeypatch, rows, lm.fold(7) != 2)
    assert len(got) == len(rows)
    model = Model([t for i, t in rows if not held(i)], weights)
    n, v = model.n, model.v
    base = lambda t: sum(math.log10((model.one[w] + 1) / (n + v + 1)) for w in tokens(t))
    want = sorted((i, len(tokens(t)), sum(model.one[w] > 0 for w in tokens(t)), base(t), model.score(t)) for i, t in rows)
    have = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got)
    assert [w[:3] for w in want] == [h[:3] for h in have] and np.allclose([w[3:] for w in want], [h[3:] for h in have])
    assert all(r["train_tokens"] == n and r["learned"] != held(r["doc_id"]) for r in got)
    assert sum(r["score"] - r["base_score"] for r in got if held(r["doc_id"])) > 0


def test_the_model_is_a_distribution(spark, monkeypatch):
    """After every context, seen or not, the probabilities of all words, the end and one unknown word add up to one."""
    rows = make()
    _, weights, _ = scored(spark, monkeypatch, rows, lm.fold(7) != 2)
    model = Model([t for i, t in rows if not held(i)], weights)
    contexts = [("<s>", "<s>"), ("<s>", "the"), ("the", "cat"), ("cat", "the"), ("never", "the"), ("never", "seen"), ("<s>", "never")]
    for u, v in contexts + [k for k in list(model.two)[:300:7] if k[1] is not None]:
        assert sum(model.p(u, v, w) for w in [*model.one, "zz-unknown"]) == pytest.approx(1), (u, v)


def test_many_levels_give_the_same_counts(spark, monkeypatch):
    """Tiny blocks and ranges, so that keys pass several levels."""
    rows = make()
    plain = sorted((r["doc_id"], r["n_known"], r["base_score"], r["score"]) for r in scored(spark, monkeypatch, rows, lm.fold(7) != 2)[0])
    assert len(lm.levels(-(-10_000 // 300), 3)) == 4 and lm.levels(1) == [1] and lm.levels(65, 64) == [64, 128] and lm.levels(257) == [256, 512]
    small = sorted((r["doc_id"], r["n_known"], r["base_score"], r["score"]) for r in scored(spark, monkeypatch, rows, lm.fold(7) != 2, block_bytes=4000, keys_per_partition=400, fan_out=3)[0])
    assert [x[:2] for x in small] == [x[:2] for x in plain] and np.allclose([x[2:] for x in small], [x[2:] for x in plain])


def test_events_are_held_out_counts(spark, monkeypatch):
    """EM's events are those of the mixed documents under the counts of the others."""
    rows = [(i, t) for i, t in make() if i != 3]
    _, _, events = scored(spark, monkeypatch, rows, lm.fold(7) != 2)
    frame = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    mixed = {r["doc_id"] for r in frame.where(lm.F.pmod(lm.F.xxhash64("doc_id", lm.F.lit(5)), lm.F.lit(5)) == 0).collect()}
    model = Model([t for i, t in rows if not held(i) and i not in mixed], None)
    want = Counter()
    for i, text in rows:
        if not held(i) and i in mixed:
            t = ["<s>", "<s>", *tokens(text)]
            for u, v, w in zip(t, t[1:], t[2:]):
                one = model.docs if v == "<s>" else model.one[v]
                two = model.docs if v == "<s>" else model.two[u, v]
                estimates = [np.array(x) for x in (model.three[u, v, w] / max(two, 1), model.two[v, w] / max(one, 1), model.one[w] / model.n)]
                want[int(lm.context_bucket(np.array(two), np.array(one))), *(int(lm._level(x)) for x in estimates)] += 1
    assert {tuple(e[:4]): e[4] for e in events.tolist()} == want


def test_em_finds_the_likeliest_weights():
    events = np.array([[43, 9, 5, 21, 500], [43, 0, 3, 21, 300], [43, 0, 0, 15, 150], [43, 5, 1, 0, 20], [3, 0, 9, 21, 40], [3, 0, 0, 21, 60]])
    estimates = np.concatenate([lm._estimate(events[:4, 1:4]), np.full((4, 1), 1 / 1001)], axis=1)
    likelihood = lambda w: (np.log(estimates @ w) * events[:4, 4]).sum()
    found = lm.fit_weights(events, 1000)
    grid = [np.array([a, b, c, 40 - a - b - c]) / 40 for a in range(1, 38) for b in range(1, 39 - a) for c in range(1, 40 - a - b)]
    assert found[43].sum() == pytest.approx(1) and likelihood(found[43]) >= max(map(likelihood, grid)) - 1e-6
    assert found[3][0] == 0 and found[:, :2].shape == (2 * lm._BUCKETS, 2) and not found[0, :2].any() and found.sum(axis=1) == pytest.approx(1)
    assert lm._estimate(lm._level(np.array([0.25, 2.0**-10, 0.0]))).tolist() == [0.25, 2.0**-10, 0.0]


def test_long_texts_repeated_rows_and_clashing_columns(spark, monkeypatch):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(150_000))
    rows = [(1, long), (2, "w1 w2 w3"), (2, "w1 w2 w3"), (2, "w1 w2 w3"), (None, "w1 w2"), (3, ""), (5, " ".join(["w1"] * 50_000))]
    docs = spark.createDataFrame([(i, t, 7, b"x", "y") for i, t in rows], "doc_id long, text string, block long, keys binary, part string")
    got = lm.lm_scores(docs).collect()
    _, weights, _ = scored(spark, monkeypatch, rows, None)
    model = Model([t for _, t in rows], weights)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i or 0, len(tokens(t))) for i, t in rows)
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"])
        assert r["score"] == pytest.approx(model.score(text), rel=1e-9), r["doc_id"]
    assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = lm.lm_scores(docs, train_when=lm.F.lit(False)).collect()
    assert [(r["base_score"], r["score"], r["n_known"], r["train_tokens"]) for r in got] == [(0, 0, 0, 0)] * 2
    assert lm.lm_scores(docs.limit(0)).count() == 0


def test_many_blocks_to_a_partition(spark, monkeypatch):
    """Partitions are capped; what a group does not share with others stays right."""
    from groundling.llm import lm_scoring as lm

    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 23}" for j in range(40))) for k in range(60)], "doc_id long, text string")
    want = sorted(lm.lm_scores(docs).collect())
    monkeypatch.setattr(lm, "MOST_PARTITIONS", 2)
    got = sorted(lm.lm_scores(docs, block_bytes=200, keys_per_partition=100, fan_out=4).collect())
    assert [tuple(r)[:5] for r in got] == [tuple(r)[:5] for r in want]
    assert all(abs(a.base_score - b.base_score) < 1e-9 and abs(a.score - b.score) < 1e-6 for a, b in zip(got, want, strict=True))
