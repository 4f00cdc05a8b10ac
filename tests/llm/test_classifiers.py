import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundling.llm import language_id as lid
from groundling.llm import quality_classifier as qc
from groundling.llm import toxicity as tox
from groundling.llm.docstats import fold

DATA = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_language_held_out_accuracy(spark):
    docs, _ = tables(spark)
    out = lid.op6_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.98 and out["score"].between(0, 1).all()


def test_mixtures_and_edges(spark):
    words = {"en": "the of and that with from this have", "de": "der und nicht sich mit eine auch werden", "fr": "dans pour avec les des une sur"}
    rng = random.Random(1)
    say = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    train = spark.createDataFrame([(say(x, 80), x) for x in words for _ in range(20)] + [(None, "en"), ("x", None)], "text string, lang string")
    profiles = lid.fit_profiles(train)
    assert profiles.languages == ["de", "en", "fr"]
    rows = [(1, say("en", 50), "zz"), (2, say("de", 30) + " " + say("fr", 30), "zz"), (3, None, "zz"), (4, "", "zz"), (5, "12 34 !!", "zz"), (6, say("fr", 40000), "zz"), (1, say("en", 50), "zz"), (None, "LES DES", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    out = lid.language_id(docs, profiles).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["lang_pred"] == "en" and by[6]["lang_pred"] == "fr" and by[None]["lang_pred"] == "fr"
    assert set(by[2]["languages"].split(",")) == {"de", "fr"} and by[1]["languages"] == "en"
    assert [(by[k]["lang_pred"], by[k]["score"], by[k]["languages"]) for k in (3, 4, 5)] == [("und", 0, "")] * 3
    kept = lid.keep_known_language(docs, profiles)
    assert kept.columns == docs.columns and kept.count() == 5
    nothing = lid.fit_profiles(train.limit(0))
    assert {r["lang_pred"] for r in lid.language_id(docs, nothing).collect()} == {"und"}
    assert lid.language_id(docs.limit(0), profiles).count() == 0


def test_em_matches_plain_loops():
    rng = np.random.default_rng(0)
    loglik, first = rng.normal(-20, 4, (37, 3)), np.array([0, 12, 12, 37])
    share, chosen, final = lid.mixtures(loglik, first, rounds=12)
    for d in (0, 2):
        part = np.exp(loglik[first[d] : first[d + 1]])
        pi = np.full(3, 1 / 3)
        for _ in range(12):
            joint = part * pi
            pi = (joint / joint.sum(1, keepdims=True)).mean(0)
        assert share[d] == pytest.approx(pi)
        assert chosen[d, pi.argmax()] and final[d].sum() == pytest.approx(1) and not final[d][~chosen[d]].any()
    assert not share[1].any() and not final[1].any()
    # a row that stands three times is three rows
    times = rng.integers(1, 4, 37)
    spread = np.repeat(loglik, times, axis=0)
    at = np.concatenate([[0], np.cumsum([times[a:b].sum() for a, b in zip(first[:-1], first[1:])])])
    for a, b in zip(lid.mixtures(loglik, first, weight=times.astype(float)), lid.mixtures(spread, at)):
        assert a == pytest.approx(b)


def selected_by_force(loglik, penalty):
    """The best set of leading languages by penalised likelihood, with the shares of plain EM in it."""
    part = np.exp(loglik)
    k = part.shape[1]

    def em(pi, turns):
        for _ in range(turns):
            joint = part * pi
            pi = (joint / joint.sum(1, keepdims=True)).mean(0)
        return pi

    full = em(np.full(k, 1 / k), 12)
    order = np.argsort(-full, kind="stable")
    best = None
    for s in range(1, k + 1):
        start = np.zeros(k)
        start[order[:s]] = np.maximum(full[order[:s]], 1e-6)
        pi = em(start / start.sum(), 6) if s > 1 else (start > 0).astype(float)
        value = np.log(part @ pi).sum() - penalty * np.log(max(len(part), 2)) * (s - 1)
        if best is None or value > best[0]:
            best = (value, set(order[:s].tolist()), pi)
    return best[1], best[2]


def test_selection_matches_plain_loops():
    rng = np.random.default_rng(5)
    sizes = rng.integers(3, 60, 40)
    first = np.concatenate([[0], np.cumsum(sizes)])
    loglik = rng.normal(-12, 1, (int(sizes.sum()), 5))
    for d in range(40):  # some documents are of one language, some of two or three
        for row in range(first[d], first[d + 1]):
            loglik[row, rng.integers(0, 1 + d % 3)] += 4
    _, chosen, final = lid.mixtures(loglik, first, 2.0)
    for d in range(40):
        want, shares = selected_by_force(loglik[first[d] : first[d + 1]], 2.0)
        assert set(np.flatnonzero(chosen[d])) == want and final[d] == pytest.approx(shares, abs=1e-6)
    assert len(set(chosen.sum(axis=1))) > 1


def test_very_long_texts_and_many_languages(spark):
    rng = random.Random(6)
    vocabulary = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(25)] for k in range(130)}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    profiles = lid.fit_profiles(spark.createDataFrame([(say(x, 60), x) for x in vocabulary for _ in range(3)], "text string, lang string"))
    assert len(profiles.languages) == 130 and profiles.table.shape[1] == lid.buckets(130) < lid.BUCKETS and profiles.table.size <= lid.CELLS
    rows = [(k, say(x, 40)) for k, x in enumerate(vocabulary)] + [(1000, say("l005", 60_000)), (1001, say("l007", 30_000) + "  \n" + say("l100", 30_000))]
    got = {r["doc_id"]: r for r in lid.language_id(spark.createDataFrame(rows, "doc_id long, text string"), profiles).collect()}
    assert sum(got[k]["lang_pred"] == x for k, x in enumerate(vocabulary)) >= 125
    assert got[1000]["lang_pred"] == "l005" and set(got[1001]["languages"].split(",")) == {"l007", "l100"} and 0.4 < got[1001]["score"] < 0.6
    assert lid.buckets(4) == lid.BUCKETS and lid.buckets(10**6) == lid.LEAST_BUCKETS


def test_long_texts_are_judged_as_short_ones():
    rng = random.Random(7)
    text = pa.array([" ".join(rng.choice(["Der", "und", "les", "aux", "à", "x" * 30]) for _ in range(3000)) + "\t \nend"])
    profiles = lid.Profiles(["a", "b"], np.log(np.random.default_rng(1).random((2, lid.BUCKETS))).astype(np.float32))
    loglik, first = lid.word_likelihoods(profiles, text)
    profiles.__class__ = type("Small", (lid.Profiles,), {"slice_bytes": 500})
    rows, counts = lid.long_likelihoods(profiles, text)
    assert counts.sum() == len(loglik) and len(rows) < 100
    assert (rows * counts[:, None]).sum(axis=0) == pytest.approx(loglik.sum(axis=0), rel=1e-6)
    assert lid.mixtures(rows, np.array([0, len(rows)]), weight=counts)[2] == pytest.approx(lid.mixtures(loglik, first)[2], abs=1e-5)


def test_toxicity_held_out(spark):
    docs, labels = tables(spark)
    known = labels.where("toxic is not null")
    out = tox.toxicity(docs, labels, train_when=fold(4) != 2).join(known, "doc_id").where(fold(4) == 2).toPandas()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in out.score[out.toxic == 1] for b in out.score[out.toxic == 0]])
    assert auc > 0.75 and out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()


def test_toxicity_edges(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(300)}"
    rows = [(i, " ".join([word() for _ in range(30)] + (["idiotic"] if i % 2 else [])), "en") for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000, None, None), (1001, "", "en"), (1002, "idiotic " * 30000, "en"), (1002, "x", "en"), (None, "idiotic", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(300)] + [(None, 1, 1), (3, None, 1), (3, 0, 1)], "doc_id long, toxic int, quality int")
    got = tox.toxicity(docs, labels).collect()
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert len(got) == docs.count() and all(by[i] == i % 2 for i in range(300, 400)) and by[1000] == by[1001] == 0
    assert {r["score"] for r in tox.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert tox.toxicity(docs.limit(0), labels).count() == 0


def test_cutoffs_match_brute_force():
    """Every language's cutoff has the best F1 of all cutoffs; thin languages take the overall one."""
    rng = np.random.default_rng(8)
    language = rng.integers(0, 3, 3000)
    language[language == 2] = np.where(rng.random((language == 2).sum()) < 0.03, 2, 0)
    label = (rng.random(3000) < 0.3).astype(int)
    step = np.rint((rng.normal(0, 1, 3000) + 2 * label + language) * tox.LOGIT_STEPS).astype(int)
    cells, n = np.unique(np.stack([language, step, label], axis=1), axis=0, return_counts=True)
    net = tox.Network(*(np.zeros(1),) * 4, 0.0)
    tox.calibrate(net, np.column_stack([cells, n]), 3)

    def f1(cutoff, rows):
        hit = step[rows] / tox.LOGIT_STEPS > cutoff
        return 2 * (hit & (label[rows] == 1)).sum() / (hit.sum() + label[rows].sum())

    for k in range(2):
        rows = language == k
        best = max(f1(c / tox.LOGIT_STEPS - 1e-9, rows) for c in np.unique(step[rows]))
        assert f1(net.cutoffs[k], rows) == pytest.approx(best)
    every = np.ones(3000, bool)
    assert f1(net.cutoffs[2], every) == pytest.approx(max(f1(c / tox.LOGIT_STEPS - 1e-9, every) for c in np.unique(step)))
    scores = net.scores(np.array([net.cutoffs[0], net.cutoffs[0] + 1]), np.array([0, 0]))
    assert scores[0] == pytest.approx(tox.THRESHOLD) and scores[1] > tox.THRESHOLD


def test_the_sample_is_bounded_before_it_is_collected(spark):
    rows = [(i, "w " * 30, "en") for i in range(60)] + [(7, "again " * 30, "en"), (60, "long " * 5000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, label int")
    texts, y = tox._gather(docs, ids, 1000)
    assert sum(map(len, texts)) <= 1000 and len(texts) == len(y) == 33
    assert len(tox._gather(docs, ids, 10**6)[0]) == 61


def test_scores_match_the_network(spark):
    """The query's scores on sf0.01 against the network run over single texts."""
    docs, labels = tables(spark)
    kept = {}
    original = tox.calibrate

    def spy(net, bins, languages):
        original(net, bins, languages)
        kept["net"] = net

    tox.calibrate = spy
    try:
        got = {r["doc_id"]: r["score"] for r in tox.toxicity(docs, labels, train_when=fold(4) != 2).collect()}
    finally:
        tox.calibrate = original
    net = kept["net"]
    profiles = lid.fit_profiles(docs.where(fold(4) != 2))
    for r in docs.limit(150).collect():
        text = pa.array([r["text"]], pa.string())
        logit = np.clip(net.logits(*tox.word_ids(text)), -tox.LOGIT_END, tox.LOGIT_END)
        assert got[r["doc_id"]] == pytest.approx(net.scores(logit, tox.infer_language(profiles, text))[0], abs=1e-6)


def test_network_pools_as_defined():
    texts = [np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9]], np.int32), np.zeros((0, 3), np.int32), np.array([[1, 1, 1]], np.int32)]
    net = tox.train([*texts[:1], *texts[2:]] * 20, np.array([1, 0] * 20), epochs=1)
    x = [net.embedding[t].sum(axis=1) for t in texts]
    want = np.zeros((3, 24))
    for d in range(3):
        for w, j, column in net.blocks():
            if j == 0:
                i = tox.WIDTHS.index(w) * tox.FILTERS
                for p in range(len(x[d]) - w + 1):
                    value = sum(x[d][p + k] @ net.filters[:, column + k * tox.FILTERS : column + (k + 1) * tox.FILTERS] for k in range(w)) + net.bias[i : i + tox.FILTERS]
                    want[d, i : i + tox.FILTERS] = np.maximum(want[d, i : i + tox.FILTERS], value)
    got = net.pooled(np.concatenate(texts), np.array([0, 3, 3, 4]))
    assert got == pytest.approx(want, abs=1e-4)


def test_word_ids_share_stems():
    ids, first = tox.word_ids(pa.array(["Loweiung, loweient!", None]))
    assert first.tolist() == [0, 2, 2] and ids[0, 1] == ids[1, 1] and ids[0, 0] != ids[1, 0]


def test_quality_held_out(spark):
    docs, labels = tables(spark)
    out = qc.op10_quality_classifier(spark, DATA).join(labels, "doc_id").where("held_out").toPandas()
    assert ((out.predicted == 1) == (out.quality == 1)).mean() > 0.9 and out.score.between(0, 1).all()


def test_normal_equations_and_edges(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(("AB!!" if i % 4 == 0 else "word") + str(rng.randrange(50)) for _ in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (1002, "x " * 50000), (None, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in qc.quality_classifier(docs.repartition(7), labels).collect()}
    assert len(got) == 304 and sum(got[i]["predicted"] != (i % 4 != 0) for i in range(300)) <= 3
    assert {r["score"] for r in qc.quality_classifier(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in qc.quality_classifier(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert qc.quality_classifier(docs.limit(0), labels).count() == 0


def test_normal_equations_match_one_solve(spark):
    """Partition sums give the ridge regression of the whole table; scores are its calibrated values."""
    rng = np.random.default_rng(9)
    n = len(qc.features())
    x = rng.normal(0, 1, (400, n))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(int)
    train = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(400)], "doc_id long, x array<double>, label int").repartition(7)
    model = qc.fit(train, 64, 0.05, 1e-3, 11)
    fitted = {r["doc_id"] for r in train.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) != 0).collect()}
    mine = np.array(sorted(fitted))
    assert model.mean == pytest.approx(x.mean(axis=0)) and model.scale == pytest.approx(x.std(axis=0))
    z = np.hstack([model.project(x[mine]), np.ones((len(mine), 1))])
    penalty = np.eye(65) * 1e-3 * len(mine)
    penalty[-1, -1] = 0
    assert model.theta == pytest.approx(np.linalg.solve(z.T @ z + penalty, z.T @ y[mine]), abs=1e-8)
    kernel = model.project(x[:50]) @ model.project(x[:50]).T
    unit = np.clip((x[:50] - model.mean) / model.scale, -5, 5)
    exact = np.exp(-0.05 * ((unit[:, None] - unit[None]) ** 2).sum(-1))
    assert np.abs(kernel - exact).mean() < 0.15


def test_quality_clashing_columns_and_odd_labels(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7 + 3), i, "z", [1.0]) for i in range(60)], "doc_id long, text string, label int, blob string, x array<double>")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 5, 0), (41, 9, 0), (42, -1, 0)], "doc_id long, quality int, text int")
    rows = qc.quality_classifier(docs, labels).collect()
    assert len(rows) == 60 and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"] % 7, set()).add(r["score"])
    assert all(len(v) == 1 for v in by.values())


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(2)
    n, k = rng.integers(1, 9, 40), None
    k = rng.binomial(n, np.linspace(0.1, 0.9, 40))
    at, values = qc.isotonic(np.arange(40.0), n, k)
    assert (np.diff(values) > 0).all() and (np.diff(at) > 0).all()
    # max-min formula of isotonic regression
    mean = lambda i, j: k[i : j + 1].sum() / n[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(x, 40)) for i in range(x + 1)) for x in range(40)]
    assert sorted({round(v, 9) for v in want}) == [round(v, 9) for v in values]
