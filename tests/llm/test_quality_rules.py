import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundling.llm import textkernel as tk
from groundling.llm.docstats import slice_stats
from groundling.llm import quality_rules as qr
from groundling.llm.quality_rules import RULES, binomial_upper, choose_cutoffs, quality_rules

import pyarrow as pa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 5))
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(hit), "n_lines": len(lines), "n_distinct": len(set(words))}


TEXT = st.text(alphabet="ab #\n\té 漢!", max_size=120)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_stats_match_brute_force(texts):
    got = slice_stats(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        for name, value in brute(text).items():
            assert got[name][i] == value, (name, text)


def test_hash_of_very_long_words():
    long = "x" * (tk._HASH_SPAN * 2 + 17)
    raw, off = tk.utf8(pa.array([f"a {long} b", f"{long} {long}", f"y{long}"]))
    w = tk.Words(raw, off)
    h = tk.hash_spans(raw, w.start, w.end)
    assert h[1] == h[3] == h[4] and len(set(h.tolist())) == 4


def test_binomial_bound_is_exact():
    assert binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert binomial_upper(5, 100, 0.05) == pytest.approx(0.10225, abs=1e-4)
    assert binomial_upper(3, 3, 0.05) == 1


def test_no_cutoff_without_proof():
    assert choose_cutoffs({}, {0: 50}, 0.05, 0.05) == {}


def test_the_most_lenient_useful_cutoff_is_chosen():
    rule = RULES[0]
    grid = rule.grid()
    good = [0] * 60 + [50] * (len(grid) - 60)
    bad = [0] * 10 + [5] * 20 + [9] * (len(grid) - 30)
    chosen = choose_cutoffs({(rule.name, 1): good}, {1: 10_000}, 0.05, 0.05, {(r.name, 1): bad if r is rule else [0] * (r.steps + 1) for r in RULES})
    assert chosen == {(rule.name, 1): grid[30]}
    assert choose_cutoffs({(rule.name, 1): good}, {1: 10_000}, 0.05, 0.05)[rule.name, 1] == grid[59 if binomial_upper(50, 10_000, 0.05 / 32) > 0.05 / 8 else -1]


def test_edge_rows_and_verdicts(spark):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 9973}" for k in range(20)), "x") for i in range(10_000)]
    bad = [(20_000 + i, " ".join(f"wo{k}r{i % 50} %%%" for k in range(20)), "x") for i in range(50)]
    odd = [(30_000, None, None), (30_001, "", "x"), (30_002, "few words", "x"), (None, "a b c", "x"), (30_003, good[0][1], "x"), (30_003, good[0][1], "x")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9_000)] + [(None, 1, 1), (5, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules(docs, labels).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == docs.count() and len(by[30_003]) == 2
    assert all(not by[i][0]["kept"] and by[i][0]["base_failed"] for i in (30_000, 30_001, 30_002, None))
    lost = sum(not by[i][0]["kept"] for i in range(10_000))
    assert lost <= 500
    assert all(by[20_000 + i][0]["rule"] == "symbol_ratio" for i in range(50))
    empty = quality_rules(docs.limit(0), labels.limit(0))
    assert empty.count() == 0
    assert quality_rules(docs, labels.limit(0)).where("kept").count() == 10_052


def test_beta_tail_matches_sums():
    for n in (1, 7, 60, 400):
        for k in sorted({0, 1, n // 9, n // 2, n - 1}):
            for p in (1e-6, 0.003, 0.05, 0.5, 0.97):
                want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                assert qr.binomial_tail(k, n, p) == pytest.approx(min(want, 1.0), rel=1e-9, abs=1e-12), (k, n, p)
    for n in (50, 1031, 20_000):
        most = qr.most_rejections(n, 0.00625, 0.05 / 32)
        assert most == max([k for k in range(int(n * 0.00625) + 1) if binomial_upper(k, n, 0.05 / 32) <= 0.00625], default=-1)
    assert qr.most_rejections(qr.least_trials(0.00625, 0.05 / 32), 0.00625, 0.05 / 32) == 0
    assert qr.most_rejections(qr.least_trials(0.00625, 0.05 / 32) - 1, 0.00625, 0.05 / 32) == -1
    assert qr.most_rejections(10**9, 0.00625, 0.05 / 32) == pytest.approx(6.25e6, rel=0.01)


def test_strata_join_neighbours():
    assert qr.joined_strata({0: 150, 1: 3000, 2: 3000, 3: 272}, 0.05, 0.05) == {0: 0, 1: 0, 2: 2, 3: 2}
    assert qr.joined_strata(dict.fromkeys(range(4), 2000), 0.05, 0.05) == {k: k for k in range(4)}
    assert set(qr.joined_strata({}, 0.05, 0.05).values()) == {0}


def test_false_rejection_is_bounded_in_simulation():
    """Good documents with a long upper tail: over many labelled samples, cutoffs that break the promise are rarer than delta."""
    rng = np.random.default_rng(4)
    rule = RULES[0]
    grid = np.array(rule.grid())
    broken, found = 0, 0
    for _ in range(300):
        values = np.minimum(rng.exponential(0.08, 1500), 1.0)
        rejected = [(values > cutoff).sum() for cutoff in grid]
        got = choose_cutoffs({(rule.name, 0): rejected}, {0: 1500}, 0.05, 0.05)
        if (rule.name, 0) in got:
            found += 1
            broken += math.exp(-got[rule.name, 0] / 0.08) > 0.05 / len(RULES)
    assert found > 250 and broken <= 0.05 * 300


def test_copies_prove_nothing(spark):
    """60 good texts prove no cutoff, however often they are repeated or labelled under other ids."""
    rng = random.Random(9)
    text = lambda: " ".join(f"word{rng.randrange(900)}" for _ in range(30))
    texts = [text() for _ in range(60)]
    rows = [(i, texts[i]) for i in range(60) for _ in range(15)] + [(1000 + 60 * k + i, texts[i]) for k in range(20) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in {r[0] for r in rows}], "doc_id long, quality int")
    assert qr.trials(qr.document_stats(docs), labels).count() == 60
    assert qr.fit_cutoffs(qr.document_stats(docs), labels, 0.05, 0.05) == {}
    # an id with two texts is one trial, a text with two labels counts as bad
    twice = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[2])], "doc_id long, text string")
    some = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 7)], "doc_id long, quality int")
    assert sorted(r["label"] for r in qr.trials(qr.document_stats(twice), some).collect()) == [0, 1]


def test_verdicts_match_brute_force(spark):
    """The whole query on sf0.1's labels against cutoffs found by plain loops over documents."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality_rules(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1)}
    stats = dict(zip(texts, np.stack(list(slice_stats(pa.array(list(texts.values()))).values()), axis=1).tolist()))
    name = {k: i for i, k in enumerate(qr.COUNTS)}

    def ratios(d):
        c = {k: stats[d][i] for k, i in name.items()}
        w, letters = max(c["n_words"], 1), max(c["n_letters"], 1)
        return [c["n_symbols"] / w, c["n_bang"] / w, c["n_upper"] / letters, c["n_dup_lines"] / max(c["n_lines"], 1), c["n_repeat_words"] / w, c["n_digits"] / max(c["word_chars"], 1), c["word_chars"] / w, c["n_distinct"] / w]

    base = {d: stats[d][name["n_words"]] < 10 or 100 * stats[d][name["n_repeat_words"]] > 20 * stats[d][name["n_words"]] for d in texts}
    by_text = {}
    for d in marks:
        if d in texts and not base[d]:
            by_text[texts[d]] = min(marks[d], by_text.get(texts[d], 1))
    one = {texts[d]: d for d in texts}
    stratum = lambda d: sum(stats[d][name["n_words"]] >= x for x in qr.STRATA[1:])
    totals = {}
    for t, label in by_text.items():
        totals[stratum(one[t])] = totals.get(stratum(one[t]), 0) + label
    proof = qr.joined_strata(totals, 0.05, 0.05)
    rejects = lambda rule, value, cutoff: value > cutoff + 1e-9 * (rule.high - rule.low) if rule.above else value < cutoff - 1e-9 * (rule.high - rule.low)
    cutoffs = {}
    for to in set(proof.values()):
        mine = [(one[t], label) for t, label in by_text.items() if proof[stratum(one[t])] == to]
        n = sum(label for _, label in mine)
        for i, rule in enumerate(RULES):
            best = 0
            for cutoff in rule.grid():
                hits = [label for d, label in mine if rejects(rule, ratios(d)[i], cutoff)]
                if binomial_upper(sum(hits), n, 0.05 / 32) > 0.05 / 8:
                    break
                if len(hits) - sum(hits) > best:
                    cutoffs[rule.name, to], best = cutoff, len(hits) - sum(hits)
    assert cutoffs
    wrong = 0
    for d in texts:
        kept = not base[d] and not any(rejects(rule, ratios(d)[i], cutoffs[rule.name, proof[stratum(d)]]) for i, rule in enumerate(RULES) if (rule.name, proof[stratum(d)]) in cutoffs)
        wrong += kept != got[d]["kept"]
    assert wrong == 0
