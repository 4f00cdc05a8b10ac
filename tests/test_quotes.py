"""All quotes of a source in one pass, against ``in``."""

from __future__ import annotations

import random

from groundling.functions import quotes as q
from groundling.operators import claims as cl


def test_quotes_of_one_source():
    assert q.quotes_of("abcabc", ["", "abc", "bca", "cab", "x", "abcabcx"]) == ["abc", "bca", "cab"]
    assert q.quotes_of("", ["a"]) == [] and q.quotes_of("a" * 50_000, ["a" * k for k in (1, 3, 49_999, 50_001)]) and q.quotes_of("x", []) == []


def test_against_in(spark):
    rng = random.Random(1)
    texts = {k: "".join(rng.choices("ab é\n", k=400)) for k in range(6)}
    asked = [(k, texts[j][a : a + rng.randrange(1, 9)]) for k in range(8) for j in range(6) for a in rng.sample(range(390), 40)]
    asked += [(0, ""), (0, None), (None, "a"), (1, texts[1]), (1, texts[1])]
    sources = spark.createDataFrame([*texts.items(), (None, "a"), (7, None)], "k int, plain string")
    quotes = spark.createDataFrame(asked, "k int, quote string")
    want = {(k, t) for k, t in asked if t and k in texts and t in texts[k]}
    for per_task in (20_000, 7):  # and a source whose quotes are dealt over many tasks
        got = [tuple(r) for r in q.quotes_found(sources, quotes, "k", per_task).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert q.quotes_found(sources, quotes.limit(0), "k").count() == 0


def test_resume_says_what_plain_verification_says(spark):
    quote = "the measured rate rose to 12 percent in the trial"
    block = lambda c, s: f'CLAIM: {c}\nSOURCE_QUOTE: "{s}"\nTYPE: metric\nSTRENGTH: demonstrated\n---\n'
    raw = "# Ledger\n" + block("rate is 12", quote) + block("rate is 13", quote) + block("gone", "words that the source never had at all") + block("short", "tiny")
    saved = [(1, raw), (2, raw), (3, "NONE"), (4, raw)]
    sources = [(1, f"We saw that THE measured\n rate rose to 12 percent in the trial."), (2, "another source"), (3, "x")]
    ledgers, now = spark.createDataFrame(saved, "section_id int, raw string"), spark.createDataFrame(sources, "section_id int, source string")
    columns = ["section_id", "ord", *cl.FIELDS, "reason"]
    got = sorted(map(tuple, cl.resume_against(ledgers, now).select(*columns).collect()))
    want = sorted(map(tuple, cl.resume(ledgers.join(now, "section_id")).select(*columns).collect()), key=lambda r: r[:2])
    assert got == want and [r[-1] is None for r in got if r[0] == 1] == [True, False, False, False] and not any(r[0] == 4 for r in got)


def test_held_with_few_and_many_quotes():
    texts, quotes = ["abc", "xbc y"], ["", "bc", "bc x", "c y", "abcx", "abc", "q", "c"]
    want = [False, True, False, True, False, True, False, True]
    assert len(quotes) == q.FEW_QUOTES and q.held(texts, quotes) == want and q.held(texts, quotes + quotes) == want + want and q.held([], quotes) == [False] * 8


def test_several_sources_of_a_section(spark):
    raw = "".join(f'CLAIM: {text}\nSOURCE_QUOTE: "{text}"\n---\n' for text in ["stands in the first one", "Stands  in the second one", "stands in neither of them"])
    now = spark.createDataFrame([(1, "It stands in the first one."), (1, "It stands in the SECOND one."), (1, None)], "section_id int, source string")
    rows = sorted(cl.resume_against(spark.createDataFrame([(1, raw), (2, raw), (1, None)], "section_id int, raw string"), now).select("ord", "reason").collect())
    assert [tuple(r) for r in rows] == [(0, None), (1, None), (2, "quote not found in source")]


def test_quotes_that_end_on_dangling_words(spark):
    ends = {"a measured rate which": True, "a measured rate WHICH \n": True, "a measured ratewhich": False, "a measured rate_a": False, "a measured rate a": True, "a measured rate,": True, "a measured rate of it": False}
    records = spark.createDataFrame([(k, "c", k, "", "", k) for k in ends], "k string, claim string, source_quote string, type string, strength string, source string")
    assert {r["k"]: r["reason"] == "quote is a truncated fragment" for r in cl.verify(records).collect()} == ends
