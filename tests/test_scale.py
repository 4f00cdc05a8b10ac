"""Plans and batches whose work grows with the input and not with how often an expression is written out."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundling import registry
from groundling.functions import cutting, paragraphs, styling
from groundling.functions import vocabulary as v
from groundling.functions.wordlists import bounded, held
from groundling.plans import composing
from groundling.plans import generate as gen

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


@pytest.mark.parametrize(("name", "most"), [("new_violations", 2), ("violation_keys", 1)])
def test_rules_are_written_once_a_side(spark, name, most):
    assert plan(spark, name).count("missing post-lead aside") <= most


def test_gate_reviews_each_side_once(spark):
    assert plan(spark, "review_gate").count("MapInArrow") == 2


def test_shingles_stay_with_their_paragraph(spark):
    assert "Aggregate" not in plan(spark, "shingles")


@pytest.mark.parametrize(("name", "most"), [("review_violations", 5), ("rule_banned_phrases", 1)])
def test_articles_are_lower_cased_once(spark, name, most):
    assert plan(spark, name).count("lower(") <= most


@pytest.mark.parametrize("name", ["metric_conversion", "vocabulary_hits", "metric_forms"])
def test_terms_are_found_in_one_pass(spark, name):
    assert "ontains(low" not in plan(spark, name)


@pytest.mark.parametrize("name", ["edit_spans", "apply_edits"])
def test_answers_are_parsed_once_a_branch(spark, name):
    assert plan(spark, name).count("parseJson") <= {"edit_spans": 1, "apply_edits": 2}[name]


def test_words_of_a_list(spark):
    texts = [None, "", "a robust, robust realm; game-changers unlocked", "foster_ robusts xrealm realm9 game-changer-realm éfoster fostered", "paradigm shift"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    regex = F.array_distinct(F.regexp_extract_all("t", F.lit(r"(?<![0-9A-Za-z_])(?:" + "|".join(v.banned_forms()) + r")(?![0-9A-Za-z_])"), F.lit(0)))
    rows = frame.select(bounded(F.col("t"), v.banned_forms()).alias("got"), F.coalesce(regex, F.array().cast("array<string>")).alias("want"), held(F.col("t"), ["shift", "paradigm", "realm", "real"]).alias("held")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert [r["held"] for r in rows] == [[], [], ["realm", "real"], ["realm", "real"], ["shift", "paradigm"]]


def test_texts_of_a_batch_are_read_one_at_a_time():
    batch = pa.array(["alpha beta alpha", "bank ledgers", ""])
    assert [b.to_pylist() for b in paragraphs.term_lists(iter([batch]), 8)] == [[["alpha", "beta"], ["bank", "ledgers"], []]]
    assert [b.to_pylist() for b in paragraphs.category_names(iter([batch]))] == [["Technology", "Finance", "Technology"]]
    assert [b.to_pylist() for b in styling.repair_all(iter([pa.array(["Furthermore, a realm"])]))] == [["Also, a area"]]


def test_sections_of_a_batch_leave_in_parts():
    texts = ["", *(chr(97 + k) * 1_500_000 for k in range(9)), ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array(texts)], ["k", "body"])
    out = list(cutting.section_batches(iter([batch]), cutting.cut_part))
    assert len(out) == 3 and "".join(x for b in out for x in b.column("body").to_pylist()) == "".join(texts)
    assert [k for b in out for k, at in zip(b.column("k").to_pylist(), b.column("at").to_pylist(), strict=True) if at == 0] == list(range(1, 10))


def test_sources_are_cut_once_and_articles_checked_once_a_turn(spark, monkeypatch):
    read, checked = spark.sparkContext.accumulator(0), []

    def text(k):
        read.add(1)
        return f"Some facts of {k} words that one source states plainly and fully here. More of it."

    monkeypatch.setattr(composing, "faithfulness", lambda *a, f=composing.faithfulness: checked.append(1) or f(*a))
    sources = spark.range(1, 4).select(F.col("id").alias("source_id"), F.lit("a").alias("name"), F.udf(text)("id").alias("text"))
    rows = composing.compose_articles(sources, [gen.fake_generator], retries=1).collect()
    assert [r["sections"] for r in rows] == [1, 1, 1] and all("article is" in r["house"] for r in rows)
    assert read.value == 3 and len(checked) == 2


def test_columns_go_past_the_generator(spark):
    asked = spark.createDataFrame([(1, "p", [1, 2]), (2, None, None)], "key int, prompt string, more array<int>")
    rows = sorted(gen.with_fallback(asked, "key", "x", [lambda kind, texts: [t.upper() for t in texts]], ["more"]).collect())
    assert [tuple(r) for r in rows] == [(1, "P", "", 0, [1, 2]), (2, "", "", 0, None)]


def test_folded_letters_keep_their_place():
    assert [cutting.lower(t) for t in ("AΣİß", "ABC", "ẞİx")] == ["aσiß", "abc", "ßix"]
    assert cutting.sectioner(["Abstract"], ["references"], "\n ")("a\nREFERENCEſ\nb") == ["a"] and styling.repair("A ſeamleſs realm") == styling.repair("A seamless realm")


def test_ledgers_are_parsed_once_and_meet_their_source_in_the_row(spark):
    text = plan(spark, "resume_verify")
    assert text.count("Generate ") == 2 and "CoGroup" not in text


def test_no_output_is_cut_in_blocks_by_a_filter(spark):
    assert "Filter ((size(" not in plan(spark, "resume_verify")


def test_front_matter_needs_no_join_and_one_worker(spark):
    text = plan(spark, "render_front")
    assert "Join" not in text and text.count("ArrowEvalPython") == 1 and plan(spark, "extract_metadata").count("ArrowEvalPython") == 1


def test_terms_and_categories_of_marked_texts():
    low = "the <b>bank</b>s and [model_ card](http://audit.example) of *ledgers*, ledgers; bankers\r\nre-audit ſecurity gemma2 aid"
    assert paragraphs.terms(low, 9) == ["ledgers", "banks", "model", "card", "bankers", "re-audit", "ſecurity", "gemma2"]
    for text in (low, "", "ai", "xai ai_ said", "security dora", "banks bank finance model agents agentic", "cryptoaudit audit"):
        words = re.findall("[0-9a-z_]+", text.replace("ſ", "s"))
        counts = {name: sum(bool(re.fullmatch(pattern, w)) for w in words) for name, pattern in v.CATEGORIES.items()}
        assert paragraphs.category(text) == (max(counts, key=counts.get) if any(counts.values()) else "Technology")
    both = pa.array(["model"]), pa.array(["a bank, a bank. <i>words</i>"])
    assert [b.to_pylist() for b in paragraphs.topics(iter([both]), 8)] == [[{"category": "Finance", "heading": ["model"], "body": ["bank", "words"]}]]
