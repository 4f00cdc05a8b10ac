import random

import pytest

import corpus_pipeline as cp
from groundling.llm.decontamination import decontaminate
from groundling.llm.language_id import fit_profiles, language_id, training_rows
from groundling.llm.near_dedup import near_duplicates
from groundling.llm.quality_rules import quality_rules
from groundling.session import materialise

DATA = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language ID", "quality rules", "near-duplicates", "decontamination", "packing"]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    first = materialise(stages["language ID"](spark, docs, DATA))
    judged = language_id(docs, fit_profiles(training_rows(docs)))
    assert first.columns == docs.columns and ids(first) == ids(judged.where("lang_pred != 'und' and score >= 0.3"))
    second = materialise(stages["quality rules"](spark, first, DATA))
    assert second.columns == docs.columns and ids(second) == ids(quality_rules(first, labels).where("kept"))
    third = materialise(stages["near-duplicates"](spark, second, DATA))
    assert third.columns == docs.columns and ids(third) == ids(near_duplicates(second).where("doc_id = group_id"))
    fourth = materialise(stages["decontamination"](spark, third, DATA))
    leaks = {r["doc_id"] for r in decontaminate(third, items).collect()}
    assert fourth.columns == docs.columns and ids(fourth) == [d for d in ids(third) if d not in leaks]
    packed = stages["packing"](spark, fourth, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(ids(fourth))
    assert len(cp.run(spark, DATA).collect()) == len(packed)


def test_odd_rows_pass_every_stage(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(f"word{rng.randrange(5000)}" for _ in range(n))
    same, long = text(60), text(40_000)
    rows = [(1, same), (2, same), (2, same), (3, same), (4, None), (5, ""), (6, long), (7, long), (None, text(40)), (None, None), (8, "1 2 3"), (9, text(50))]
    docs = spark.createDataFrame([(i, t, "en", None, None, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, c0 string, lang_pred int, share double")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        kept = materialise(stage(spark, kept, DATA))
        assert kept.columns == docs.columns, name
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 6, 9]
    packed = cp.packing(spark, kept, DATA)
    assert sum(r["length"] for r in packed.where("doc_id = 6").collect()) > 40_000
    empty = docs.limit(0)
    for name, stage in cp.STAGES[:-1]:
        empty = stage(spark, empty, DATA)
        assert empty.count() == 0, name


@pytest.mark.parametrize("name", ["language ID", "quality rules", "near-duplicates", "decontamination"])
def test_stages_leave_the_order_of_columns(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text", "doc_id", "source", "lang", "n_chars").limit(30)
    assert dict(cp.STAGES)[name](spark, docs, DATA).columns == ["text", "doc_id", "source", "lang", "n_chars"]
