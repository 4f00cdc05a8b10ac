"""A training corpus from ``documents``: five stages, each of one operator.

Every stage works on all that its predecessor kept. All but the last return
the columns of ``documents``; each result is written as Parquet to the shared
folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundling.llm.decontamination import keep_clean
from groundling.llm.language_id import fit_profiles, keep_known_language, training_rows
from groundling.llm.near_dedup import keep_one
from groundling.llm.packing import pack
from groundling.llm.quality_rules import keep_good
from groundling.session import discard, materialise, sweep, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without a letter go, and those of which no language has a share of 0.3."""
    return keep_known_language(docs, fit_profiles(training_rows(docs)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, placed in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [("language ID", language), ("quality rules", quality), ("near-duplicates", deduplicate), ("decontamination", decontaminate), ("packing", packing)]

#: Mixtures, mined cutoffs and tokenizers are no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = written()
        kept = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            kept = materialise(kept, f"stage{k}")
            discard(docs)  # does nothing to the input table
            sweep([*before, kept])  # what the stage wrote on its way
        docs = kept
    return docs
