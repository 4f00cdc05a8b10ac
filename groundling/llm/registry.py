"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from groundling.llm import bpe, collocations, decontamination, language_id, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, spelling, token_counts, toxicity, url_filter

_MODULES = [token_counts, decontamination, packing, near_dedup, lm_scoring, language_id, url_filter, toxicity, quality_rules, quality_classifier, bpe, collocations, spelling]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: build for module in _MODULES for name, build in module.QUERIES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
