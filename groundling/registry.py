"""Query names, their builders and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundling.operators import claims, edits, faithfulness, metadata, normalise, planning, repair, rules, running, sections, streams
from groundling.plans import composing

_MODULES = [normalise, sections, claims, rules, faithfulness, repair, edits, metadata, planning, running, streams, composing]


def _widened(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its int columns as bigint, which is what SQL counts and places are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(spark, sf_dir)
        return out.withColumns({c: out[c].cast("bigint") for c, kind in out.dtypes if kind == "int"})

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _widened(build) for module in _MODULES for name, build in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
