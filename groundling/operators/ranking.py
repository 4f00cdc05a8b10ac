"""Ranks within groups of any size: no task holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundling.session import materialise


def ranked(rows: DataFrame, group: str, order: str, name: str = "nth", slices: int | None = None) -> DataFrame:
    """``rows`` with a column ``name``: a row's number, from 1, by ``order`` among the rows of its ``group``.

    Rows are dealt over ``slices`` ranges of ``order``, whatever their group. A
    row's number is the number of the group's rows in earlier slices and its
    number in its own, so a group that holds most rows is ranked by as many
    tasks as there are slices. Rows of equal ``order`` lie in one slice; their
    sequence is any. A null group is a group. The slices are written, since a
    range exchange that runs again may cut elsewhere.
    """
    spark = rows.sparkSession
    n = slices or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialise(rows.repartitionByRange(n, order).withColumn("_slice", F.spark_partition_id()), "slices")
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    sizes = dealt.groupBy(F.col(group).alias("_group"), F.col("_slice").alias("_in")).agg(F.count("*").alias("_size"))
    before = sizes.withColumn(group, F.col("_group")).withColumn("_slice", F.col("_in")).select("_group", "_in", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(order))
    joined = dealt.withColumn("_own", own).join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_in")))
    return joined.select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))
