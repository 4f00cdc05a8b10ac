"""Joins on a key that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is dealt over several tasks; so there are fewer such keys than this.
SHARE = 200


def spread_join(rows: DataFrame, values: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``values`` (few rows for a key), so that no key of ``rows`` is one task's.

    A key that holds more than a ``SHARE``-th of all rows is dealt by the hash
    of the row's other columns over as many salts as it has such shares, and
    its values are repeated for each salt. There are at most ``SHARE`` such
    keys and twice as many repetitions, whatever the tables' size. ``counts``
    (key columns and ``n``) says how many rows a key has where that is known;
    ``total`` how many there are. ``rows`` is read twice: pass a written table.
    """
    total = rows.count() if total is None else total
    limit = max(total // SHARE, 50)
    counts = rows.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts
    keyed = counts.where(F.col("n") > limit).select(*on, (F.floor(F.col("n") / limit) + 1).cast("int").alias("_salts"))
    hot = keyed.collect()  # at most SHARE rows
    if not hot:
        return rows.join(values, on, how)
    known = F.broadcast(rows.sparkSession.createDataFrame(hot, keyed.schema))
    others = [F.col(c) for c in rows.columns if c not in on] or [F.lit(0)]
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(known, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*others), salts).cast("int")).drop("_salts")
    spread = values.join(known, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(spread, [*on, "_salt"], how).drop("_salt")
