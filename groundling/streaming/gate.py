"""Rules and verification on Structured Streaming frames.

The column functions are the batch ones: a streaming frame runs them as it
is. Only the removal of repeated claims keeps state, and a watermark bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundling.functions import text as tx
from groundling.functions.text import SP
from groundling.operators import claims, rules


def house_errors_stream(articles: DataFrame) -> DataFrame:
    """A stream of (article_id, md, ...) with ``errors``, stateless."""
    return articles.withColumn("errors", rules.house_errors(tx.text("md")))


def verified_claims_stream(extractions: DataFrame) -> DataFrame:
    """A stream of records with their ``reason``, from (section_id, source, raw, ts)."""
    return claims.verify(claims.parse(extractions, "ts"))


def distinct_claims_stream(records: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each claim text once while its watermark lasts: records that are later than ``late`` may repeat one."""
    key = tx.lower(tx.strip(tx.sub(F.col("claim"), rf"[{SP}]+", " ")))
    return records.withColumn("claim_key", key).withWatermark("ts", late).dropDuplicatesWithinWatermark(["claim_key"]).drop("claim_key")


def violation_counts_stream(articles: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """How often each message's kind breaks in each window of event time (ts)."""
    kind = F.regexp_replace(F.col("error"), ":.*|[0-9]+", "")
    each = house_errors_stream(articles).withWatermark("ts", late).select("ts", F.explode("errors").alias("error"))
    return each.groupBy(F.window("ts", width), kind.alias("kind")).agg(F.count("*").alias("n"))


def start(frame: DataFrame, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Write a stream to Parquet; the checkpoint makes it restart where it stopped."""
    return frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).options(**options).outputMode("append").start()
