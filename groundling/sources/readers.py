"""Sources: text, Markdown, word-processing and (where the tool is present) PDF files as rows.

Each file is one row (source_id, name, text, error); a file that cannot be
read has an error and an empty text, so that one bad file costs no other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.functions import text as tx
from groundling.operators.planning import ARTICLE_BYTES, SOURCE_BYTES
from groundling.sources import source_files as sf


def _opens(path: str) -> bool:
    """Whether workers can open a path themselves; stores that only Spark reads go through its own scan."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def source_files(spark: SparkSession, paths: str | list[str], limit: int = SOURCE_BYTES, partition_bytes: int = sf.PARTITION_BYTES, names: str = "*", shortest: int = 0, longest: int = 1 << 62) -> DataFrame:
    """(path, name, length, text, error) of the files under ``paths``, each scanned once; see :mod:`groundling.sources.source_files`.

    ``names`` (a shell pattern) and the lengths in bytes say which files are wanted.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if all(map(_opens, paths)):
        spark.dataSource.register(sf.SourceFiles)
        return spark.read.format("source_files").options(paths=json.dumps(paths), limit=limit, partitionBytes=partition_bytes, names=names, shortest=shortest, longest=longest).load()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(paths).where(F.col("length").between(shortest, longest))
    name = F.element_at(F.split("path", "/"), -1).alias("name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for file, content in zip(batch["name"], batch["content"], strict=True):
                text, error = "", ""
                try:
                    if not sf.known(file):
                        raise sf.Refused(f"unsupported file type: {sf.kind_of(file)}")
                    text = sf.extract(file, bytes(content), limit)
                except (sf.Refused, OSError) as failure:
                    error = str(failure).splitlines()[0]
                texts.append(text)
                errors.append(error)
            yield batch[["path", "name", "length"]].assign(text=texts, error=errors)

    fits = files.where(F.col("length") <= limit).select("path", name, "length", "content").mapInPandas(run, sf.SCHEMA)
    big = files.where(F.col("length") > limit).select("path", name, "length")  # its content is not read
    return fits.unionByName(big.select("path", "name", "length", F.lit("").alias("text"), F.format_string(f"%s is %d bytes; the limit is {limit}", "name", "length").alias("error")))


def read_sources(spark: SparkSession, paths: str | list[str], limit: int = SOURCE_BYTES) -> DataFrame:
    """(path, name, text, error) of all files under ``paths``; what is over ``limit`` bytes is refused unread."""
    return source_files(spark, paths, limit).select("path", "name", tx.normalise_space(F.col("text")).alias("text"), "error")


def outcome(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources (path, name, text, error) to work on, and one row (read, failed, error) about all of them.

    Sources that failed are passed over with their errors; only where none is
    left the row has an error itself.
    """
    failed = F.col("error") != ""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("name", "error")))), lambda x: x["error"]), "; ")
    counted = sources.agg(F.count_if(~failed).alias("read"), F.count_if(failed).alias("failed"), said.alias("all"))
    return sources.where(~failed), counted.select("read", "failed", F.when(F.col("read") == 0, F.concat(F.lit("no source could be read"), F.when(F.col("all") != "", F.concat(F.lit(": "), "all")).otherwise(""))).otherwise("").alias("error"))


def read_articles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Markdown articles, with the smaller limit that applies to them."""
    return read_sources(spark, paths, ARTICLE_BYTES)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON lines or CSV by the path's ending; text formats need a schema."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    kind = {"jsonl": "json", "ndjson": "json", "tsv": "csv"}.get(kind, kind)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        reader = reader.option("header", "true").option("sep", "\t" if path.endswith(".tsv") else ",")
    return reader.format(kind if kind in ("parquet", "orc", "json", "csv") else "parquet").load(path)
