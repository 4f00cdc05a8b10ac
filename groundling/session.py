"""The shared scratch folder and what is written there.

A job's intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``: every executor sees it, so a lost executor costs a
re-read and never a wrong or missing result. Where that setting is unset, a
local temporary folder stands in for a local master (tests, a laptop); any
other master is refused, as its executors would write to disks of their own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: list[str] = []
_WRITTEN: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="groundling-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder once and return the table read back.

    Later steps read the table, so the shuffle files that led to it go with the
    write's end and not whenever the driver next looks for what is unused.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._groundling_path = path
    _WRITTEN.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that no later plan reads."""
    path = getattr(df, "_groundling_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        _WRITTEN[:] = [other for other in _WRITTEN if other is not df]


def written() -> list[DataFrame]:
    """Tables of :func:`materialise` that are not deleted yet."""
    return list(_WRITTEN)


def sweep(keep: list[DataFrame] | None = None) -> int:
    """Delete all tables of :func:`materialise` that are left but ``keep``, once results that read them are saved; how many there were."""
    left = [df for df in _WRITTEN if not any(df is other for other in keep or [])]
    for df in left:
        discard(df)
    return len(left)
