"""Sinks: article sets, failures, JSON-lines summaries, and atomic files on the driver."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.functions import text as tx
from groundling.operators import metadata as md
from groundling.operators.planning import summary_lines, unique_stems
from groundling.operators.rules import looks_like_article
from groundling.session import discard, materialise

ENDINGS = {"source": "-body.md", "yaml": "-frontmatter.yaml", "final": "-final.md"}


def article_set(articles: DataFrame, day: str, site: md.Site | None = None, taken: DataFrame | None = None) -> DataFrame:
    """(article_id, folder, name, content): body, front matter and final document of each article, under one stem that is none of ``taken`` (stem)."""
    date = F.to_date(F.lit(day))
    body = articles.select("article_id", tx.strip(md.split_front(tx.text("md"))[1]).alias("md"))
    stems = unique_stems(body, F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("-"), tx.slugify(tx.extract_title(F.col("md")))), taken)
    fronts = md.render(body, site or md.Site(), date)
    joined = body.join(stems, "article_id").join(fronts, "article_id")
    file = lambda folder, ending, content: F.struct(F.lit(folder).alias("folder"), F.concat("stem", F.lit(ending)).alias("name"), content.alias("content"))
    files = F.array(file("source", ENDINGS["source"], F.concat("md", F.lit("\n"))), file("yaml", ENDINGS["yaml"], F.concat("front", F.lit("\n"))), file("final", ENDINGS["final"], F.concat(md.combine_front(F.col("front"), F.col("md")), F.lit("\n"))))
    return joined.select("article_id", F.inline(files))


LOG, SETS = "_published", "sets"


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """A path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def published(spark: SparkSession, path: str) -> list[dict]:
    """What was published under ``path``, in order: number, day, sets (folder)."""
    place, system = _folder(spark, f"{path}/{LOG}")
    if not system.exists(place):
        return []
    names = sorted(f.getPath().getName() for f in system.listStatus(place) if f.getPath().getName().endswith(".json"))
    if not names:
        return []
    lines = spark.read.schema("number long, day string, sets string").json([f"{path}/{LOG}/{n}" for n in names]).collect()  # a line a job
    return sorted((r.asDict() for r in lines), key=lambda r: r["number"])


def publish(spark: SparkSession, path: str, number: int, day: str, sets: str) -> bool:
    """Make a job's sets visible as entry ``number``; False if another job has that number.

    The entry is written aside and put in its place by one step that fails if
    the place is taken: a link on a local file system, a rename on others.
    """
    target, system = _folder(spark, f"{path}/{LOG}/{number:020d}.json")
    aside, _ = _folder(spark, f"{path}/{LOG}/.{sets}.tmp")
    stream = system.create(aside, True)
    stream.write(bytearray(json.dumps({"number": number, "day": day, "sets": sets}).encode()))
    stream.close()
    try:
        if system.getUri().getScheme() != "file":
            return not system.exists(target) and system.rename(aside, target)
        local = [p.toUri().getPath() for p in (aside, target)]
        try:
            os.link(*local)
        except FileExistsError:
            return False
        return True
    finally:
        system.delete(aside, False)


def read_article_sets(spark: SparkSession, path: str, entries: list[dict] | None = None) -> DataFrame:
    """(article_id, name, content, day, folder) of all published sets."""
    entries = published(spark, path) if entries is None else entries
    if not entries:
        return spark.createDataFrame([], "article_id long, name string, content string, day string, folder string")
    read = spark.read.option("basePath", f"{path}/{SETS}").parquet(*(f"{path}/{SETS}/job={e['sets']}" for e in entries))
    return read.withColumn("day", F.col("day").cast("string")).drop("job")


def _stems(files: DataFrame, day: str) -> DataFrame:
    ending = "|".join(re.escape(e) for e in ENDINGS.values())
    return files.where(F.col("day") == day).select(F.regexp_replace("name", f"(?:{ending})$", "").alias("stem")).distinct()


def write_article_set(articles: DataFrame, path: str, day: str, site: md.Site | None = None) -> int:
    """Publish the sets of all articles under ``path``, all or none; the number of the entry.

    The files are written to a folder that nobody reads, and one entry in the
    log makes them visible: whoever comes second finds the number taken, looks
    at what the first has published, and takes other stems if they share one.
    What was published before keeps its names: a stem that any of a day's sets
    has moves all three files of a new one to the next free number.
    """
    spark = articles.sparkSession
    seen = published(spark, path)
    while True:
        taken = materialise(_stems(read_article_sets(spark, path, seen), day), "stems") if seen else None
        sets = uuid.uuid4().hex
        staged = f"{path}/{SETS}/job={sets}"
        done = False
        try:
            article_set(articles, day, site, taken).withColumn("day", F.lit(day)).write.partitionBy("day", "folder").parquet(staged)
            clash = False
            while not clash and not done:
                number = seen[-1]["number"] + 1 if seen else 0
                done = publish(spark, path, number, day, sets)
                if not done:
                    newer = [e for e in published(spark, path) if e["number"] >= number]
                    seen += newer
                    other = [e for e in newer if e["day"] == day]
                    own = _stems(read_article_sets(spark, path, [{"sets": sets}]), day)
                    clash = bool(other) and not _stems(read_article_sets(spark, path, other), day).join(own, "stem").isEmpty()
            if done:
                return number
        finally:
            if taken is not None:
                discard(taken)
            if not done:
                place, system = _folder(spark, staged)
                system.delete(place, True)


def split_failures(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed outputs (article_id, md), and those of them that look like an article and are worth a review."""
    return outputs, outputs.where(looks_like_article(tx.text("md")))


def write_summaries(jobs: DataFrame, path: str) -> None:
    """One JSON object a job and line."""
    summary_lines(jobs).select("line").write.mode("overwrite").text(path)


def write_atomically(files: dict[str, bytes], mode: int = 0o644) -> None:
    """Local files of the driver, all staged before the first is put in place."""
    staged: list[tuple[str, str]] = []
    try:
        for path, content in files.items():
            handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".staged-")
            staged.append((temporary, path))
            with os.fdopen(handle, "wb") as out:
                out.write(content)
                out.flush()
                os.fsync(out.fileno())
            os.chmod(temporary, mode)
        for temporary, path in staged:
            os.replace(temporary, path)
    finally:
        for temporary, _ in staged:
            if os.path.exists(temporary):
                os.unlink(temporary)
