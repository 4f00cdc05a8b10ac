"""Sectioning: reference matter dropped, headings kept, sections capped in bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundling.functions import cutting
from groundling.functions import text as tx
from groundling.functions.text import SP
from groundling.operators.normalise import strip_sql
from groundling.plans import inputs

# Headings at which a paper is split, and those that end it.
HEADINGS = ["Abstract", "Introduction", "Related Work", "Method", "Methods", "Experiments", "Results", "Discussion", "Limitations", "Conclusion", "References"]
STOPS = ["references", "bibliography", "acknowledgments", "acknowledgements", "appendix"]

_STOP = rf"^[{SP}]*(?:#{{1,6}}[{SP}]+)?(?:{'|'.join(STOPS)})(?![0-9A-Za-z_])"


def drop_references(c: Column) -> Column:
    """Normalised text before the last heading of reference matter."""
    c = tx.normalise_space(c)
    return F.when(F.regexp_like(c, F.lit(rf"(?dmiu){_STOP}")), tx.strip(F.regexp_extract(c, rf"(?dmius)\A(.*){_STOP}", 1))).otherwise(c)


def split_headings(c: Column) -> Column:
    """Parts that begin with a known heading; the line feed before it goes."""
    names = "|".join(HEADINGS)
    return F.filter(F.split(c, rf"\n(?=(?:{names})(?![0-9A-Za-z_]))"), lambda x: x != "")


def split_sections(sources: DataFrame, key: str, name: Column, body: Column) -> DataFrame:
    """One row per section: key, section (int, from 1), label, body. Texts without content have none.

    A text is read once: what :func:`drop_references` and
    :func:`split_headings` do, and the cut in bytes, are one pass of the worker.
    """
    rows = sources.select(key, name.alias("name"), body.alias("body"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("at", T.IntegerType()), T.StructField("body", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cutting.section_batches(batches, cutting.sectioner(HEADINGS, STOPS, "\t\n\f\r "))

    cut = rows.mapInArrow(run, schema)
    return cut.select(key, (F.col("at") + 1).alias("section"), F.concat("name", F.lit(" section "), (F.col("at") + 1).cast("string")).alias("label"), "body")


#: A paper made of an article: headings in front of some paragraphs, references at the end.
PAPER = (
    "'Contents' || chr(10) || 'References' || chr(10) || 'Abstract' || chr(10) || {md} || chr(10) || 'Methods' || chr(10) || left({md}, 400) || chr(10) || 'Methodology' || chr(10) "
    "|| 'Results and more' || chr(13) || chr(10) || {md} || case when {id} % 3 = 1 then chr(10) || '  ## Acknowledgments' || chr(10) || 'To all.' when {id} % 3 = 2 then chr(10) || 'BIBLIOGRAPHY' || chr(10) || '[1] x' else '' end"
)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.articles(spark, sf_dir).select("article_id", F.expr(PAPER.format(md="md", id="article_id")).alias("paper"))


PAPERS_SQL = f"{inputs.ARTICLES_SQL}, papers as (select article_id, {PAPER.format(md='md', id='article_id')} as paper from articles)"

QUERIES = {
    "drop_references": lambda spark, d: papers(spark, d).select("article_id", drop_references(tx.text("paper")).alias("value")),
    "split_headings": lambda spark, d: papers(spark, d).select("article_id", F.posexplode(split_headings(tx.normalise_space(tx.text("paper")))).alias("at", "part")),
    "split_sections": lambda spark, d: split_sections(papers(spark, d), "article_id", F.format_string("paper %d", "article_id"), tx.text("paper")),
    "dry_run_plan": lambda spark, d: dry_run(papers(spark, d)),
}


def dry_run(sources: DataFrame) -> DataFrame:
    """Sections and model calls of each job: one call a section and one to write, one alone where a ledger is kept."""
    ledger = F.col("article_id") % 10 == 0
    counted = split_sections(sources, "article_id", F.lit("s"), tx.text("paper")).groupBy("article_id").agg(F.count("*").alias("sections"))
    return counted.select("article_id", "sections", ledger.alias("ledger_found"), F.when(ledger, F.lit(1)).otherwise(F.col("sections") + 1).cast("long").alias("calls"))


_NORM = rf"""{strip_sql(r"regexp_replace(regexp_replace(paper, '\r\n?', chr(10), 'g'), '\n{4,}', repeat(chr(10), 3), 'g')")}"""
_DROPPED = rf"""
    {PAPERS_SQL}, norm as (select article_id, {_NORM} as t from papers),
    lines as (select article_id, t, string_split(t, chr(10)) l from norm),
    marked as (select article_id, t, l, list_last(list_filter(range(1, len(l) + 1), lambda k: regexp_matches(l[k], '(?i)^\s*(?:#{{1,6}}\s+)?(?:{'|'.join(STOPS)})\b'))) k from lines),
    dropped as (select article_id, case when k is null then t else {strip_sql("array_to_string(l[1:k-1], chr(10))")} end as t from marked)"""
_NAMES = "|".join(HEADINGS)
_SPLIT = rf"list_filter(string_split(regexp_replace(t, '\n((?:{_NAMES})\b)', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '')"
_HEAD = "coalesce(try(decode(encode(rest)[1:4500])), try(decode(encode(rest)[1:4499])), try(decode(encode(rest)[1:4498])), try(decode(encode(rest)[1:4497])))"
_SECTIONS = rf"""
    with recursive {_DROPPED},
    parts as (select article_id, unnest({_SPLIT}) part, generate_subscripts({_SPLIT}, 1) pn from dropped),
    steps as (
        select article_id, pn, 0 as k, '' as body, {strip_sql("part")} as rest from parts
        union all
        select article_id, pn, k + 1, {strip_sql("head")}, {strip_sql("substr(rest, length(head) + 1)")} from (
            select *, case when strlen(rest) <= 4500 then rest when strlen(blank) >= 2250 then blank when strlen(dot) >= 2250 then dot else h end as head from (
                select *, regexp_extract(h, '(?s)^(.*)\n\n', 1) as blank, regexp_extract(h, '(?s)^(.*)\. ', 1) as dot from (
                    select article_id, pn, k, rest, {_HEAD} as h from steps where rest <> '')))),
    sections as (select article_id, row_number() over (partition by article_id order by pn, k) as section, body from steps where k > 0 and body <> '')"""
ORACLE_SQL = {
    "drop_references": f"with {_DROPPED} select article_id, t as value from dropped",
    "split_headings": f"with {PAPERS_SQL}, norm as (select article_id, {_NORM} as t from papers) select article_id, unnest({_SPLIT}) as part, generate_subscripts({_SPLIT}, 1) - 1 as at from norm",
    "split_sections": f"{_SECTIONS} select article_id, section, 'paper ' || article_id || ' section ' || section as label, body from sections",
    "dry_run_plan": f"{_SECTIONS} select article_id, count(*) as sections, article_id % 10 = 0 as ledger_found, case when article_id % 10 = 0 then 1 else count(*) + 1 end as calls from sections group by article_id",
}
