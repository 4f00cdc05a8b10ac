"""Repair of an article: style, echoes of the calibration text, the whole normalisation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.functions import styling
from groundling.functions import text as tx
from groundling.functions import vocabulary as v
from groundling.operators.normalise import strip_sql, words_sql
from groundling.plans import inputs

ECHO_BYTES = 40


def enforce_style(md: Column) -> Column:
    """Banned phrases (longest first), then every form of the banned words, replaced one after the other."""
    def repair(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from styling.repair_all(texts)

    return F.arrow_udf(repair, "string")(md)


def normalise_article(md: Column) -> Column:
    """Placeholders, terminal noise and reasoning removed, style repaired."""
    return enforce_style(tx.strip_thinking(tx.clean_output(tx.strip_placeholders(md))))


def strip_echo(articles: DataFrame, calibration: DataFrame) -> DataFrame:
    """``articles`` (article_id, md) without paragraphs that stand in their calibration text (article_id, style)."""
    sample = calibration.select("article_id", tx.collapse(tx.text("style")).alias("sample"))
    joined = articles.join(sample, "article_id", "left")
    echo = lambda b: (F.octet_length(tx.collapse(b)) >= ECHO_BYTES) & ~F.startswith(tx.strip(b), F.lit("#")) & F.contains("sample", tx.collapse(b))
    kept = F.array_join(F.filter(F.split(tx.text("md"), "\n\n"), lambda b: ~echo(b)), "\n\n")
    short = F.coalesce(F.octet_length("sample") < ECHO_BYTES, F.lit(True))
    return joined.select("article_id", F.when(short, F.col("md")).otherwise(kept).alias("md"))


#: The calibration text of an article: its first paragraphs, wrapped anew, or something short.
STYLE = "case when doc_id % 9 = 1 then 'short' else 'Sample: ' || replace(left(coalesce(text, ''), 900), ' ', chr(10)) end"


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.documents(spark, sf_dir).select(F.col("doc_id").alias("article_id"), F.expr(STYLE).alias("style"))


QUERIES = {
    "enforce_style": lambda s, d: inputs.articles(s, d).select("article_id", enforce_style(tx.text("md")).alias("value")),
    "normalise_article": lambda s, d: inputs.articles(s, d).select("article_id", normalise_article(tx.text("md")).alias("value")),
    "strip_echo": lambda s, d: strip_echo(inputs.articles(s, d), _calibration(s, d)),
}


def _styled_sql(expr: str) -> str:
    """Nested replacements, each once for a capital and once for a small first letter."""
    for term, to, bounded in v.style_passes():
        rest = tx.quoted(term[1:]).replace("'", "''").replace("-", "\\-")
        edge = r"\b" if bounded else ""
        capital, to = to[0].upper() + to[1:], to.replace("'", "''")
        expr = f"regexp_replace(regexp_replace({expr}, '{edge}{term[0].upper()}(?i:{rest}){edge}', '{capital}', 'g'), '{edge}{term[0]}(?i:{rest}){edge}', '{to}', 'g')"
    return expr


_A = f"with {inputs.ARTICLES_SQL}"
_STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(md, '(?i)\*\*\s*opening thesis paragraph\.?\s*\*\*\s*', '', 'g'), '(?m)^\*\*[ \t]*(?:\.{2,}|…)?[ \t]*\*\*[ \t]*\r?\n?', '', 'g'), '(?m)^#{2,6}[ \t]*(?:\.{2,}|…)[ \t]*\r?\n?', '', 'g')"""
_CLEANED = rf"regexp_replace(regexp_replace({_STRIPPED}, '\x1b\[[0-?]*[ -/]*[@-~]', '', 'g'), '[\x00-\x08\x0B-\x1F]', '', 'g')"
ORACLE_SQL = {
    "normalise_article": f"""{_A}, c as (select article_id, string_split({_CLEANED}, '</think>')[-1] as s from articles),
        l as (select article_id, s, string_split(s, chr(10)) l from c),
        k as (select article_id, s, l, list_position(list_transform(l, lambda x: starts_with({strip_sql("x")}, '# ')), true) k from l),
        t as (select article_id, {strip_sql("case when k > 0 then array_to_string(l[k:], chr(10)) else s end")} as md from k)
        select article_id, {_styled_sql("md")} as value from t""",
    "enforce_style": f"{_A} select article_id, {_styled_sql('md')} as value from articles",
    "strip_echo": f"""{_A}, c as (select doc_id as article_id, {words_sql(STYLE)} as sample from documents)
        select article_id, case when strlen(sample) < 40 then md else array_to_string(list_filter(string_split(md, chr(10) || chr(10)), lambda b: not (strlen({words_sql("b")}) >= 40
            and not starts_with({strip_sql("b")}, '#') and contains(sample, {words_sql("b")}))), chr(10) || chr(10)) end as md from articles join c using (article_id)""",
}
