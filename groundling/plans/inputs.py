"""Articles, extraction outputs, claims and edits, derived from ``documents``.

The raw table holds neither Markdown nor claim records, so the queries work on
texts made of its rows. Each expression is SQL that Spark and DuckDB read
alike; the operators under test are not part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = "cast(doc_id as string)"
_T = "coalesce(text, '')"
_NL = "chr(10)"

ARTICLE = " || ".join(
    [
        "case when doc_id % 11 = 3 then '' else '# ' end",
        f"'Report ' || {_ID} || ' on AI models & Bank ledgers, part ' || coalesce(source, '')",
        f"{_NL} || {_NL}",
        f"case when doc_id % 3 = 0 then '**A bold thesis about agents no. ' || {_ID} || '**' || {_NL} || {_NL} else '' end",
        f"case when doc_id % 13 = 5 then '' else '<aside class=\"post-lead\"><p class=\"post-lead-tldr\"><strong>TL;DR.</strong> In short: ' || left({_T}, 90) || '</p></aside>' || {_NL} || {_NL} end",
        f"case when doc_id % 7 = 2 then '' else '> **Executive Summary**' || {_NL} || '> - Security audits found ' || {_ID} || ' cases.' || {_NL} || '> - *Models* improve, in [part](http://x.example).' || {_NL} || {_NL} end",
        f"case when doc_id % 5 = 1 then '' else '## Findings' || {_NL} || {_NL} end",
        f"case when doc_id % 6 = 4 then 'We leverage robust tools. Furthermore, it Leverages a seamless flow; UTILIZED daily.' || {_NL} || {_NL} else '' end",
        f"case when doc_id % 9 = 2 then 'Perplexity fell by 3.5 and the F1 rose to 91,000 bits per byte.' || {_NL} || {_NL} else '' end",
        "case when doc_id % 17 = 8 then '☀ \U0001f680 ' else '' end",
        f"case when doc_id % 19 = 7 then '## ...' || {_NL} || {_NL} || '**Opening thesis paragraph.** ' else '' end",
        f"replace({_T}, {_NL}, {_NL} || {_NL})",
        f"case when doc_id % 8 = 6 then {_NL} || {_NL} || replace({_T}, {_NL}, {_NL} || {_NL}) else '' end",
        f"case when doc_id % 4 = 0 then {_NL} || {_NL} || 'This demonstrates that ' || left({_T}, 110) || '. It proves 0.82 of ' || {_ID} else '' end",
    ]
)
_QUOTE = f"substr({_T}, cast(1 + doc_id % 50 as int), 40)"


def _upper(expr: str) -> str:
    return f"translate({expr}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


_RECORDS = {
    "c1": f"{_QUOTE} || case when doc_id % 7 = 1 then ' 42%' else '' end",
    "q1": f"case when doc_id % 9 = 4 then 'invented words that no source has' when doc_id % 11 = 5 then 'tiny' when doc_id % 13 = 6 then '' when doc_id % 5 = 2 then {_upper(_QUOTE)} else {_QUOTE} end",
    "t1": "case doc_id % 8 when 0 then 'metric' when 1 then 'Result ' when 2 then 'opinion' else 'method' end",
    "s1": "case doc_id % 6 when 0 then 'hedged' when 1 then 'Certain' when 2 then '' else 'demonstrated' end",
    "c3": f"'All of it: ' || replace({_T}, {_NL}, ' ')",
    "q3": f"replace({_T}, {_NL}, case when doc_id % 2 = 0 then ' ' else '  ' end)",
    "c2": f"'Fact: ' || substr({_T}, 5, 60)",
    "q2": f"substr({_T}, 5, 60)",
}


def _block(claim: str, quote: str, kind: str, strength: str) -> str:
    return f"'CLAIM: ' || {claim} || {_NL} || '  SOURCE_QUOTE: \"' || {quote} || '\"' || {_NL} || 'TYPE: ' || {kind} || {_NL} || 'STRENGTH: ' || {strength} || {_NL} || '---' || {_NL}"


EXTRACTION = (
    f"case when doc_id % 29 = 0 then 'NONE' when doc_id % 31 = 0 then 'NONE.' else case when doc_id % 10 = 3 then 'Here are the claims.' || {_NL} || '---' || {_NL} else '' end || "
    + _block(*(f"({_RECORDS[k]})" for k in ("c1", "q1", "t1", "s1")))
    + " || "
    + _block(f"({_RECORDS['c2']})", f"({_RECORDS['q2']})", "'result'", "'speculation-or-future-work'")
    + " || case when doc_id % 4 = 1 then "
    + _block(_upper(_RECORDS["c2"]), f"({_RECORDS['q2']})", "'result'", "'hedged'")
    + " else '' end || case when doc_id % 3 = 0 then "
    + _block(f"({_RECORDS['c3']})", f"({_RECORDS['q3']})", "'definition'", "'demonstrated'")
    + " else '' end end"
)
CLAIMS = {
    1: ("substr(" + _T + ", 1, 110)", "substr(" + _T + ", 1, 110)", "'result'", "case when doc_id % 3 = 0 then ' Hedged' else 'demonstrated' end"),
    2: ("case when doc_id % 2 = 0 then 'ppl fell by 3.5' else 'certain gains of 0.82' end", "'found 91,000 items in ' || cast(doc_id as string)", "'metric'", "'demonstrated'"),
    3: ("case when doc_id % 5 = 0 then " + _T + " else 'a short one' end", _T, "'limitation'", "case when doc_id % 2 = 0 then 'hedged' else '' end"),
}
EDITS = (
    "'<think>[x]</think> Edits: ' || '[{\"find\": \"' || left(regexp_replace(" + _T + ", '[^A-Za-z ]', ' ', 'g'), 30) || '\", \"replace\": \"Replaced opening\", \"reason\": \"' || "
    "case when doc_id % 7 = 3 then 'because' else 'generic' end || '\"}, {\"find\": \"' || case when doc_id % 5 = 1 then 'Report' else 'models & Bank' end || '\", \"replace\": \"models and banks\", \"reason\": \"filler\"}]' || "
    "case when doc_id % 13 = 1 then ' ] trailing' else ' done' end"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table; one in fewer files or row groups than there are cores is dealt out, any other is read as it lies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, md)"""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("article_id"), F.expr(ARTICLE).alias("md"))


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section_id, lang, source, raw): an extraction output and the section that it came from."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("section_id"), "lang", F.expr(_T).alias("source"), F.expr(EXTRACTION).alias("raw"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, ord, claim, source_quote, type, strength): the ledger of each article."""
    rows = F.array(*(F.struct(F.lit(n).alias("ord"), *(F.expr(x).alias(k) for k, x in zip(("claim", "source_quote", "type", "strength"), record, strict=True))) for n, record in CLAIMS.items()))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("article_id"), F.inline(rows))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, md, response): an article and a reviewer's answer."""
    response = EDITS.replace(", 'g')", ")")
    return documents(spark, sf_dir).select(F.col("doc_id").alias("article_id"), F.expr(ARTICLE).alias("md"), F.expr(response).alias("response"))


ARTICLES_SQL = f"articles as (select doc_id as article_id, {ARTICLE} as md from documents)"
EXTRACTIONS_SQL = f"extractions as (select doc_id as section_id, lang, {_T} as source, {EXTRACTION} as raw from documents)"
CLAIMS_SQL = "claims as (" + " union all ".join(f"select doc_id as article_id, {n} as ord, {r[0]} as claim, {r[1]} as source_quote, {r[2]} as type, {r[3]} as strength from documents" for n, r in CLAIMS.items()) + ")"
EDITS_SQL = f"edits as (select doc_id as article_id, {ARTICLE} as md, {EDITS} as response from documents)"
