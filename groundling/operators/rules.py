"""House rules: ordered predicates on an article, each with its message."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.functions import text as tx
from groundling.functions import vocabulary as v
from groundling.functions.text import SP
from groundling.functions.wordlists import bounded, held
from groundling.plans import inputs

# Markers that the writer's template emits.
ASIDE, SUMMARY, H1 = '<aside class="post-lead"', "Executive Summary", "# "
PLACEHOLDER = r"^(?:#{1,6}[ \t]*(?:\.{2,}|…)[ \t]*$|\*\*[ \t]*(?:\.{2,}|…)[ \t]*\*\*|\*\*opening thesis paragraph)"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"

def banned_words(low: Column) -> Column:
    """Distinct banned forms of a lower-cased article in order of first appearance."""
    return bounded(low, v.banned_forms())


def banned_phrases(low: Column) -> Column:
    """Banned phrases that a lower-cased article holds, in the list's order."""
    return held(low, v.BANNED_PHRASES)


def _has_placeholder(md: Column) -> Column:
    might = reduce(or_, (F.contains(md, F.lit(x)) for x in ("..", "…", "**o", "**O")))
    return might & F.regexp_like(md, F.lit(f"(?dmiu){PLACEHOLDER}"))


def _has_h2(md: Column) -> Column:
    return F.contains(md, F.lit("##")) & F.regexp_like(md, F.lit(rf"(?dm)^##[{SP}]+.+$"))


def _bounds(n: Column) -> Column:
    message = lambda bound, limit: F.concat(F.lit("article is "), n.cast("string"), F.lit(f" words; {bound} is {limit}"))
    return F.when(n < v.MIN_WORDS, message("minimum", v.MIN_WORDS)).when(n > v.MAX_WORDS, message("maximum", v.MAX_WORDS))


def _listed(title: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"contains banned {title}: "), F.array_join(items, ", ")))


#: Each rule reads an article and its lower case.
RULES = {
    "rule_h1": lambda md, low: F.when(~F.startswith(md, F.lit(H1)), "body-only mode must start with a Markdown H1"),
    "aside": lambda md, low: F.when(~F.contains(md, F.lit(ASIDE)), "missing post-lead aside"),
    "summary": lambda md, low: F.when(~F.contains(md, F.lit(SUMMARY)), "missing Executive Summary"),
    "rule_h2": lambda md, low: F.when(~_has_h2(md), "missing section headings"),
    "rule_placeholder": lambda md, low: F.when(_has_placeholder(md), "contains an unfilled skeleton placeholder (title, heading, or thesis)"),
    "rule_length": lambda md, low: _bounds(tx.word_count(md)),
    "rule_emoji": lambda md, low: F.when(F.regexp_like(md, F.lit(EMOJI)), "contains emoji"),
    "rule_banned_words": lambda md, low: _listed("words", banned_words(low)),
    "rule_banned_phrases": lambda md, low: _listed("phrases", banned_phrases(low)),
}


def house_errors(md: Column, low: Column | None = None) -> Column:
    """Messages of all broken rules, in the rules' order; empty if the article may be published.

    ``low`` is the lower-cased article where a caller has it as a column.
    """
    low = tx.lower(md) if low is None else low
    return F.array_compact(F.array(*(rule(md, low) for rule in RULES.values())))


def article_errors(articles: DataFrame) -> DataFrame:
    """(article_id, errors): :func:`house_errors` of articles (article_id, md); every article is lower-cased once."""
    low = articles.select("article_id", tx.text("md").alias("md")).withColumn("low", tx.lower(F.col("md")))
    return low.select("article_id", house_errors(F.col("md"), F.col("low")).alias("errors"))


def looks_like_article(md: Column) -> Column:
    return F.startswith(md, F.lit(H1)) & _has_h2(md)


def _project(**columns):
    return lambda spark, d: inputs.articles(spark, d).select("article_id", *(c.alias(k) for k, c in ((k, f(tx.text("md"))) for k, f in columns.items())))


def _one(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        low = inputs.articles(spark, d).select("article_id", tx.text("md").alias("md")).withColumn("low", tx.lower(F.col("md")))
        return low.select("article_id", F.coalesce(RULES[name](F.col("md"), F.col("low")), F.lit("")).alias("message"))

    return run


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return article_errors(inputs.articles(spark, d)).select("article_id", F.array_join("errors", "\n").alias("errors"), F.size("errors").cast("long").alias("n"))


QUERIES = {
    "rule_h1": _one("rule_h1"),
    "rule_structure": _project(aside=lambda md: F.coalesce(RULES["aside"](md, md), F.lit("")), summary=lambda md: F.coalesce(RULES["summary"](md, md), F.lit(""))),
    **{name: _one(name) for name in ("rule_h2", "rule_placeholder", "rule_length", "rule_emoji", "rule_banned_words", "rule_banned_phrases")},
    "word_count": _project(words=lambda md: tx.word_count(md).cast("long")),
    "house_errors": _errors,
    "looks_like_article": _project(value=looks_like_article),
    "ends_sentence": _project(value=lambda md: tx.ends_sentence(tx.right_trim(md))),
}


def _sql(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'"


_BANNED_RE2 = "|".join(f.replace("-", r"\-") for f in v.banned_forms())
_WORDS = rf"regexp_extract_all(lower(md), '\b(?:{_BANNED_RE2})\b')"
_ORDERED = f"list_filter({_WORDS}, lambda x, i: list_position({_WORDS}, x) = i)"
_PHRASES = f"list_filter([{', '.join(map(_sql, v.BANNED_PHRASES))}], lambda p: contains(lower(md), p))"
_COUNT = r"len(regexp_extract_all(md, '[\p{L}\p{N}]+'))"
MESSAGES = {
    "rule_h1": "case when not starts_with(md, '# ') then 'body-only mode must start with a Markdown H1' else '' end",
    "aside": """case when instr(md, '<aside class="post-lead"') = 0 then 'missing post-lead aside' else '' end""",
    "summary": "case when instr(md, 'Executive Summary') = 0 then 'missing Executive Summary' else '' end",
    "rule_h2": r"case when not regexp_matches(md, '(?m)^##\s+.+$') then 'missing section headings' else '' end",
    "rule_placeholder": f"case when regexp_matches(md, '(?mi){PLACEHOLDER}') then 'contains an unfilled skeleton placeholder (title, heading, or thesis)' else '' end",
    "rule_length": f"case when {_COUNT} < 500 then 'article is ' || {_COUNT} || ' words; minimum is 500' when {_COUNT} > 3000 then 'article is ' || {_COUNT} || ' words; maximum is 3000' else '' end",
    "rule_emoji": f"case when regexp_matches(md, '{EMOJI}') then 'contains emoji' else '' end",
    "rule_banned_words": f"case when len({_WORDS}) > 0 then 'contains banned words: ' || array_to_string({_ORDERED}, ', ') else '' end",
    "rule_banned_phrases": f"case when len({_PHRASES}) > 0 then 'contains banned phrases: ' || array_to_string({_PHRASES}, ', ') else '' end",
}
_A = f"with {inputs.ARTICLES_SQL}"
_ERRORS = f"list_filter([{', '.join(MESSAGES.values())}], lambda m: m <> '')"
ORACLE_SQL = {
    **{name: f"{_A} select article_id, {MESSAGES[name]} as message from articles" for name in QUERIES if name in MESSAGES},
    "rule_structure": f"{_A} select article_id, {MESSAGES['aside']} as aside, {MESSAGES['summary']} as summary from articles",
    "word_count": f"{_A} select article_id, {_COUNT} as words from articles",
    "house_errors": f"{_A} select article_id, array_to_string({_ERRORS}, chr(10)) as errors, len({_ERRORS}) as n from articles",
    "looks_like_article": rf"{_A} select article_id, starts_with(md, '# ') and regexp_matches(md, '(?m)^##\s+.+$') as value from articles",
    "ends_sentence": rf"{_A}, t as (select article_id, regexp_replace(md, '[ \t\r\n]+$', '') x from articles) select article_id, ends_with(x, '---') or contains('.!?)]”’…»' || chr(34) || chr(39), right(x, 1)) and x <> '' as value from t",
}
