"""Text normalisation queries, over ``documents`` and the articles made of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.functions import text as tx
from groundling.functions.text import WS
from groundling.plans import inputs


def over(source: Callable, key: str, value: Callable[[], Column], **more: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that projects one expression over an input; no Column is made before a session is there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return source(spark, sf_dir).select(key, value().alias("value"), *(c().alias(k) for k, c in more.items()))

    return run


def _raw() -> Column:
    return tx.text("text")


def _md() -> Column:
    return tx.text("md")


#: Characters that some terminals and models leave in an output.
NOISY = "concat(chr(27), '[1;31m', replace({t}, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || chr(10)), chr(27), '[0m', chr(7), chr(127), '  ')"


def _noisy() -> Column:
    return F.expr(NOISY.format(t="coalesce(text, '')"))


THOUGHT = "case when doc_id % 3 = 0 then '<think>plan # a' || chr(10) || '# b</think> lead' || chr(10) when doc_id % 3 = 1 then 'preamble' || chr(10) || '  ' else '#' || chr(10) end || {t}"

QUERIES = {
    "normalise_space": over(inputs.documents, "doc_id", lambda: tx.normalise_space(_noisy())),
    "normalise_text": over(inputs.documents, "doc_id", lambda: tx.normalise_claim(_raw())),
    "clean_output": over(inputs.documents, "doc_id", lambda: tx.clean_output(_noisy())),
    "strip_thinking": lambda spark, d: inputs.documents(spark, d).select("doc_id", tx.strip_thinking(F.expr(THOUGHT.format(t=f"({inputs.ARTICLE})"))).alias("value")),
    "strip_placeholders": over(inputs.articles, "article_id", lambda: tx.strip_placeholders(_md())),
    "clean_text": over(inputs.articles, "article_id", lambda: tx.clean_text(_md())),
    "truncate_word": over(inputs.documents, "doc_id", lambda: tx.truncate_word(_raw(), 197), clipped=lambda: tx.clip_bytes(_raw(), 500), snippet=lambda: F.left(_raw(), F.lit(90))),
    "slugify": over(inputs.documents, "doc_id", lambda: tx.slugify(_raw())),
    "quote_yaml": over(inputs.documents, "doc_id", lambda: tx.quote_yaml(F.concat(_noisy(), F.lit(' "a\\b" ')))),
    "collapse_space": over(inputs.articles, "article_id", lambda: tx.collapse(_md())),
    "first_line": over(inputs.documents, "doc_id", lambda: tx.first_line(_noisy())),
    "extract_title": over(inputs.articles, "article_id", lambda: tx.extract_title(_md())),
    "trim_sentence": over(inputs.documents, "doc_id", lambda: tx.trim_sentence(_raw())),
}

_NOISE_SQL = NOISY.format(t="coalesce(text, '')")
_PREFIX = "coalesce(try(decode(encode(t)[1:{n}])), try(decode(encode(t)[1:{n}-1])), try(decode(encode(t)[1:{n}-2])), try(decode(encode(t)[1:{n}-3])))"


def words_sql(expr: str) -> str:
    """SQL for an expression's words joined by single spaces."""
    return f"array_to_string(list_filter(string_split_regex({expr}, '[{WS}]+'), lambda w: w <> ''), ' ')"


def strip_sql(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[{WS}]+|[{WS}]+$', '', 'g')"


ORACLE_SQL = {
    "normalise_space": rf"""
        select doc_id, {strip_sql(rf"regexp_replace(replace(replace({_NOISE_SQL}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{{4,}}', repeat(chr(10), 3), 'g')")} as value from documents""",
    "normalise_text": rf"""
        select doc_id, lower({words_sql("""replace(replace(replace(replace(coalesce(text, ''), '“', '"'), '”', '"'), '‘', ''''), '’', '''')""")}) as value from documents""",
    "clean_output": rf"""
        select doc_id, regexp_replace(regexp_replace({_NOISE_SQL}, '\x1b\[[0-?]*[ -/]*[@-~]', '', 'g'), '[\x00-\x08\x0B-\x1F]', '', 'g') as value from documents""",
    "strip_thinking": rf"""
        with {inputs.ARTICLES_SQL},
        a as (select article_id, string_split({THOUGHT.replace("doc_id", "article_id").format(t="md")}, '</think>') p from articles),
        b as (select article_id, p[len(p)] s, string_split(p[len(p)], chr(10)) l from a),
        c as (select article_id, s, l, list_position(list_transform(l, lambda x: starts_with({strip_sql("x")}, '# ')), true) k from b)
        select article_id as doc_id, {strip_sql("case when k > 0 then array_to_string(l[k:], chr(10)) else s end")} as value from c""",
    "strip_placeholders": rf"""
        with {inputs.ARTICLES_SQL}
        select article_id, regexp_replace(regexp_replace(regexp_replace(md, '(?i)\*\*\s*opening thesis paragraph\.?\s*\*\*\s*', '', 'g'),
            '(?m)^\*\*[ \t]*(?:\.{{2,}}|…)?[ \t]*\*\*[ \t]*\r?\n?', '', 'g'), '(?m)^#{{2,6}}[ \t]*(?:\.{{2,}}|…)[ \t]*\r?\n?', '', 'g') as value from articles""",
    "clean_text": rf"""
        with {inputs.ARTICLES_SQL}
        select article_id, {words_sql(r"replace(regexp_replace(regexp_replace(regexp_replace(md, '<[^>]*>', '', 'g'), '\[(.*?)\]\([^)]*\)', '\1', 'g'), '[*_`~]', '', 'g'), chr(13), '')")} as value from articles""",
    "truncate_word": f"""
        with d as (select doc_id, coalesce(text, '') t from documents)
        select doc_id, case when strlen(t) <= 197 then t when instr(substr({_PREFIX.format(n=197)}, 2), ' ') > 0 then regexp_extract({_PREFIX.format(n=197)}, '(?s)^(.+) ', 1) else {_PREFIX.format(n=197)} end as value,
        case when strlen(t) <= 500 then t else {_PREFIX.format(n=500)} end as clipped, left(t, 90) as snippet from d""",
    "slugify": """
        with s as (select doc_id, left(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '-'), 90) x from documents)
        select doc_id, case when trim(x, '-') = '' then 'untitled-article' else trim(x, '-') end as value from s""",
    "quote_yaml": rf"""
        with s as (select doc_id, regexp_replace(regexp_replace({_NOISE_SQL} || ' "a\b" ', '[\n\t\r]', ' ', 'g'), '[\x00-\x1F\x7F]', '', 'g') x from documents)
        select doc_id, '"' || {words_sql(r"""replace(replace(x, '\', '\\'), '"', '\"')""")} || '"' as value from s""",
    "collapse_space": f"with {inputs.ARTICLES_SQL} select article_id, {words_sql('md')} as value from articles",
    "first_line": f"with n as (select doc_id, {_NOISE_SQL} as t from documents) select doc_id, case when instr(t, chr(10)) > 0 then {strip_sql('substr(t, 1, instr(t, chr(10)) - 1)')} else t end as value from n",
    "extract_title": rf"""
        with {inputs.ARTICLES_SQL}
        select article_id, case when regexp_matches(md, '(?m)^#\s+(.+)$') then {strip_sql(r"regexp_extract(md, '(?m)^#\s+(.+)$', 1)")} else 'untitled-article' end as value from articles""",
    "trim_sentence": rf"""
        select doc_id, coalesce(regexp_extract(coalesce(text, ''), '(?s)^(.*[.!?"'')\]”’…»])(?:[{WS}]|$)', 1), '') as value from documents""",
}
