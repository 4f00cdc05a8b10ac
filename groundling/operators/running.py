"""Around a run: sources by name, engine chains, clocks and paths, files that are processed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.functions import text as tx
from groundling.functions import vocabulary as v
from groundling.functions.wordlists import held
from groundling.operators import metadata as md
from groundling.operators.edits import review_violations
from groundling.operators.faithfulness import sql_errors
from groundling.operators.normalise import strip_sql
from groundling.operators.planning import human_duration
from groundling.operators.rules import _ERRORS
from groundling.plans import inputs

AUTO, LOCAL = "auto", "local"
#: Settings that name an engine, by the kind of request; the first serves kinds without one of their own.
SETTINGS = {"any": "engine", "extract": "extract_engine", "write": "write_engine", "edit": "edit_engine"}


def clock(seconds: Column) -> Column:
    """Minutes and seconds of a running time; none below zero."""
    s = F.greatest(F.floor(seconds).cast("long"), F.lit(0))
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)


def short_path(path: Column, home: Column) -> Column:
    """A path with the home folder as ``~``."""
    return F.when((home != "") & F.startswith(path, home), F.concat(F.lit("~"), F.substring(path, F.length(home) + 1, F.length(path)))).otherwise(path)


def resolve_sources(asked: DataFrame, existing: DataFrame, home: str, folder: str) -> DataFrame:
    """(id, arg, path, error) of sources asked for by name (id, arg), among the paths that exist (path).

    ``~`` is ``home``; a relative name is looked for as it is and then in ``folder``.
    """
    arg = F.col("arg")
    expanded = F.when(arg == "~", F.lit(home)).when(F.startswith(arg, F.lit("~/")), F.concat(F.lit(home + "/"), F.substring(arg, 3, 1 << 20))).otherwise(arg)
    named = asked.withColumn("first", expanded)
    each = F.when(F.startswith("first", F.lit("/")), F.array("first")).otherwise(F.array("first", F.concat(F.lit(folder + "/"), "first")))
    spread = named.select("id", F.posexplode(each).alias("turn", "path"))
    found = spread.join(existing.select("path").distinct(), "path").groupBy("id").agg(F.min(F.struct("turn", "path")).alias("best"))
    out = asked.join(found, "id", "left")
    return out.select("id", "arg", F.coalesce("best.path", F.lit("")).alias("path"), F.when(F.col("best").isNull(), F.concat(F.lit("research file not found: "), "arg")).otherwise("").alias("error"))


def engine_name(kind: Column, settings: dict[str, Column]) -> Column:
    """The engine that is set for a kind of request, or the one for all."""
    out = settings["engine"]
    for name, setting in SETTINGS.items():
        if name != "any":
            out = F.when((kind == name) & (tx.strip(settings[setting]) != ""), settings[setting]).otherwise(out)
    return out


def engine_chain(name: Column, providers: list[tuple[str, bool]], installed: Column, experimental: Column) -> Column:
    """Engines to try, in order: the local one alone, a provider and then the local one, or all that are installed.

    ``providers`` are (name, whether it is experimental) in order of preference.
    """
    each = [F.when(F.array_contains(installed, p) & (experimental | F.lit(not trial)), p) for p, trial in providers]
    every = F.concat(F.array_compact(F.array(*each)), F.array(F.lit(LOCAL)))
    known = name.isin(*(p for p, _ in providers))
    return F.when(name.isin(AUTO, ""), every).when(known, F.array(name, F.lit(LOCAL))).otherwise(F.array(F.lit(LOCAL)))


def engine_error(settings: dict[str, Column], providers: list[tuple[str, bool]]) -> Column:
    """What is wrong with the first setting that names no engine; empty if all do."""
    names = [p for p, _ in providers]
    out = F.lit("")
    for setting in reversed(SETTINGS.values()):
        wrong = ~settings[setting].isin(AUTO, LOCAL, "", *names)
        out = F.when(wrong, F.concat(F.lit(f'{setting}: unknown engine "'), settings[setting], F.lit(f'" (want {AUTO}, {LOCAL}, or one of: {", ".join(names)})'))).otherwise(out)
    return out


def saved_review(front: Column, body: Column) -> Column:
    """What is written back after a review: the body under its own front matter, with one line feed at its end."""
    return F.when(front != "", md.combine_front(front, body)).otherwise(F.concat(F.regexp_replace(body, r"\n+\z", ""), F.lit("\n")))


def file_identity(path: Column, day: Column) -> dict[str, Column]:
    """Names and permalink of an article file that is processed again.

    A date before the file's stem stands over ``day``, the rest is the slug;
    inputs in ``source`` or ``final`` go to the sibling folders, others stay.
    """
    base = F.regexp_extract(path, r"([^/]*)\z", 1)
    folder = F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)
    stem = F.regexp_replace(base, r"\.[^.]*\z", "")
    for ending in ("body", "final", "frontmatter"):
        stem = F.regexp_replace(stem, rf"-{ending}\z", "")
    dated = F.regexp_like(stem, F.lit(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}-"))
    own_day = F.when(dated, F.left(stem, F.lit(10)).try_cast("date"))
    rest = F.when(dated, F.substring(stem, 12, 1 << 20)).otherwise(stem)
    in_set = F.regexp_like(folder, F.lit(r"(?:\A|/)(?:source|final)\z"))
    parent = F.regexp_replace(folder, r"/?(?:source|final)\z", "")
    home = F.when(parent == "", F.lit("")).otherwise(F.concat(parent, F.lit("/")))
    place = lambda name: F.when(in_set, F.concat(home, F.lit(name + "/"))).when(folder == "", F.lit("")).otherwise(F.concat(folder, F.lit("/")))
    made = {name: F.concat(place(at), stem, F.lit(ending)) for name, at, ending in (("body_path", "source", "-body.md"), ("front_path", "yaml", "-frontmatter.yaml"), ("final_path", "final", "-final.md"))}
    return made | {"date": F.coalesce(own_day, day), "slug": F.when(rest == "", F.lit("")).otherwise(tx.slugify(rest)), "is_front": F.regexp_like(base, F.lit(r"(?i)\.ya?ml\z"))}


def process_files(files: DataFrame, day: Column, site: md.Site | None = None) -> DataFrame:
    """Article files (article_id, path, md, adjacent) as their three files: paths, body, front, final and error.

    ``adjacent`` is the front matter that stands beside the article (null:
    none); its fields survive, those of the article's own block before them.
    Processing what was processed gives the same again.
    """
    front, body = md.split_front(tx.text("md"))
    kind = file_identity(F.col("path"), day)
    rows = files.select("article_id", "path", front.alias("own"), tx.strip(body).alias("body"), tx.text("adjacent").alias("adjacent"), *(c.alias(n) for n, c in kind.items()))
    error = F.when(F.col("is_front"), F.concat("path", F.lit(" is a frontmatter file, not an article body"))).when(F.col("body") == "", F.concat(F.lit("no article body found in "), "path")).otherwise("")
    rows = rows.withColumn("error", error)
    meta = md.extract_metadata(rows.select("article_id", F.col("body").alias("md"))).drop("slug")
    joined = rows.join(meta, "article_id")
    slug = F.when(F.col("slug") == "", tx.slugify(F.col("title"))).otherwise(F.col("slug"))
    fields = md.merge_fields(md.parse_fields(F.col("adjacent")), md.parse_fields(F.col("own")))
    told = F.struct("title", "subtitle", "description", "excerpt", "keywords", "tags", "category", slug.alias("slug"))
    joined = joined.select(*rows.columns, told.alias("meta"), fields.alias("existing"))
    made = joined.withColumn("front", md.render_front(site or md.Site(), F.col("date"), F.col("meta"), F.col("existing")))
    good = lambda c: F.when(F.col("error") == "", c).otherwise("")
    return made.select("article_id", "error", *(good(F.col(c)).alias(c) for c in ("body_path", "front_path", "final_path")), good(F.date_format("date", "yyyy-MM-dd")).alias("date"), good(F.col("slug")).alias("slug"), good(F.concat("body", F.lit("\n"))).alias("body"), good(F.concat("front", F.lit("\n"))).alias("front"), good(F.concat(md.combine_front(F.col("front"), F.col("body")), F.lit("\n"))).alias("final"))


#: Engines of the queries.
_PROVIDERS = [("hosted", False), ("second", False), ("trial", True)]
_PICK = "case ({n}) % 7 when 0 then '' when 1 then 'auto' when 2 then 'local' when 3 then 'hosted' when 4 then 'trial' when 5 then 'hostd' else 'second' end"
_KIND = "case event_id % 4 when 0 then 'extract' when 1 then 'write' when 2 then 'edit' else 'title' end"
_SET = {"engine": _PICK.format(n="event_id"), "extract_engine": _PICK.format(n="event_id + user_id"), "write_engine": _PICK.format(n="event_id * 3 + 1"), "edit_engine": _PICK.format(n="user_id")}
_ARG = "case doc_id % 6 when 0 then '~' when 1 then '~/papers/' || doc_id || '.pdf' when 2 then '/in/' || doc_id || '.md' when 3 then doc_id || '.txt' when 4 then 'sub/' || doc_id || '.txt' else '~x/' || doc_id end"
_EXISTS = "case doc_id % 9 when 0 then '/home/me' when 1 then '/home/me/papers/' || doc_id || '.pdf' when 2 then '/in/' || doc_id || '.md' when 3 then '/sources/' || doc_id || '.txt' when 4 then 'sub/' || doc_id || '.txt' else doc_id || '.txt' end"
_PATHS = "case article_id % 7 when 0 then '/out/2024-01-02-some-title.md' when 1 then '/out/day/source/2024-02-30-bad-day-body.md' when 2 then 'plain Name.v2.md' when 3 then 'final/2023-12-31-x-final.md' when 4 then 'a/b.YAML' when 5 then '/d/2024-03-01--frontmatter.md' else 'notes/source' end"


def _events(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet")


def _files(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("article_id") % 50 == 4, F.lit("---\na: b\n---\n \n")).otherwise(F.col("md"))
    return md._fronted(s, d).select("article_id", F.expr(_PATHS).alias("path"), text.alias("md"), F.when(F.col("article_id") % 2 == 0, F.expr(md.ADJACENT)).alias("adjacent"))


def _chains(s: SparkSession, d: str) -> DataFrame:
    settings = {k: F.expr(x) for k, x in _SET.items()}
    installed = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("trial"))).when(F.col("event_id") % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("second"), F.lit("trial"), F.lit("hosted")))
    chain = engine_chain(engine_name(F.expr(_KIND), settings), _PROVIDERS, installed, F.col("event_id") % 3 == 0)
    return _events(s, d).select("event_id", F.array_join(chain, ">").alias("chain"), engine_error(settings, _PROVIDERS).alias("error"))


def _vocabulary(s: SparkSession, d: str) -> DataFrame:
    """How often each article holds the words and phrases of the lists."""
    low = inputs.articles(s, d).select("article_id", tx.lower(F.col("md")).alias("low"))
    found = low.select("article_id", held(F.col("low"), [w for words in LISTS.values() for w in words]).alias("found"))
    return found.select("article_id", *(F.size(F.array_intersect("found", F.array(*map(F.lit, words)))).cast("long").alias(name) for name, words in LISTS.items()))


LISTS = {"banned_words": v.BANNED_WORDS, "banned_phrases": v.BANNED_PHRASES, "replacements": sorted(set(v.REPLACEMENTS.values())), "assertive": v.ASSERTIVE_VERBS, "stopwords": v.WRITER_STOPWORDS, "types": v.CLAIM_TYPES, "strengths": v.STRENGTHS, "metrics": v.METRIC_TERMS}

QUERIES = {
    "durations": lambda s, d: _events(s, d).select("event_id", human_duration(F.round("value") * 37).alias("human"), clock(F.round("value") * 7 - 100).alias("clock")),
    "short_path": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", short_path(F.concat(F.when(F.col("page_id") % 3 == 0, "/home/me").when(F.col("page_id") % 3 == 1, "/home/m").otherwise("/home/mes"), F.lit("/"), "url"), F.when(F.col("page_id") % 5 == 0, "").otherwise("/home/me")).alias("path")),
    "resolve_sources": lambda s, d: resolve_sources(inputs.documents(s, d).select(F.col("doc_id").alias("id"), F.expr(_ARG).alias("arg")), inputs.documents(s, d).select(F.expr(_EXISTS).alias("path")), "/home/me", "/sources"),
    "engine_chain": _chains,
    "save_enhanced": lambda s, d: md._fronted(s, d).select("article_id", *(c.alias(n) for n, c in zip(("front", "body"), md.split_front(tx.text("md")), strict=True))).select("article_id", saved_review(F.col("front"), F.concat("body", F.lit("\n\n"))).alias("value")),
    "process_files": lambda s, d: process_files(_files(s, d), F.to_date(F.lit("2024-03-09"))).select("article_id", "error", "body_path", "front_path", "final_path", "date", "slug", "body"),
    "review_violations": lambda s, d: review_violations(inputs.articles(s, d), inputs.claims(s, d)).select("article_id", F.array_join("errors", "\n").alias("errors")),
    "vocabulary_hits": _vocabulary,
}


def _slug_sql(e: str) -> str:
    return f"coalesce(nullif(trim(left(trim(regexp_replace(lower({e}), '[^a-z0-9]+', '-', 'g'), '-'), 90), '-'), ''), 'untitled-article')"


def _setting_sql(kind: str, setting: str) -> str:
    return f"when {_KIND} = '{kind}' and {_SET[setting]} <> '' then {_SET[setting]}"


def _name_error_sql(setting: str) -> str:
    return f"""when {_SET[setting]} not in ('auto', 'local', '', 'hosted', 'second', 'trial') then '{setting}: unknown engine "' || {_SET[setting]} || '" (want auto, local, or one of: hosted, second, trial)'"""


_COUNTED = ", ".join("len(list_filter([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"], lambda w: contains(lower(md), w))) as {name}" for name, words in LISTS.items())
_S = "floor(round(value) * 37)::bigint"
_C = "greatest(floor(round(value) * 7 - 100)::bigint, 0)"
ORACLE_SQL = {
    "durations": f"""select event_id, case when {_S} < 60 then {_S} || 's' when {_S} < 3600 then ({_S} // 60) || 'm' || lpad(({_S} % 60)::varchar, 2, '0') || 's' else ({_S} // 3600) || 'h' || lpad(({_S} // 60 % 60)::varchar, 2, '0') || 'm' end as human,
        case when {_C} < 600 then '0' else '' end || ({_C} // 60) || ':' || lpad(({_C} % 60)::varchar, 2, '0') as clock from events""",
    "short_path": """with p as (select page_id, case page_id % 3 when 0 then '/home/me' when 1 then '/home/m' else '/home/mes' end || '/' || url as path from pages)
        select page_id, case when page_id % 5 <> 0 and page_id % 3 <> 1 then '~' || substr(path, 9) else path end as path from p""",
    "resolve_sources": f"""with a as (select doc_id as id, {_ARG} as arg from documents), x as (select distinct {_EXISTS} as path from documents),
        e as (select id, arg, case when arg = '~' then '/home/me' when starts_with(arg, '~/') then '/home/me' || substr(arg, 2) else arg end as one from a),
        f as (select id, arg, case when one in (select path from x) then one when not starts_with(one, '/') and '/sources/' || one in (select path from x) then '/sources/' || one else '' end as path from e)
        select id, arg, path, case when path = '' then 'research file not found: ' || arg else '' end as error from f""",
    "engine_chain": f"""with n as (select event_id, case {_setting_sql("extract", "extract_engine")} {_setting_sql("write", "write_engine")} {_setting_sql("edit", "edit_engine")} else {_SET["engine"]} end as name,
        case event_id % 5 when 0 then ['trial'] when 1 then [] else ['hosted', 'second', 'trial'] end as there, case {" ".join(_name_error_sql(x) for x in SETTINGS.values())} else '' end as error from events)
        select event_id, case when name in ('', 'auto') then array_to_string(list_concat(list_filter(there, lambda p: p <> 'trial' or event_id % 3 = 0), ['local']), '>') when name in ('hosted', 'second', 'trial') then name || '>local' else 'local' end as chain, error from n""",
    "save_enhanced": rf"""with {md._SPLIT}, t as (select article_id, front, body, {strip_sql("front")} as f from split)
        select article_id, case when front = '' then regexp_replace(body, '\n+$', '') || chr(10) else f || case when not ends_with(f, chr(10) || '---') then chr(10) || '---' else '' end || chr(10) || chr(10) || {strip_sql("body")} || chr(10) end as value from t""",
    "process_files": rf"""with {md._SPLIT}, b as (select article_id, {_PATHS} as path, case when article_id % 50 = 4 then '' else body end as body from split),
        k as (select *, string_split(path, '/') as s, list_filter([coalesce(string_split(path, '/')[-2], '')], lambda x: x in ('source', 'final')) as own from b),
        d as (select *, s[-1] as base, array_to_string(s[:-2], '/') as dir, array_to_string(s[:-3], '/') as up, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s[-1], '\.[^.]*$', ''), '-body$', ''), '-final$', ''), '-frontmatter$', '') as stem from k),
        e as (select *, regexp_matches(stem, '^\d{{4}}-\d{{2}}-\d{{2}}-') as dated, case when len(own) > 0 then case when len(s) > 2 then up || '/' else '' end else '' end as root, case when len(own) = 0 and len(s) > 1 then dir || '/' else '' end as same from d),
        g as (select *, case when regexp_matches(lower(base), '\.ya?ml$') then path || ' is a frontmatter file, not an article body' when body = '' then 'no article body found in ' || path else '' end as error, case when dated then substr(stem, 12) else stem end as rest from e)
        select article_id, error, case when error = '' then case when len(own) > 0 then root || 'source/' else same end || stem || '-body.md' else '' end as body_path, case when error = '' then case when len(own) > 0 then root || 'yaml/' else same end || stem || '-frontmatter.yaml' else '' end as front_path,
        case when error = '' then case when len(own) > 0 then root || 'final/' else same end || stem || '-final.md' else '' end as final_path, case when error <> '' then '' when dated and try_cast(left(stem, 10) as date) is not null then left(stem, 10) else '2024-03-09' end as date,
        case when error <> '' or rest = '' then '' else {_slug_sql("rest")} end as slug, case when error = '' then body || chr(10) else '' end as body from g""",
    "review_violations": f"with {inputs.ARTICLES_SQL}, {inputs.CLAIMS_SQL}, {sql_errors('articles', 'facts')} select article_id, array_to_string(list_concat({_ERRORS}, facts.f), chr(10)) as errors from articles join facts using (article_id)",
    "vocabulary_hits": f"with {inputs.ARTICLES_SQL} select article_id, {_COUNTED} from articles",
}
