"""Budgets, plans, progress and the tables around a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundling.functions import text as tx
from groundling.functions import vocabulary as v
from groundling.functions.text import WS
from groundling.functions.wordlists import held
from groundling.operators.normalise import strip_sql, words_sql
from groundling.operators.ranking import ranked
from groundling.plans import inputs

SOURCE_BYTES, ARTICLE_BYTES = 256 << 20, 32 << 20
PREVIEW_LINES, PREVIEW_BYTES = 16, 8 << 10


def write_budget(claims: Column) -> tuple[Column, Column]:
    """Least and most words of an article for a number of verified claims."""
    target = F.least(350 + 110 * claims, F.lit(v.MAX_WORDS))
    least = F.greatest(F.floor(target * 3 / 4), F.lit(v.MIN_WORDS))
    return least.cast("long"), F.greatest(target, least + 150).cast("long")


def token_budget(words: Column, ceiling: int) -> Column:
    n = (F.floor(words * 18 / 10) + 400).cast("long")
    return F.least(n, F.lit(ceiling)) if ceiling > 0 else n


def looks_truncated(flag: Column, md: Column) -> Column:
    tail = tx.right_trim(md)
    return flag | ((tail != "") & ~tx.ends_sentence(tail))


def human_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    minutes, hours = F.floor(s / 60).cast("long"), F.floor(s / 3600).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm%02ds", minutes, s % 60)).otherwise(F.format_string("%dh%02dm", hours, minutes % 60))


def running_eta(sections: DataFrame) -> DataFrame:
    """(job, done, remaining): what is left after each of a job's sections (job, at, seconds), by the mean so far; empty below a second."""
    so_far = Window.partitionBy("job").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = sections.withColumn("done", F.count("*").over(so_far)).withColumn("mean", F.avg("seconds").over(so_far)).withColumn("total", F.count("*").over(Window.partitionBy("job")))
    left = (F.col("total") - F.col("done")) * F.col("mean")
    return counted.select("job", "done", F.when((F.col("done") < F.col("total")) & (left >= 1), F.concat(F.lit(" · ~"), human_duration(left), F.lit(" remaining"))).otherwise(F.lit("")).alias("remaining"))


def phase_timings(events: DataFrame) -> DataFrame:
    """(job, at, status, millis): time from the last start to each end of a phase (job, at, ts, status); ends without a start are left out."""
    ended = F.col("status") != "running"
    before = Window.partitionBy("job").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turns = events.withColumn("turn", F.coalesce(F.count_if(ended).over(before), F.lit(0)))
    in_turn = Window.partitionBy("job", "turn").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    started = turns.withColumn("start", F.last(F.when(~ended, F.col("ts")), ignorenulls=True).over(in_turn))
    return started.where(ended & F.col("start").isNotNull()).select("job", "at", "status", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1000).alias("millis"))


def ledger_name(day: Column, sources: Column) -> Column:
    """File name of a job's ledger, from its first source and how many there are."""
    base = F.regexp_replace(F.element_at(F.split(F.element_at(sources, 1), "/"), -1), r"\.[^.]*\z", "")
    stem = F.when(F.size(sources) > 0, tx.slugify(base)).otherwise(F.lit("sources"))
    more = F.when(F.size(sources) > 1, F.concat(F.lit("-plus-"), (F.size(sources) - 1).cast("string"))).otherwise(F.lit(""))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("-"), stem, more, F.lit("-verified-claim-ledger.md"))


def progress_score(md: Column) -> Column:
    """Share of an article that a stream has brought, by the marks of its parts."""
    marks = F.when(F.contains(md, F.lit("Executive Summary")), 62).when(F.contains(md, F.lit("<aside")), 46).when(F.contains(md, F.lit("# ")), 30).otherwise(18)
    score = F.least(marks + F.least(F.regexp_count(md, F.lit("\n## ")), F.lit(4)) * 8, F.lit(94))
    return F.when(tx.strip(md) == "", F.lit(5)).otherwise(score) / 100


def tail_preview(md: Column) -> Column:
    """The last lines that a live preview shows."""
    lines = F.split(md, "\n")
    by_line = F.array_join(F.slice(lines, -(PREVIEW_LINES + 1), PREVIEW_LINES + 1), "\n")
    view = tx.as_bytes(md)
    by_byte = tx.from_bytes(F.regexp_replace(F.right(view, F.lit(PREVIEW_BYTES)), r"\A[\x80-\xBF]+", ""))
    tail = F.when(F.size(lines) > PREVIEW_LINES + 1, by_line).when(F.octet_length(md) > PREVIEW_BYTES, by_byte).otherwise(md)
    shown = F.split(tx.strip(tail), "\n")
    return F.when(F.size(shown) > PREVIEW_LINES, F.array_join(F.slice(shown, -PREVIEW_LINES, PREVIEW_LINES), "\n")).otherwise(tx.strip(tail))


# Fixed values: (default, least, most) of the numeric settings.
SETTINGS = {"num_ctx": (8192, 512, 1 << 20), "num_predict": (4096, 1024, 1 << 20), "write_retries": (2, 0, 10), "max_continue": (3, 0, 20), "extract_concurrency": (4, 1, 32)}


def config_clamp(name: Column, raw: Column, settings: dict[str, tuple[int, int, int]] = SETTINGS) -> tuple[Column, Column]:
    """Value of a setting, and the warning if what was given is no number or out of bounds."""
    pick = lambda k: F.element_at(F.create_map(*(F.lit(x) for n, s in settings.items() for x in (n, s[k]))), name)
    raw = tx.strip(raw)
    default, low, high = pick(0), pick(1), pick(2)
    value = F.when(F.regexp_like(raw, F.lit(r"\A[+-]?[0-9]{1,18}\z")), raw.cast("long"))
    warning = F.when(raw == "", F.lit("")).when(value.isNull(), F.format_string('%s="%s" is not a number; using %d', name, raw, default)).when((value < low) | (value > high), F.format_string("%s=%d is outside [%d, %d]; using %d", name, value, low, high, default)).otherwise(F.lit(""))
    return F.when((warning == "") & (raw != ""), value).otherwise(default).cast("long"), warning


def unique_stems(articles: DataFrame, base: Column, taken: DataFrame | None = None) -> DataFrame:
    """(article_id, stem): file stems that are all different, and none of ``taken`` (stem).

    In the order of article_id (distinct), the first of a base has the base
    itself and each later one the least number from 2 on that makes a free stem.
    A stem is free if nobody took it and it is no article's base: a base always
    belongs to the first article that has it. A null base is an empty one. Only
    numbers that are bases themselves or taken are skipped, so the tables meet
    on the numbered name and no loop runs. Articles and skipped numbers of a
    base are ranked over slices (see :mod:`groundling.operators.ranking`), and
    of skipped numbers in a row only the last counts.
    """
    rows = articles.select("article_id", F.coalesce(base, F.lit("")).alias("base"))
    names = rows.select(F.col("base").alias("name")).distinct()
    held = names if taken is None else names.unionByName(taken.select(F.col("stem").alias("name"))).distinct()
    # the numbers of a base that are held, and how many free ones stand before each
    numbered = r"(?s)\A(.*)-([1-9][0-9]{0,8})\z"
    parts = held.select(F.regexp_extract("name", numbered, 1).alias("base"), F.regexp_extract("name", numbered, 2).try_cast("int").alias("k"))
    used = ranked(parts.where("k >= 2").join(names.select(F.col("name").alias("base")), "base", "left_semi"), "base", "k", "at")
    runs = used.groupBy("base", (F.col("k") - 1 - F.col("at")).alias("free")).agg(F.max("at").alias("at"))
    skips = runs.groupBy("base").agg(F.collect_list(F.struct("free", "at")).alias("runs"))
    wanted = ranked(rows, "base", "article_id", "n").join(skips, "base", "left")
    own = F.lit(0)
    if taken is not None:
        wanted = wanted.join(taken.select(F.col("stem").alias("base"), F.lit(True).alias("gone")).distinct(), "base", "left")
        own = F.when(F.col("gone").isNotNull(), 1).otherwise(0)
    want = F.col("n") + own
    # the free number that has want - 2 free ones before it: behind it lie the held numbers with fewer
    behind = F.coalesce(F.array_max(F.transform(F.filter("runs", lambda r: r["free"] < want - 1), lambda r: r["at"])), F.lit(0))
    return wanted.select("article_id", F.when(want == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), (want + behind).cast("string"))).alias("stem"))


def size_cap(text: Column, limit: int) -> tuple[Column, Column]:
    """Whether a text may be read, and the refusal."""
    n = F.octet_length(text)
    return n <= limit, F.when(n > limit, F.concat(n.cast("string"), F.lit(f" bytes; the limit is {limit}"))).otherwise(F.lit(""))


def style_samples(templates: DataFrame, most: int = 2, excerpt: int = 500) -> DataFrame:
    """(name, excerpt) of the newest templates (name, modified, text): prose without headings, cut in bytes."""
    newest = templates.orderBy(F.desc("modified"), "name").limit(most)
    prose = tx.normalise_space(F.regexp_replace(tx.text("text"), "(?dm)^#{1,6} .*$", ""))
    return newest.select("name", tx.clip_bytes(prose, excerpt).alias("excerpt")).where("excerpt != ''")


def inflect(word: Column, kind: Column) -> Column:
    """Form of a word, by the rules of :data:`groundling.functions.vocabulary.INFLECTIONS`."""
    out = word
    for name, rules in v.INFLECTIONS.items():
        form = word
        for ending, drop, add in reversed(rules):
            form = F.when(F.regexp_like(word, F.lit(rf"{ending}\z")), F.concat(F.left(word, F.length(word) - drop), F.lit(add))).otherwise(form)
        out = F.when(kind == name, form).otherwise(out)
    return out


def summary_lines(jobs: DataFrame) -> DataFrame:
    """JSON line of each job (source, words, ok, error, warnings, duration_ms); empty fields are left out."""
    some = lambda c, empty: F.when(F.col(c) != empty, F.col(c)).alias(c)
    return jobs.select("job_id", F.to_json(F.struct("source", some("words", 0), "ok", some("error", ""), F.when(F.size("warnings") > 0, F.col("warnings")).alias("warnings"), some("duration_ms", 0))).alias("line"))


def attested_forms(docs: DataFrame, text: Column) -> DataFrame:
    """(word, n, kind, form, found) of all words of ASCII letters: each form of each word, and how often the texts have it."""
    runs = docs.select(F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))).alias("run"))
    words = runs.groupBy(F.lower("run").alias("word")).agg(F.count("*").alias("n"))
    every = words.select("word", "n", F.explode(F.array(*map(F.lit, v.KINDS))).alias("kind")).withColumn("form", inflect(F.col("word"), F.col("kind")))
    return every.join(words.select(F.col("word").alias("form"), F.col("n").alias("found")), "form", "left").select("word", "n", "kind", "form", F.coalesce("found", F.lit(0)).alias("found"))


def metric_names(articles: DataFrame) -> DataFrame:
    """(article_id, term, forms): the metrics that articles (article_id, md) name, and the names of the same metric."""
    low = articles.select("article_id", tx.lower(tx.collapse(tx.text("md"))).alias("low"))
    low = low.select("article_id", "low", held(F.col("low"), v.METRIC_TERMS).alias("found"))
    used = lambda t: F.array_contains("found", t) if " " in t or "-" in t else F.array_contains("found", t) & F.regexp_like("low", F.lit(tx.bounded(tx.quoted(t))))
    terms = [F.when(used(t), F.struct(F.lit(t).alias("term"), F.lit("|".join(v.metric_forms(t))).alias("forms"))) for t in v.METRIC_TERMS]
    return low.select("article_id", F.inline(F.array_compact(F.array(*terms))))


def _stops(s: SparkSession, d: str) -> DataFrame:
    return inputs.documents(s, d).select("doc_id", F.regexp_count(tx.text("text"), F.lit("[.]")).alias("claims"))


_RAW = "case {id} % 7 when 0 then '' when 1 then ' 12x' when 2 then '-5' when 3 then ' 100 ' when 4 then '2000000' when 5 then '7' else '1024' end"
_NAMES = list(SETTINGS)
#: Stems of which some look like others' numbered ones.
_CLASHES = "when doc_id % 4 = 0 then coalesce(lang, 'none') when doc_id % 4 = 1 then coalesce(lang, 'none') || '-' || cast(2 + doc_id % 6 as string) when doc_id % 40 = 2 then coalesce(lang, 'none') || '-2-2'"
_BASE = f"case {_CLASHES} else coalesce(nullif(trim('-' from left(trim('-' from regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-')), 90)), ''), 'untitled-article') end"
_BASE_SQL = f"case {_CLASHES} else coalesce(nullif(trim(x, '-'), ''), 'untitled-article') end"


def _events(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet")


def _jobs(s: SparkSession, d: str) -> DataFrame:
    md = tx.text("md")
    return inputs.articles(s, d).select(
        F.col("article_id").alias("job_id"), F.format_string("paper-%d.pdf", "article_id").alias("source"), F.when(F.col("article_id") % 6 == 0, 0).otherwise(tx.word_count(md)).cast("long").alias("words"),
        (F.col("article_id") % 5 != 0).alias("ok"), F.when(F.col("article_id") % 5 == 0, "engine \"x\" failed").otherwise("").alias("error"),
        F.when(F.col("article_id") % 3 == 0, F.array(F.lit("fell back"), F.lit("no ledger"))).otherwise(F.array().cast("array<string>")).alias("warnings"), (F.col("article_id") * 37 % 900).alias("duration_ms"),
    )


QUERIES = {
    "write_budget": lambda s, d: _stops(s, d).select("doc_id", *(c.alias(n) for n, c in zip(("least", "most"), write_budget(F.col("claims")), strict=True))),
    "token_budget": lambda s, d: _stops(s, d).select("doc_id", token_budget(write_budget(F.col("claims"))[1], 4096).alias("tokens")),
    "looks_truncated": lambda s, d: inputs.articles(s, d).select("article_id", looks_truncated(F.col("article_id") % 5 == 0, tx.text("md")).alias("value")),
    "running_eta": lambda s, d: running_eta(_events(s, d).select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), F.round("value").alias("seconds"))),
    "phase_timings": lambda s, d: phase_timings(_events(s, d).select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), "ts", F.when(F.col("event_type").isin("view", "click", "signup"), "running").when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"))),
    "ledger_name": lambda s, d: inputs.documents(s, d).select("doc_id", ledger_name(F.to_date(F.lit("2024-03-09")), F.slice(F.array(F.concat(F.lit("/in/My Paper."), F.coalesce("lang", F.lit("")), F.lit(".pdf")), F.lit("b.txt"), F.lit("c.md")), F.lit(1), (F.col("doc_id") % 4).cast("int"))).alias("name")),
    "progress_score": lambda s, d: inputs.articles(s, d).select("article_id", "md", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("part")).select("article_id", "part", progress_score(F.left("md", F.floor(F.char_length("md") * F.col("part") / 4).cast("int"))).alias("score")),
    "tail_preview": lambda s, d: inputs.articles(s, d).select("article_id", tail_preview(F.when(F.col("article_id") % 2 == 0, F.translate("md", "\n", " ")).otherwise(F.col("md"))).alias("preview")).withColumn("words", F.size(F.filter(F.split("preview", rf"[{WS}]+"), lambda w: w != "")).cast("long")),
    "config_clamp": lambda s, d: _events(s, d).select("event_id", *(c.alias(n) for n, c in zip(("value", "warning"), config_clamp(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 5 + 1).cast("int")), F.expr(_RAW.format(id="event_id"))), strict=True))),
    "unique_stem": lambda s, d: unique_stems(inputs.documents(s, d).withColumnRenamed("doc_id", "article_id"), F.concat(F.lit("2024-03-09-"), F.expr(_BASE.replace("doc_id", "article_id")))),
    "size_cap": lambda s, d: inputs.documents(s, d).select("doc_id", *(c.alias(n) for n, c in zip(("accepted", "refusal"), size_cap(tx.text("text"), 5000), strict=True))),
    "style_samples": lambda s, d: style_samples(inputs.articles(s, d).select(F.format_string("%d.md", "article_id").alias("name"), F.col("article_id").alias("modified"), F.col("md").alias("text"))),
    "merge_sources": lambda s, d: inputs.documents(s, d).groupBy(F.col("source").alias("job")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("sources")),
    "job_summary": lambda s, d: summary_lines(_jobs(s, d)),
    "inflect_forms": lambda s, d: attested_forms(inputs.documents(s, d), tx.text("text")),
    "metric_forms": lambda s, d: metric_names(inputs.articles(s, d)),
}

_STOPS = "(select doc_id, len(regexp_extract_all(coalesce(text, ''), '[.]')) as c from documents)"
_TARGET = "least(350 + 110 * c, 3000)"
_LEAST = f"greatest({_TARGET} * 3 // 4, 500)"
_MOST = f"greatest({_TARGET}, {_LEAST} + 150)"
_SECONDS = "floor(left_)::bigint"
_TAILED = "case when article_id % 2 = 0 then replace(md, chr(10), ' ') else md end"
_LAST = "coalesce(" + ", ".join(f"try(decode(encode(t)[-{8192 - k}:]))" for k in range(4)) + ")"
_SETTING_ROWS = ", ".join(f"({k}, '{n}', {s[0]}, {s[1]}, {s[2]})" for k, (n, s) in enumerate(SETTINGS.items()))
_METRIC_ROWS = ", ".join(f"('{t}', {str(' ' in t or '-' in t).lower()}, '{'|'.join(v.metric_forms(t))}')" for t in v.METRIC_TERMS)
ORACLE_SQL = {
    "write_budget": f"select doc_id, {_LEAST} as least, {_MOST} as most from {_STOPS}",
    "token_budget": f"select doc_id, least({_MOST} * 18 // 10 + 400, 4096) as tokens from {_STOPS}",
    "looks_truncated": rf"with {inputs.ARTICLES_SQL}, t as (select article_id, regexp_replace(md, '[ \t\r\n]+$', '') x from articles) select article_id, article_id % 5 = 0 or (x <> '' and not ends_with(x, '---') and not contains('.!?)]”’…»' || chr(34) || chr(39), right(x, 1))) as value from t",
    "running_eta": f"""with c as (select user_id as job, row_number() over w as done, (count(*) over (partition by user_id) - row_number() over w) * avg(round(value)) over (partition by user_id order by event_id rows between unbounded preceding and current row) as left_
        from events window w as (partition by user_id order by event_id))
        select job, done, case when left_ < 1 then '' else ' · ~' || case when {_SECONDS} < 60 then {_SECONDS} || 's' when {_SECONDS} < 3600 then ({_SECONDS} // 60) || 'm' || lpad(({_SECONDS} % 60)::varchar, 2, '0') || 's'
        else ({_SECONDS} // 3600) || 'h' || lpad(({_SECONDS} // 60 % 60)::varchar, 2, '0') || 'm' end || ' remaining' end as remaining from c""",
    "phase_timings": """with e as (select user_id as job, event_id as at_, ts, case event_type when 'error' then 'failed' when 'purchase' then 'done' else 'running' end as status from events),
        p as (select *, max(case when status = 'running' then at_ end) over w as s, max(case when status <> 'running' then at_ end) over w as f from e window w as (partition by job order by at_ rows between unbounded preceding and 1 preceding))
        select p.job, p.at_ as "at", p.status, (epoch_us(p.ts) - epoch_us(x.ts)) // 1000 as millis from p join e x on x.job = p.job and x.at_ = p.s where p.status <> 'running' and (p.f is null or p.s > p.f)""",
    "ledger_name": """select doc_id, '2024-03-09-' || case doc_id % 4 when 0 then 'sources' else trim(regexp_replace(lower('My Paper.' || coalesce(lang, '')), '[^a-z0-9]+', '-', 'g'), '-') end
        || case when doc_id % 4 > 1 then '-plus-' || (doc_id % 4 - 1) else '' end || '-verified-claim-ledger.md' as name from documents""",
    "progress_score": f"""with {inputs.ARTICLES_SQL}, q as (select article_id, md, unnest(range(5)) as part from articles), p as (select article_id, part, left(md, length(md) * part // 4) as t from q)
        select article_id, part, case when {strip_sql("t")} = '' then 0.05 else least(0.94, case when contains(t, 'Executive Summary') then 0.62 when contains(t, '<aside') then 0.46 when contains(t, '# ') then 0.30 else 0.18 end
        + 0.08 * least(4, len(string_split(t, chr(10) || '## ')) - 1)) end::double as score from p""",
    "tail_preview": f"""with {inputs.ARTICLES_SQL}, p as (select article_id, {_TAILED} as t from articles),
        q as (select article_id, {strip_sql(f"case when len(string_split(t, chr(10))) > 17 then array_to_string(string_split(t, chr(10))[-17:], chr(10)) when strlen(t) > 8192 then {_LAST} else t end")} as x from p),
        r as (select article_id, array_to_string((string_split(x, chr(10)))[-16:], chr(10)) as preview from q)
        select article_id, preview, len(list_filter(string_split_regex(preview, '[{WS}]+'), lambda w: w <> '')) as words from r""",
    "config_clamp": f"""with s(k, name, d, lo, hi) as (values {_SETTING_ROWS}), r as (select event_id, name, d, lo, hi, trim({_RAW.format(id="event_id")}) as raw from events join s on s.k = event_id % 5)
        select event_id, case when try_cast(raw as bigint) between lo and hi then try_cast(raw as bigint) else d end as value,
        case when raw = '' or try_cast(raw as bigint) between lo and hi then '' when try_cast(raw as bigint) is null then name || '="' || raw || '" is not a number; using ' || d else name || '=' || raw || ' is outside [' || lo || ', ' || hi || ']; using ' || d end as warning from r""",
    "unique_stem": rf"""with t as (select doc_id, doc_id as article_id, lang, left(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '-'), 90) x from documents),
        b as (select article_id, '2024-03-09-' || {_BASE_SQL} as base from t),
        n as (select *, row_number() over (partition by base order by article_id) as n from b),
        k as (select base, unnest(range(2, count(*) + 20)) as k from b group by base having count(*) > 1),
        free as (select base, k, row_number() over (partition by base order by k) as r from k where base || '-' || k not in (select base from b))
        select article_id, case when n = 1 then n.base else n.base || '-' || k end as stem from n left join free on free.base = n.base and r = n - 1""",
    "size_cap": "select doc_id, strlen(coalesce(text, '')) <= 5000 as accepted, case when strlen(coalesce(text, '')) > 5000 then strlen(text) || ' bytes; the limit is 5000' else '' end as refusal from documents",
    "style_samples": rf"""with {inputs.ARTICLES_SQL}, n as (select article_id || '.md' as name, {strip_sql(r"regexp_replace(replace(regexp_replace(md, '(?m)^#{1,6} .*$', '', 'g'), chr(13), chr(10)), '\n{4,}', repeat(chr(10), 3), 'g')")} as t from articles order by article_id desc limit 2)
        select name, case when strlen(t) <= 500 then t else coalesce(try(decode(encode(t)[1:500])), try(decode(encode(t)[1:499])), try(decode(encode(t)[1:498])), try(decode(encode(t)[1:497]))) end as excerpt from n where t <> ''""",
    "merge_sources": "select source as job, count(*) as n, string_agg(doc_id::varchar, ',' order by doc_id) as sources from documents group by source",
    "job_summary": rf"""with {inputs.ARTICLES_SQL}, j as (select article_id, case when article_id % 6 = 0 then 0 else len(regexp_extract_all(md, '[\p{{L}}\p{{N}}]+')) end as w, article_id * 37 % 900 as ms from articles)
        select article_id as job_id, '{{"source":"paper-' || article_id || '.pdf"' || case when w > 0 then ',"words":' || w else '' end || ',"ok":' || (article_id % 5 <> 0) || case when article_id % 5 = 0 then ',"error":"engine \"x\" failed"' else '' end
        || case when article_id % 3 = 0 then ',"warnings":["fell back","no ledger"]' else '' end || case when ms > 0 then ',"duration_ms":' || ms else '' end || '}}' as line from j""",
    "inflect_forms": f"""with c as (select word, count(*) as n from (select lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) as word from documents) group by word), t as (select word, n, unnest({v.KINDS}) as kind from c),
        f as (select word, n, kind, case kind when 'base' then word when 's' then word || case when right(word, 1) in ('s', 'x', 'z') or right(word, 2) in ('ch', 'sh') then 'es' else 's' end
        when 'ed' then case when right(word, 1) = 'e' then word || 'd' else word || 'ed' end when 'ing' then case when right(word, 1) = 'e' then left(word, length(word) - 1) else word end || 'ing'
        else case when right(word, 2) = 'ic' then word || 'ally' when right(word, 2) = 'le' and length(word) > 2 then left(word, length(word) - 1) || 'y'
        when right(word, 1) = 'y' and length(word) > 1 and not contains('aeiou', substr(word, length(word) - 1, 1)) then left(word, length(word) - 1) || 'ily' else word || 'ly' end end as form from t)
        select f.word, f.n, kind, form, coalesce(c.n, 0) as found from f left join c on c.word = form""",
    "metric_forms": f"""with {inputs.ARTICLES_SQL}, t(term, loose, forms) as (values {_METRIC_ROWS}), lows as (select article_id, lower({words_sql("md")}) as low from articles)
        select article_id, term, forms from lows join t on case when loose then contains(low, term) else regexp_matches(low, '\\b' || term || '\\b') end""",
}
