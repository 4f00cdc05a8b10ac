"""Publishing metadata and front matter."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.functions import paragraphs
from groundling.functions import text as tx
from groundling.functions import vocabulary as v
from groundling.functions.text import SP
from groundling.operators.normalise import _PREFIX, strip_sql, words_sql
from groundling.plans import inputs

_BLOCK = r"(?s)\A(---\r?\n.*?\r?\n---\r?\n?)"


@dataclass(frozen=True)
class Site:
    """Publisher identity stamped into generated front matter."""

    base_url: str = "https://example.org"
    cdn: str = "https://cdn.example.org"
    name: str = "Example Publisher"
    short_name: str = "example"
    email: str = "editor@example.org"
    handle: str = "@example"
    location: str = "Anywhere"
    measurement_id: str = ""
    copyright_from: int = 2020
    generator: str = "Static site generator"
    components: str = "Templates, Themes"


def site_from(settings: Mapping[str, str], prefix: str = "GROUNDLING_SITE_") -> Site:
    """The default site with what ``settings`` (such as the environment) names, as PREFIX + field in capitals; blank or malformed values keep the default."""
    found = {}
    for field in fields(Site):
        value = settings.get(prefix + field.name.upper(), "").strip()
        if field.name == "copyright_from":
            if re.fullmatch(r"[+-]?[0-9]{1,9}", value):
                found[field.name] = int(value)
        elif value:
            found[field.name] = value
    return Site(**found)


def split_front(c: Column) -> tuple[Column, Column]:
    """Front matter block (empty without one) and body."""
    c = tx.strip(c)
    block = F.regexp_extract(c, _BLOCK, 1)
    return block, F.when(block == "", c).otherwise(tx.strip(F.substring(c, F.char_length(block) + 1, F.char_length(c))))


def combine_front(front: Column, body: Column) -> Column:
    """A document of a block, with its delimiters added where they are missing, and a body."""
    front, body = tx.strip(front), tx.strip(body)
    opened = F.when(F.startswith(front, F.lit("---")), front).otherwise(F.concat(F.lit("---\n\n"), front))
    closed = F.when((opened != "---") & ~F.endswith(opened, F.lit("\n---")), F.concat(opened, F.lit("\n---"))).otherwise(opened)
    return F.when(front == "", body).otherwise(F.concat(closed, F.lit("\n\n"), body, F.lit("\n")))


def parse_fields(front: Column) -> Column:
    """Map of single-line ``key: value`` pairs, values raw; of a repeated key the last."""
    line = rf"(?dm)^([A-Za-z][A-Za-z0-9_-]*):[ \t]+([^{SP}].*)$"
    entries = F.arrays_zip(F.regexp_extract_all(front, F.lit(line), F.lit(1)).alias("k"), F.regexp_extract_all(front, F.lit(line), F.lit(2)).alias("v"))
    keys = F.array_distinct(F.regexp_extract_all(front, F.lit(line), F.lit(1)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.regexp_replace(F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"], r"[ \t]+\z", "")))


def merge_fields(adjacent: Column, own: Column) -> Column:
    """Fields of both maps; the document's own win."""
    keys = F.array_distinct(F.concat(F.map_keys(adjacent), F.map_keys(own)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.element_at(own, k), F.element_at(adjacent, k))))


def terms(text: Column, most: int = 8) -> Column:
    """The most frequent terms of a text, the first to appear first among equals; counted within the row."""
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from paragraphs.term_lists(batches, most)

    return F.arrow_udf(count, "array<string>")(tx.lower(text))


def key_terms(texts: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(key, place, term): :func:`terms` of each text, a row for each."""
    return texts.select(key, F.posexplode(terms(tx.text("text"), most)).alias("at", "term")).select(key, (F.col("at") + 1).alias("place"), "term")


def title(body: Column) -> Column:
    line = rf"(?dm)^#[{SP}]+(.+)$"
    return F.when(F.regexp_like(body, F.lit(line)), tx.clean_text(F.regexp_extract(body, line, 1))).otherwise(F.lit("Untitled Article"))


def deck(body: Column) -> Column:
    return tx.clean_text(F.regexp_extract(body, rf'(?is)<p[{SP}]+class="deck">(.*?)</p>', 1))


def bold_line(body: Column) -> Column:
    return tx.clean_text(F.regexp_extract(body, rf"(?dm)^\*\*(.+?)\*\*[{SP}]*$", 1))


def subtitle(deck: Column, bold: Column) -> Column:
    """Of an article's :func:`deck` and :func:`bold_line`."""
    low = tx.lower(bold)
    return F.when(deck != "", deck).when(F.startswith(low, F.lit("author")) | F.startswith(low, F.lit("executive summary")), F.lit("")).otherwise(bold)


def _short(c: Column, limit: int) -> Column:
    return F.when(F.octet_length(c) > limit, F.concat(tx.truncate_word(c, limit - 3), F.lit("..."))).otherwise(c)


def description(body: Column, heading: Column, standfirst: Column) -> Column:
    lead = tx.clean_text(F.regexp_extract(body, rf'(?diu)<p[{SP}]+class="post-lead-tldr"><strong>TL;DR\.?</strong>[{SP}]*(.*?)</p>', 1))
    block = F.regexp_extract(body, rf"(?s)>[{SP}]*\*\*Executive Summary\*\*[{SP}]*\n(.*?)(?:\n\n|\n#|\z)", 1)
    items = F.filter(F.transform(F.split(block, "\n"), lambda x: tx.clean_text(F.regexp_replace(tx.strip(x), r"^>?-?\*?", ""))), lambda x: x != "")
    summary = F.array_join(items, " ")
    return _short(F.when(lead != "", lead).when(summary != "", summary).when(standfirst != "", standfirst).otherwise(heading), 200)


def category(text: Column) -> Column:
    """Finance, Security or AI by the number of their terms, in this order among equals; Technology without any."""
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from paragraphs.category_names(batches)

    return F.arrow_udf(count, "string")(tx.lower(text))


def topics(heading: Column, low: Column, most: int = 8) -> Column:
    """:func:`category` of a lower-cased heading and text, :func:`terms` of the heading and of the text, in one pass of one worker."""
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from paragraphs.topics(batches, most)

    return F.arrow_udf(count, "struct<category:string,heading:array<string>,body:array<string>>")(heading, low)


def extract_metadata(articles: DataFrame, *carry: str) -> DataFrame:
    """(article_id, title, subtitle, description, excerpt, keywords, tags, category, slug); columns named by ``carry`` follow.

    An article is lower-cased once, and goes to Python once for its terms and its category.
    """
    body = articles.select("article_id", split_front(tx.text("md"))[1].alias("body"), *carry)
    named = body.withColumn("title", title(F.col("body"))).withColumn("deck", deck(F.col("body"))).withColumn("bold", bold_line(F.col("body")))
    named = named.withColumn("subtitle", subtitle(F.col("deck"), F.col("bold")))
    named = named.withColumn("description", description(F.col("body"), F.col("title"), F.col("subtitle")))
    longer = (F.col("subtitle") != "") & (F.octet_length("subtitle") > F.octet_length("description"))
    named = named.withColumn("excerpt", _short(F.when(longer, F.col("subtitle")).otherwise(F.col("description")), 220))
    named = named.withColumn("slug", tx.slugify(F.col("title"))).withColumn("low", tx.lower(F.col("body"))).withColumn("low_title", tx.lower(F.col("title")))
    named = named.withColumn("topics", topics(F.col("low_title"), F.col("low"))).withColumn("category", F.col("topics.category"))
    named = named.withColumn("keywords", joined_terms(F.col("topics.heading"), F.col("topics.body")))
    return named.select("article_id", "title", "subtitle", "description", "excerpt", "keywords", F.col("keywords").alias("tags"), "category", "slug", *carry)


def joined_terms(first: Column, then: Column, most: int = 12) -> Column:
    return F.array_join(F.slice(F.array_distinct(F.concat(first, then)), 1, most), ", ")


def keywords(heading: Column, body: Column, most: int = 12) -> Column:
    """Terms of the title, then of the body, each once."""
    return joined_terms(terms(heading), terms(body), most)


def part_of_set(path: Column) -> Column:
    """Whether a path belongs to a generated trio: by its stem's ending or its folder."""
    base = F.regexp_extract(path, r"([^/]*)\z", 1)
    stem = F.regexp_replace(base, r"\.[^.]*\z", "")
    folder = F.regexp_extract(path, r"([^/]*)/[^/]*\z", 1)
    return F.regexp_like(stem, F.lit(r"-(?:body|final|frontmatter)\z")) | folder.isin("source", "final")


# Parts of the block, their keys in order, and what is written where an article has no value of its own.
# In braces: an article's metadata, its dates and addresses, and the site's fields.
FRONT = [
    ("# Front Matter (YAML)\n\n", [
        ("author", "{email} ({name})"), ("banner_alt", "An illustration representing {lower_title}."), ("banner_height", "1280"), ("banner_width", "1920"),
        ("banner", "{cdn}/stocks/images/{slug}.webp"), ("cdn", "{cdn}"), ("charset", "UTF-8"), ("cname", "{host}"), ("copyright", "© Copyright {span} - {name}. All rights reserved."), ("date", "{shown}"),
        ("description", "{description}"), ("format-detection", "telephone=no"), ("hreflang", "en"), ("icon", "{logo}"), ("id", "{url}"), ("image_alt", "Portrait of {name}"), ("image_height", "162"),
        ("image_width", "162"), ("image", "{cdn}/stocks/images/{short_name}.webp"), ("keywords", "{keywords}"), ("language", "en-GB"), ("last_reviewed", "{date}"), ("layout", "report"), ("locale", "en_GB"),
        ("logo_alt", "Logo for {name}"), ("logo_height", "44"), ("logo_width", "44"), ("logo", "{logo}"), ("menu", ""), ("measurementID", "{measurement_id}"), ("name", "{name}"), ("permalink", "{url}"),
        ("rating", "general"), ("referrer", "no-referrer"), ("robots", "index, follow"), ("schema", "FAQPage, Article"), ("seo_title", "{title}"), ("short_name", "{short_name}"), ("subtitle", "{subtitle}"),
        ("tags", "{tags}"), ("theme-color", "0, 83, 191"), ("title", "{title}"), ("url", "{url}"), ("viewport", "width=device-width, initial-scale=1, shrink-to-fit=no"),
    ]),
    ("# RSS - The RSS feed front matter (YAML).\n", [
        ("atom_link", "{url}/rss.xml"), ("category", "{category}"), ("docs", None), ("generator", "{generator}"), ("item_description", "{description}"), ("item_guid", "{url}/rss.xml"), ("item_link", "{url}/rss.xml"),
        ("item_pub_date", "{rss}"), ("item_title", "{title}"), ("last_build_date", "{rss}"), ("managing_editor", "{email} ({name})"), ("pub_date", "{rss}"), ("ttl", "60"), ("type", "article"), ("webmaster", "{email}"),
    ]),
    ("# Apple - The Apple front matter (YAML).\n", [
        ("apple_mobile_web_app_orientations", "portrait"), ("apple_touch_icon_sizes", "192x192"), ("apple-mobile-web-app-capable", "yes"), ("apple-mobile-web-app-status-bar-inset", "black"),
        ("apple-mobile-web-app-status-bar-style", "black-translucent"), ("apple-mobile-web-app-title", "{title}"), ("apple-touch-fullscreen", "yes"),
    ]),
    ("# MS Application - The MS Application front matter (YAML).\n\n", [("msapplication-navbutton-color", "0, 83, 191")]),
    ("# Twitter Card - The Twitter Card front matter (YAML).\n\n", [
        ("twitter_card", "summary_large_image"), ("twitter_creator", "{handle}"), ("twitter_description", "{description}"), ("twitter_image", "{logo}"), ("twitter_image_alt", "Logo of {name}"),
        ("twitter_site", "{handle}"), ("twitter_title", "{title}"), ("twitter_url", "{url}"),
    ]),
    ("", [("excerpt", "{excerpt}")]),
    ("# Humans.txt - The Humans.txt front matter (YAML).\n", [
        ("author_website", "{base_url}"), ("author_twitter", "{handle}"), ("author_location", "{location}"), ("thanks", "Thanks for reading!"), ("site_last_updated", "{date}"),
        ("site_standards", "HTML5, CSS3, RSS, Atom, JSON, XML, YAML, Markdown, TOML"), ("site_components", "{components}"),
    ]),
]
RSS_DOCS = "https://validator.w3.org/feed/docs/rss2.html"


def _pieces(template: str, site: Site) -> list[tuple[bool, str]]:
    """(whether it is a name of the article's, text) of a template, the site's names filled in."""
    known = asdict(site) | {"host": site.base_url.removeprefix("https://"), "logo": f"{site.cdn}/clients/{site.short_name}/v1/logos/{site.short_name}.svg"}
    out: list[tuple[bool, str]] = []
    for at, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        named = at % 2 == 1 and piece not in known
        text = str(known[piece]) if at % 2 and not named else piece
        if out and not named and not out[-1][0]:
            out[-1] = (False, out[-1][1] + text)
        elif named or text:
            out.append((named, text))
    return out or [(False, "")]


def render_front(site: Site, day: Column, meta: Column, existing: Column) -> Column:
    """Front matter of an article: every key once, an existing value verbatim before a generated one.

    ``meta`` has the fields of :func:`extract_metadata`, ``existing`` is a map.
    """
    values = {f: meta[f] for f in ("title", "subtitle", "description", "excerpt", "keywords", "tags", "category", "slug")}
    day = day.cast("timestamp")
    year, date = F.year(day), F.date_format(day, "yyyy-MM-dd")
    span = F.when(year > site.copyright_from, F.concat(F.lit(f"{site.copyright_from} - "), year.cast("string"))).otherwise(year.cast("string")) if site.copyright_from else year.cast("string")
    values |= {"date": date, "shown": F.date_format(day, "MMMM d, yyyy"), "rss": F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss '+0000'"), "span": span, "lower_title": tx.lower(values["title"]), "url": F.concat(F.lit(site.base_url + "/"), date, F.lit("-"), values["slug"])}
    quoted = {t: tx.quote_yaml(F.concat(*(values[x] if named else F.lit(x) for named, x in _pieces(t, site)))) for _, keys in FRONT for _, t in keys if t is not None}
    fixed = {t for t in quoted if not any(named for named, _ in _pieces(t, site))}
    once = {t: f"v{at}" for at, t in enumerate(quoted) if t not in fixed}

    def block(made: Column) -> Column:
        out = [F.lit("---\n\n")]
        for head, keys in FRONT:
            out.append(F.lit(head))
            for key, template in keys:
                own = F.lit(RSS_DOCS) if template is None else quoted[template] if template in fixed else made[once[template]]
                line = F.concat(F.lit(f"{key}: "), F.coalesce(F.element_at(existing, F.lit(key)), own), F.lit("\n"))
                out.append(F.when((values["subtitle"] == "") & ~F.map_contains_key(existing, key), F.lit("")).otherwise(line) if key == "subtitle" else line)
            out.append(F.lit("\n"))
        return F.concat(*out, F.lit("---"))

    # a variable is evaluated once, so each value is quoted once, however many keys have it
    return F.transform(F.array(F.struct(*(quoted[t].alias(name) for t, name in once.items()))), block)[0]


#: An article with front matter of its own, for some with odd lines.
FRONTED = "case when {id} % 3 = 0 then '  ---' || chr(10) || 'title: \"Old ' || {id} || '\"  ' || chr(10) || 'slug: x-' || {id} || chr(10) || 'title: Second: one' || chr(9) || chr(10) || 'bad line' || chr(10) || 'empty:' || chr(10) || '---' || chr(10) || {md} when {id} % 3 = 1 then '---' || chr(10) || 'no end' || {md} else {md} end"
ADJACENT = "'date: \"May 1, 2020\"' || chr(10) || 'slug: adjacent' || chr(10) || 'layout: post' || chr(10)"


def _fronted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.articles(spark, sf_dir).select("article_id", F.expr(FRONTED.format(id="article_id", md="md")).alias("md"))


def _pairs(fields: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n")


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _fronted(spark, sf_dir).select("article_id", split_front(F.col("md"))[1].alias("body"))
    return body.select("article_id", keywords(title(F.col("body")), F.col("body")).alias("keywords")).where("keywords != ''")


def render(articles: DataFrame, site: Site, day: Column) -> DataFrame:
    """(article_id, front): front matter of each article, keeping its own fields."""
    own = articles.select("article_id", "md", parse_fields(split_front(tx.text("md"))[0]).alias("existing"))
    joined = extract_metadata(own, "existing")
    meta = F.struct("title", "subtitle", "description", "excerpt", "keywords", "tags", "category", "slug")
    return joined.select("article_id", meta.alias("meta"), "existing").select("article_id", render_front(site, day, F.col("meta"), F.col("existing")).alias("front"))


QUERIES = {
    "split_front": lambda s, d: _fronted(s, d).select("article_id", *(c.alias(n) for n, c in zip(("front", "body"), split_front(tx.text("md")), strict=True))),
    "combine_front": lambda s, d: _fronted(s, d).select("article_id", combine_front(F.when(F.col("article_id") % 4 == 0, F.concat(split_front(F.col("md"))[0], F.lit("end---"))).when(F.col("article_id") % 4 == 1, F.lit("a: b")).otherwise(split_front(F.col("md"))[0]), split_front(F.col("md"))[1]).alias("value")),
    "parse_fields_yaml": lambda s, d: _fronted(s, d).select("article_id", _pairs(parse_fields(split_front(F.col("md"))[0])).alias("fields")),
    "merge_existing": lambda s, d: _fronted(s, d).select("article_id", _pairs(merge_fields(parse_fields(F.expr(ADJACENT)), parse_fields(split_front(F.col("md"))[0]))).alias("fields")),
    "key_terms": lambda s, d: key_terms(inputs.documents(s, d).select("doc_id", "text"), "doc_id").select("doc_id", F.col("place").cast("long").alias("place"), "term"),
    "keywords": _keywords,
    "category": lambda s, d: inputs.articles(s, d).select("article_id", category(F.concat(F.lit("x "), F.when(F.col("article_id") % 4 == 0, F.regexp_replace("md", "(?i)agents?|models?", "audit")).otherwise(F.col("md")))).alias("category")),
    "extract_metadata": lambda s, d: extract_metadata(_fronted(s, d)),
    "render_front": lambda s, d: render(_fronted(s, d), Site(), F.to_date(F.lit("2024-03-09"))),
    "part_of_set": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", part_of_set(F.concat(F.translate(F.col("url"), "?#", "//"), F.element_at(F.array(F.lit("-body.md"), F.lit("/source/x.md"), F.lit("-final"), F.lit("/a-bodyx.md"), F.lit("/final/y"), F.lit(".md")), (F.col("page_id") % 6 + 1).cast("int")))).alias("value")),
}

_F = f"{inputs.ARTICLES_SQL}, fronted as (select article_id, {FRONTED.format(id='article_id', md='md')} as md from articles), trimmed as (select article_id, {strip_sql('md')} as t from fronted)"
_SPLIT = rf"""{_F}, parts as (select article_id, t, regexp_extract(t, '(?s)^(---\r?\n.*?\r?\n---\r?\n?)', 1) as front from trimmed),
    split as (select article_id, front, case when front = '' then t else {strip_sql("substr(t, length(front) + 1)")} end as body from parts)"""


def _clean_sql(e: str) -> str:
    return words_sql(rf"replace(regexp_replace(regexp_replace(regexp_replace({e}, '<[^>]*>', '', 'g'), '\[(.*?)\]\([^)]*\)', '\1', 'g'), '[*_`~]', '', 'g'), chr(13), '')")


def _cut_sql(e: str, limit: int) -> str:
    prefix = _PREFIX.format(n=limit - 3).replace("(t)", f"({e})")
    return f"case when strlen({e}) <= {limit} then {e} when instr(substr({prefix}, 2), ' ') > 0 then regexp_extract({prefix}, '(?s)^(.+) ', 1) || '...' else {prefix} || '...' end"


def _terms_sql(source: str, key: str, out: str) -> str:
    stop = ", ".join(f"'{w}'" for w in v.TERM_STOPWORDS)
    return rf"""{out}_w as (select {key}, string_split({_clean_sql("text")}, ' ') w from {source}),
    {out}_x as (select {key}, unnest(range(1, len(w) + 1)) as i, lower(unnest(w)) as r from {out}_w),
    {out}_t as (select {key}, i, regexp_replace(r, '^[.,;:!?()\[\]{{}}''"]+|[.,;:!?()\[\]{{}}''"]+$', '', 'g') as term from {out}_x),
    {out}_c as (select {key}, term, count(*) as n, min(i) as first from {out}_t where strlen(term) > 3 and term not in ({stop}) group by all),
    {out} as (select {key}, row_number() over (partition by {key} order by n desc, first) as place, term from {out}_c qualify place <= 8)"""


_TITLE = rf"case when regexp_matches(body, '(?m)^#\s+(.+)$') then {_clean_sql(r'''regexp_extract(body, '(?m)^#\s+(.+)$', 1)''')} else 'Untitled Article' end"
_BOLD = _clean_sql(r"regexp_extract(body, '(?m)^\*\*(.+?)\*\*\s*$', 1)")
_DECK = _clean_sql(r"""regexp_extract(body, '(?is)<p\s+class="deck">(.*?)</p>', 1)""")
_TLDR = _clean_sql(r"""regexp_extract(body, '(?i)<p\s+class="post-lead-tldr"><strong>TL;DR\.?</strong>\s*(.*?)</p>', 1)""")
_EXEC = r"regexp_extract(body, '(?s)>\s*\*\*Executive Summary\*\*\s*\n(.*?)(?:\n\n|\n#|$)', 1)"
_ITEMS = rf"array_to_string(list_filter(list_transform(string_split({_EXEC}, chr(10)), lambda x: {_clean_sql(f'''regexp_replace({strip_sql('x')}, '^>?-?[*]?', '')''')}), lambda x: x <> ''), ' ')"
_KEYWORDS = f"""{_SPLIT}, heads as (select article_id, body, {_TITLE} as title from split),
    tt as (select article_id, title as text from heads), bt as (select article_id, body as text from heads), {_terms_sql("tt", "article_id", "kt")}, {_terms_sql("bt", "article_id", "kb")},
    ku as (select article_id, term, min(pl) as pl from (select article_id, term, place as pl from kt union all select article_id, term, place + 100 from kb) group by all),
    kw as (select article_id, array_to_string((list(term order by pl))[1:12], ', ') as keywords from ku group by article_id)"""
_COUNTS = {name: r"len(regexp_extract_all({t}, '(?i)\b(?:" + pattern.replace("[0-9A-Za-z_]*", r"\w*") + r")\b'))" for name, pattern in v.CATEGORIES.items()}


def _category_sql(t: str) -> str:
    f, s, a = (_COUNTS[n].format(t=t) for n in v.CATEGORIES)
    return f"case when greatest({f}, {s}, {a}) = 0 then 'Technology' when {f} >= greatest({s}, {a}) then 'Finance' when {s} >= {a} then 'Security' else 'AI' end"


_PAIRS = r"""select article_id, {src} as src, unnest(regexp_extract_all({text}, '(?m)^([A-Za-z][A-Za-z0-9_-]*):[ \t]+(\S.*)$', 1)) as k, unnest(regexp_extract_all({text}, '(?m)^([A-Za-z][A-Za-z0-9_-]*):[ \t]+(\S.*)$', 2)) as val,
    generate_subscripts(regexp_extract_all({text}, '(?m)^([A-Za-z][A-Za-z0-9_-]*):[ \t]+(\S.*)$', 1), 1) as i from split"""
_JOINED = r"string_agg(k || '=' || val, chr(10) order by k || '=' || val)"
_PATH = "replace(replace(url, '?', '/'), '#', '/') || (['-body.md', '/source/x.md', '-final', '/a-bodyx.md', '/final/y', '.md'])[page_id % 6 + 1]"
ORACLE_SQL = {
    "split_front": f"with {_SPLIT} select article_id, front, body from split",
    "combine_front": rf"""with {_SPLIT},
        c as (select article_id, body, {strip_sql("case article_id % 4 when 0 then front || 'end---' when 1 then 'a: b' else front end")} as f from split),
        o as (select article_id, body, f, case when starts_with(f, '---') then f else '---' || chr(10) || chr(10) || f end as g from c)
        select article_id, case when f = '' then body else g || case when g <> '---' and not ends_with(g, chr(10) || '---') then chr(10) || '---' else '' end || chr(10) || chr(10) || body || chr(10) end as value from o""",
    "parse_fields_yaml": rf"with {_SPLIT}, p as ({_PAIRS.format(src=0, text='front')}), l as (select article_id, k, regexp_replace(arg_max(val, i), '[ \t]+$', '') as val from p group by all) select s.article_id, coalesce({_JOINED}, '') as fields from split s left join l using (article_id) group by s.article_id",
    "merge_existing": rf"with {_SPLIT}, p as ({_PAIRS.format(src=0, text=f'({ADJACENT})')} union all {_PAIRS.format(src=1, text='front')}), l as (select article_id, k, regexp_replace(arg_max(val, src * 1000 + i), '[ \t]+$', '') as val from p group by article_id, k) select s.article_id, coalesce({_JOINED}, '') as fields from split s left join l using (article_id) group by s.article_id",
    "key_terms": f"with src as (select doc_id, coalesce(text, '') as text from documents), {_terms_sql('src', 'doc_id', 'kt')} select doc_id, place, term from kt",
    "keywords": f"with {_KEYWORDS} select article_id, keywords from kw",
    "category": f"with {inputs.ARTICLES_SQL}, x as (select article_id, 'x ' || case when article_id % 4 = 0 then regexp_replace(md, '(?i)agents?|models?', 'audit', 'g') else md end as t from articles) select article_id, {_category_sql('t')} as category from x",
    "extract_metadata": f"""with {_KEYWORDS},
        a as (select article_id, body, title, case when {_DECK} <> '' then {_DECK} when starts_with(lower({_BOLD}), 'author') or starts_with(lower({_BOLD}), 'executive summary') then '' else {_BOLD} end as subtitle from heads),
        b as (select *, case when {_TLDR} <> '' then {_TLDR} when {_ITEMS} <> '' then {_ITEMS} when subtitle <> '' then subtitle else title end as d0 from a),
        c as (select *, {_cut_sql("d0", 200)} as description from b),
        e as (select *, case when subtitle <> '' and strlen(subtitle) > strlen(description) then subtitle else description end as e0 from c),
        s as (select *, left(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 90) as s0 from e)
        select article_id, title, subtitle, description, {_cut_sql("e0", 220)} as excerpt, coalesce(keywords, '') as keywords, coalesce(keywords, '') as tags, {_category_sql("(title || ' ' || body)")} as category,
        case when trim(s0, '-') = '' then 'untitled-article' else trim(s0, '-') end as slug from s left join kw using (article_id)""",
    "part_of_set": rf"with p as (select page_id, {_PATH} as path from pages), q as (select page_id, string_split(path, '/') s from p) select page_id, regexp_matches(regexp_replace(s[-1], '\.[^.]*$', ''), '-(body|final|frontmatter)$') or coalesce(s[-2], '') in ('source', 'final') as value from q",
}


def _front_sql() -> str:
    """Front matter of every article as one string of lines."""
    text = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    site = Site()
    names = {"date": "'2024-03-09'", "shown": "'March 9, 2024'", "rss": "'Sat, 09 Mar 2024 00:00:00 +0000'", "span": f"'{site.copyright_from} - 2024'", "lower_title": "lower(title)", "url": f"'{site.base_url}/2024-03-09-' || slug"}
    inner = r"""replace(replace(regexp_replace(regexp_replace({x}, '[\n\t\r]', ' ', 'g'), '[\x00-\x1F\x7F]', '', 'g'), '\', '\\'), '"', '\"')"""
    quote = lambda x: "chr(34) || " + words_sql(inner.replace("{x}", x)) + " || chr(34)"
    lines = ["'---'", "''"]
    for head, keys in FRONT:
        lines += [text(x) for x in head.removesuffix("\n").split("\n")] if head else []
        for key, template in keys:
            made = text(RSS_DOCS) if template is None else quote("(" + " || ".join(names.get(x, x) if named else text(x) for named, x in _pieces(template, site)) + ")")
            line = f"'{key}: ' || coalesce(f['{key}'], {made})"
            lines.append(f"case when subtitle <> '' or f['{key}'] is not null then {line} end" if key == "subtitle" else line)
        lines.append("''")
    return "array_to_string(list_filter([" + ", ".join([*lines, "'---'"]) + "], lambda x: x is not null), chr(10))"


ORACLE_SQL["render_front"] = rf"""with {_SPLIT}, p as ({_PAIRS.format(src=0, text="front")}), l as (select article_id, k, regexp_replace(arg_max(val, i), '[ \t]+$', '') as val from p group by all),
    own as (select s.article_id, map_from_entries(list((k, val)) filter (k is not null)) as f0 from split s left join l using (article_id) group by s.article_id), meta as ({ORACLE_SQL["extract_metadata"]}),
    j as (select m.*, coalesce(f0, map([]::varchar[], []::varchar[])) as f from meta m join own using (article_id))
    select article_id, {_front_sql()} as front from j"""
