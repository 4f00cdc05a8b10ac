"""URL filter: written rules first, mined association rules for the rest.

A URL becomes a set of tokens (host labels and their parts, path segments,
query keys; numbers are one token). Labelled URLs are transactions of their
tokens. For each label, Spark's FP-growth mines the combinations that are
frequent among its transactions, so that a rare label's are found too; each
combination is then counted exactly over all labelled transactions, and those
that predict a label with enough confidence and support, and that no more
general rule makes redundant, are kept. A URL meets a mined rule through an
inverted index on the rule's rarest token. URLs with equal tokens are judged
once, so a host with a third of all pages costs no more than another.

FP-growth itself knows no longest combination, and a basket of n tokens that
are all frequent has 2^n of them. So baskets hold no token whose combinations
could only be redundant: none that is not frequent, none that has one label
alone (it is a rule of confidence 1 by itself), and of tokens that always
stand together only the first by name (a combination of two of them is as sure
as one of them). Rules of the first are rules of the others. A basket of more
than ``BASKET`` tokens is dealt into overlapping smaller ones such that any
three tokens are together in one; what is counted too often there is put right
by the exact count. A rule has ``MOST_TOKENS`` tokens at most.

Labels come from outside the mined rules: the written rules' verdicts, or
labels that are given, or what pages show (:func:`page_labels`).

All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.llm.skew import spread_join
from groundling.session import discard, materialise

#: Tokens of a basket that is mined as it is; a multiple of three.
BASKET = 12
MOST_TOKENS = 3
#: Rules that are compared with each row as they are; more are joined by host.
FEW_RULES = 200
#: A label's baskets are weighed in this many parts of the least support.
_GRAIN = 1000
#: Host, path and verdict of the query's written rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and what follows; all empty for a null or a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)


def url_tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens, sorted: ``h`` host labels, ``w`` the parts of compound ones, ``d`` top-level domain, ``p`` path segments, ``q`` query keys."""
    labels = F.split(host, r"\.")
    compound = F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.regexp_like(x, F.lit("[-_]")))
    words = F.flatten(F.transform(compound, lambda x: F.split(x, "[-_]")))
    segments = F.filter(F.split(F.translate(path, _UPPER, _LOWER), "[/.]"), lambda x: x != "")
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.substring_index(x, "=", 1))
    named = lambda prefix, items: F.transform(items, lambda x: F.concat(F.lit(prefix), F.regexp_replace(x, "[0-9]+", "#")))
    tokens = F.concat(named("h:", F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))), named("w:", words), F.array(F.concat(F.lit("d:"), F.element_at(labels, -1))), named("p:", segments), named("q:", keys))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(tokens)))


def page_text(html: Column) -> Column:
    """What a page shows: without scripts, styles, navigation, comments and tags. Every step is linear in the page, however it is broken."""
    def cut(text: Column, opening: str, hidden: str) -> Column:
        """Without what each ``opening`` hides; one that is never closed hides nothing."""
        parts = F.split(text, opening)
        return F.array_join(F.transform(parts, lambda x, k: F.when(k == 0, x).otherwise(F.regexp_replace(x, hidden, " "))), " ")

    text = cut(F.coalesce(html.cast("string"), F.lit("")), "<!--", r"(?s)^.*?-->")
    text = cut(text, r"(?i)<(?=(?:script|style|nav)\b)", r"(?is)^(script|style|nav)\b.*?</\1\s*>")
    text = F.regexp_replace(text, "<[^<>]*>", " ")
    return F.regexp_replace(F.regexp_replace(text, "&amp;", "&"), "&(?:[a-z]{1,10}|#[0-9]{1,7});", " ")


def page_labels(verdict: Column, html: Column, symbols: float = 0.1, shouts: float = 0.1, words: int = 20) -> Column:
    """block or allow: the written rule's verdict, else block for a page that shows symbols, shouting or next to no words."""
    text = page_text(html)
    n = F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1))
    poor = (F.regexp_count(text, F.lit(r"[#*$%&|<>]")) > symbols * n) | (F.regexp_count(text, F.lit("!")) > shouts * n) | (n < words)
    return F.coalesce(verdict, F.when(poor, F.lit("block")).otherwise(F.lit("allow")))


def written_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({', '.join(map(quote, r))})" for r in rules)
    return spark.sql(f"select * from values {rows} as t(rule_host, rule_path, rule_verdict)") if rules else spark.sql("select '' rule_host, '' rule_path, '' rule_verdict where false")


def _suffixes(host: Column) -> Column:
    """A host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (host, path, ...) with ``rule`` and ``rule_verdict`` of the longest rule that fits, else null.

    A few rules are compared with each row where it lies. More than
    ``FEW_RULES`` meet the distinct hosts (each with its parent domains), and
    each host's rules go back to its pages, a frequent host's over many tasks.
    """
    longest = lambda a, b: F.coalesce(F.nullif(b["n"] - a["n"], F.lit(0)), F.when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0))
    each = rules.select(F.struct(F.col("rule_host").alias("host"), (F.length("rule_host") + F.length("rule_path")).alias("n"), F.concat("rule_host", "rule_path").alias("rule"), "rule_path", "rule_verdict").alias("r"))
    few = each.limit(FEW_RULES + 1).collect()
    if len(few) <= FEW_RULES:
        known = F.array(*(F.struct(*(F.lit(value).alias(name) for name, value in r["r"].asDict().items())) for r in sorted(few))) if few else None
        fits = F.filter(known, lambda r: (F.col("host") != "") & (F.endswith(F.concat(F.lit("."), F.col("host")), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("path"), r["rule_path"])) if few else None
        best = F.array_sort(fits, longest)[0] if few else F.lit(None).cast(each.schema["r"].dataType)
        return pages.withColumn("best", F.when(F.size(fits) > 0, best) if few else best).withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.rule_verdict")).drop("best")
    pages = materialise(pages, "pages")
    hosts = pages.where("host != ''").groupBy("host").agg(F.count("*").alias("n"))
    domains = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("rule_host"))
    known = domains.join(each.select("r", F.col("r.host").alias("rule_host")), "rule_host").groupBy("host").agg(F.collect_list("r").alias("known"))
    joined = spread_join(pages, known, ["host"], "left", counts=hosts)
    fits = F.array_sort(F.filter("known", lambda r: F.startswith(F.col("path"), r["rule_path"])), longest)
    return joined.withColumn("best", F.when(F.size(fits) > 0, fits[0])).withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.rule_verdict")).drop("known", "best")


def small_baskets(tokens: Column) -> Column:
    """Baskets of at most ``BASKET`` tokens, in one of which any three tokens of a basket are together."""
    third = BASKET // 3
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(tokens) / F.lit(third)).cast("int") - 1), lambda k: F.slice(tokens, k * third + 1, F.lit(third)))
    n = F.size(blocks)
    threes = F.flatten(F.transform(F.sequence(F.lit(0), n - 3), lambda a: F.flatten(F.transform(F.sequence(a + 1, n - 2), lambda b: F.transform(F.sequence(b + 1, n - 1), lambda c: F.concat(F.get(blocks, a), F.get(blocks, b), F.get(blocks, c)))))))
    return F.when(F.size(tokens) <= BASKET, F.array(tokens)).otherwise(threes)


def _together(spread: DataFrame, sets: DataFrame) -> DataFrame:
    """Which ids of ``spread`` (id, token) have all tokens of which of ``sets`` (tokens, two or more): id, tokens."""
    seen = spread.groupBy("token").agg(F.count("*").alias("n"))
    each = materialise(sets.select("tokens", F.explode("tokens").alias("token")), "each")
    rarest = each.join(seen, "token").groupBy("tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    met = materialise(spread_join(spread.select("id", "token"), rarest, ["token"], counts=seen).select("id", "tokens"), "met")
    wanted = met.select("id", "tokens", F.explode("tokens").alias("token"))
    full = wanted.join(spread.select("id", "token"), ["id", "token"]).groupBy("id", "tokens").agg(F.count("*").alias("held"))
    return full.where(F.col("held") == F.size("tokens")).select("id", "tokens")


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, min_count: int = 5) -> DataFrame:
    """Rules (tokens, verdict, confidence, support, lift) from transactions (tokens, label).

    ``min_support`` is the least share of a label's own transactions, and
    ``min_count`` their least number. Support and lift are of all transactions.
    """
    spark = labelled.sparkSession
    shapes = materialise(labelled.where(F.size("tokens") > 0).groupBy("tokens", "label").agg(F.count("*").alias("n")).withColumn("id", F.unhex(F.md5(F.concat_ws("\n", "label", "tokens")))), "shapes")
    totals = {r["label"]: r["n"] for r in shapes.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a few labels
    nothing = spark.sql("select array('') tokens, '' verdict, 0.0d confidence, 0.0d support, 0.0d lift where false")
    if not totals:
        return nothing
    total = sum(totals.values())
    rate = F.create_map(*(F.lit(x) for label, n in sorted(totals.items()) for x in (label, float(n))))
    enough = lambda label, n: n >= F.greatest(F.lit(float(min_count)), min_support * F.element_at(rate, label))
    spread = materialise(shapes.select("id", "label", "n", F.explode("tokens").alias("token")), "spread")
    # each token alone: its counts by label, and where it stands (two sums of hashes tell tokens apart that do not always stand together)
    alone = spread.groupBy("token", "label").agg(F.sum("n").alias("freq"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("y"))
    alone = materialise(alone, "alone")
    where = F.array_sort(F.collect_list(F.struct("label", "freq", "x", "y"))).alias("where")  # an entry a label
    tokens = materialise(alone.groupBy("token").agg(F.sum("freq").alias("base"), where), "tokens")
    firsts = tokens.groupBy("where").agg(F.min("token").alias("first"))
    named = materialise(tokens.join(firsts, "where").select("token", "first", "base", F.size("where").alias("labels")), "named")
    mixed = named.where((F.col("labels") > 1) & (F.col("token") == F.col("first"))).select("token")
    frequent = materialise(alone.join(mixed, "token").where(enough(F.col("label"), F.col("freq"))).select("token", "label"), "frequent")
    sizes = spread.groupBy("token", "label").agg(F.count("*").alias("n"))
    kept = spread_join(spread, frequent, ["token", "label"], counts=sizes).groupBy("label", "id").agg(F.first("n").alias("n"), F.array_sort(F.collect_set("token")).alias("items")).where(F.size("items") > 1)
    kept = materialise(kept.groupBy("label", "items").agg(F.sum("n").alias("n")), "kept")
    found, used = None, [shapes, spread, alone, tokens, named, frequent, kept]
    for label, n in sorted(totals.items()):
        least = max(min_count, min_support * n)
        # equal baskets are one, which stands once for every `scale` pages and once more: no combination gets less than its due
        scale = max(1, int(least) // _GRAIN)
        share = F.ceil(F.col("n") / F.lit(scale)).cast("long")
        own = kept.where(F.col("label") == label)
        baskets = materialise(own.select("n", F.explode(small_baskets(F.col("items"))).alias("items")).groupBy("items").agg(F.sum("n").alias("n")).select("items", share.alias("n")), "baskets")
        used.append(baskets)
        many = baskets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not many:
            continue
        rows = baskets.select("items", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("items")
        floor = max(1, int(least) // scale)
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (floor - 0.5) / many)).fit(rows).freqItemsets.where(F.size("items").between(2, MOST_TOKENS)).select(F.array_sort("items").alias("tokens"))
        found = sets if found is None else found.unionByName(sets)
    counted = alone.join(named.select("token", "base"), "token").select(F.array("token").alias("tokens"), F.col("label").alias("verdict"), "freq", "base")
    if found is not None:
        found = materialise(found.distinct(), "itemsets")
        vocabulary = found.select(F.explode("tokens").alias("token")).distinct()
        near = materialise(spread_join(spread, vocabulary, ["token"]), "near")
        held = _together(near, found).join(shapes.select("id", "label", "n"), "id")
        sums = materialise(held.groupBy("tokens", "label").agg(F.sum("n").alias("freq")), "sums")
        base = sums.groupBy("tokens").agg(F.sum("freq").alias("base"))
        counted = counted.unionByName(sums.join(base, "tokens").select("tokens", F.col("label").alias("verdict"), "freq", "base"))
        used += [found, near, sums]
    confidence = F.col("freq") / F.col("base")
    own = F.element_at(rate, F.col("verdict"))
    rules = counted.where((confidence >= min_confidence) & enough(F.col("verdict"), F.col("freq")))
    rules = materialise(rules.select("tokens", "verdict", confidence.alias("confidence"), (F.col("freq") / F.lit(total)).alias("support"), (confidence / (own / F.lit(total))).alias("lift")), "rules")
    # a rule is redundant if a part of its tokens predicts the same as surely
    smaller = rules.where(F.size("tokens") > 1).select("tokens", "verdict", "confidence", F.explode(_proper_parts(F.col("tokens"), MOST_TOKENS)).alias("part"))
    general = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("sure"))
    redundant = smaller.join(general, ["part", "verdict"]).where("sure >= confidence").select("tokens", "verdict").distinct()
    left = rules.join(redundant, ["tokens", "verdict"], "left_anti")
    # what holds for the first of some tokens holds for each that always stands with it
    several = left.where(F.size("tokens") > 1).withColumn("rule", F.struct("tokens", "verdict", "confidence", "support", "lift"))
    parts = several.select("rule", F.posexplode("tokens").alias("at", "first"))
    members = named.where("labels > 1").select("first", "token")
    options = parts.join(members, "first").groupBy("rule", "at").agg(F.collect_list("token").alias("any")).groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("at", "any"))).alias("options"))
    full = options.select("rule", F.array().cast("array<string>").alias("tokens"), "options")
    for k in range(MOST_TOKENS):
        choices = F.coalesce(F.get(F.col("options.any"), F.lit(k)), F.array(F.lit(None).cast("string")))
        full = full.select("rule", "tokens", "options", F.explode(choices).alias("one")).select("rule", F.array_compact(F.array_append("tokens", F.col("one"))).alias("tokens"), "options")
    expanded = full.select(F.array_sort("tokens").alias("tokens"), *(F.col(f"rule.{c}").alias(c) for c in ("verdict", "confidence", "support", "lift")))
    out = materialise(left.where(F.size("tokens") == 1).unionByName(expanded), "kept")
    for table in (*used, rules):
        discard(table)
    return out


def _proper_parts(tokens: Column, most: int) -> Column:
    """Proper non-empty parts of a sorted array of up to ``most`` tokens."""
    parts = []
    for mask in range(1, (1 << most) - 1):
        places = [k for k in range(most) if mask >> k & 1]
        part = F.array_compact(F.array(*(F.get(tokens, F.lit(k)) for k in places)))
        parts.append(F.when((F.size(part) == len(places)) & (F.size(tokens) > len(places)), part))
    return F.array_distinct(F.array_compact(F.array(*parts)))


def match_rules(shapes: DataFrame, rules: DataFrame) -> DataFrame:
    """The surest rule of each token set: tokens, mined (its tokens), mined_verdict, confidence.

    Rules of several tokens are indexed by the token that the fewest token sets
    have; ties go to more lift, more support, to ``block``, and to the first by
    name.
    """
    numbered = materialise(shapes.select("tokens", F.unhex(F.md5(F.concat_ws("\n", "tokens"))).alias("id")), "shapes")
    each = materialise(numbered.select("id", F.explode("tokens").alias("token")), "tokens")
    vocabulary = rules.select(F.explode("tokens").alias("token")).distinct()
    spread = materialise(spread_join(each, vocabulary, ["token"]), "spread")
    single = spread_join(spread, rules.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token"), F.struct("tokens", "verdict", "confidence", "support", "lift").alias("r")), ["token"]).select("id", "r")
    several = rules.where(F.size("tokens") > 1)
    found = _together(spread, several.select("tokens").distinct()).join(several, "tokens").select("id", F.struct("tokens", "verdict", "confidence", "support", "lift").alias("r"))
    order = F.struct((-F.col("r.confidence")).alias("c"), (-F.col("r.lift")).alias("l"), (-F.col("r.support")).alias("s"), (F.col("r.verdict") != "block").alias("v"), F.array_join("r.tokens", " ").alias("name"), F.col("r.verdict").alias("verdict"), F.col("r.confidence").alias("confidence"))
    best = single.unionByName(found).groupBy("id").agg(F.min(order).alias("best"))
    return best.join(numbered, "id").select("tokens", F.col("best.name").alias("mined"), F.col("best.verdict").alias("mined_verdict"), F.col("best.confidence").alias("confidence"))


def url_filter(pages: DataFrame, rules: DataFrame, labels: DataFrame | None = None, min_support: float = 0.005, min_confidence: float = 0.9, default: str = "allow", train_when: Column | None = None, page_evidence: bool = False) -> DataFrame:
    """Verdict of every page's URL.

    ``rules`` has rule_host, rule_path and rule_verdict. ``labels`` (page_id,
    label: block or allow) are what the mined rules learn from; without it the
    written rules' verdicts are, and with ``page_evidence`` also what pages show
    (:func:`page_labels`; ``html``, where there is such a column). ``train_when`` is a condition on ``page_id`` that pages learned
    from must meet. One row per input row: page_id, host, path, rule, verdict,
    mined, confidence, label (what the page was labelled, null if it was not).
    A written rule decides; else the surest mined rule; else ``default``. A
    null URL, or one without ``://``, has empty host and path, is not learned
    from and gets the default. Of two written rules of equal length the first
    by name wins; of mined rules of equal confidence the one with more lift,
    then more support, then ``block``. A page labelled twice is ``block`` if
    any label is. Combinations under ``min_support`` of their label's pages, or
    on fewer than five, give no rule. Repeated rows are judged alike; other
    columns are ignored.
    """
    host, path, query = split_url(F.col("url").cast("string"))
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), url_tokens(host, path, query).alias("tokens"), html.alias("html"))
    judged = apply_rules(parsed, rules)
    if labels is None:
        label = page_labels(F.col("rule_verdict"), F.col("html")) if page_evidence else F.col("rule_verdict")
        judged = materialise(judged.withColumn("label", label).drop("html"), "urls")
    else:
        kept = labels.where("page_id is not null and label in ('block', 'allow')").groupBy(F.col("page_id").cast("long").alias("labelled_id")).agg(F.max("label").alias("label"))
        judged = judged.drop("html")
        judged = materialise(judged.join(kept, judged["page_id"].cast("long") == kept["labelled_id"], "left").drop("labelled_id"), "urls")
    learned = judged.where("host != '' and label is not null")
    mined = mine_rules((learned.where(train_when) if train_when is not None else learned).select("tokens", "label"), min_support, min_confidence)
    shapes = materialise(judged.where("rule is null and host != ''").groupBy("tokens").agg(F.count("*").alias("n")), "open")
    found = materialise(match_rules(shapes.select("tokens"), mined), "matched")
    is_open = F.col("rule").isNull() & (F.col("host") != "")
    columns = ["page_id", "host", "path", "rule", "rule_verdict", "label"]
    joined = spread_join(judged.where(is_open).select(*columns, "tokens"), found, ["tokens"], "left", counts=shapes)
    closed = judged.where(~is_open).select(*columns, F.lit(None).cast("string").alias("mined"), F.lit(None).cast("string").alias("mined_verdict"), F.lit(None).cast("double").alias("confidence"))
    out = joined.drop("tokens").unionByName(closed)
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "mined_verdict", F.lit(default)).alias("verdict"), "mined", "confidence", "label")


def held_out() -> Column:
    """Pages that the query does not learn from, so that its verdicts can be held against their labels."""
    return F.coalesce(F.crc32(F.col("page_id").cast("string")) % 5 == 0, F.lit(False))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), written_rules(spark, RULES), train_when=~held_out())
    return out.withColumn("held_out", held_out())


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLE_SQL: dict[str, str] = {}
