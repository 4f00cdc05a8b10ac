"""Claim records: parsing, verification against the source, and the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundling.functions import text as tx
from groundling.functions import vocabulary as v
from groundling.functions.cutting import WHITE
from groundling.functions.quotes import quotes_held
from groundling.functions.text import SP, WS_BUT_LF
from groundling.operators.normalise import strip_sql, words_sql
from groundling.plans import inputs

FIELDS = {"claim": "CLAIM", "source_quote": "SOURCE_QUOTE", "type": "TYPE", "strength": "STRENGTH"}
_HEADER = "(?:CLAIM|SOURCE_QUOTE|TYPE|STRENGTH):"
MAX_CLAIMS, MAX_LEDGER_BYTES = 45, 14_000
_PLACEHOLDER = 26


def blocks(raw: Column) -> Column:
    """Blocks of an extraction output between lines of three hyphens; none for an empty output or NONE."""
    raw = tx.strip(raw)
    parts = F.filter(F.transform(F.split(raw, rf"(?dm)^---[{SP}]*$"), tx.strip), lambda x: x != "")
    return F.when((raw == "") | (raw == "NONE"), F.array().cast("array<string>")).otherwise(parts)


_LINE = rf"[{WS_BUT_LF}]*"


def field_parts(block: Column) -> Column:
    """The fields of a block, each from its header on; what stands before the first header comes first."""
    return F.split(F.btrim(block, F.lit(WHITE)), rf"\n(?={_LINE}{_HEADER})")


def field(parts: Column, name: str) -> Column:
    """Value of the first field of that name among :func:`field_parts`, its lines trimmed."""
    head = f"{name}:"
    trimmed = F.transform(parts, lambda x: F.btrim(x, F.lit(WHITE)))
    found = F.get(F.filter(trimmed, lambda x: F.startswith(x, F.lit(head))), F.lit(0))
    value = F.coalesce(F.substring(found, len(head) + 1, 1 << 30), F.lit(""))
    many = F.when(F.contains(value, F.lit("\n")), tx.sub(value, rf"{_LINE}\n{_LINE}", "\n")).otherwise(value)
    return tx.strip(many)


def source_quote(parts: Column) -> Column:
    return F.btrim(field(parts, "SOURCE_QUOTE"), F.lit('"'))


def read_fields(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the fields of its column ``block`` in place of it."""
    parts = blocks.withColumn("parts", field_parts(F.col("block")))
    value = lambda key, name: source_quote(F.col("parts")) if key == "source_quote" else field(F.col("parts"), name)
    return parts.select(*(c for c in blocks.columns if c != "block"), *(value(key, name).alias(key) for key, name in FIELDS.items()))


def parse(sections: DataFrame, *carry: str, outer: bool = False) -> DataFrame:
    """Records of each section (section_id, source, raw): section_id, ord, claim, source_quote, type, strength, source, plain.

    ``plain`` is the source as quotes are compared with it, made once for a
    section. Columns named by ``carry`` come along. With ``outer`` a section
    without blocks has one row whose ``ord`` is null.
    """
    spread = F.posexplode_outer("blocks").alias("ord", "block")  # from a plain one a filter is inferred, which cuts every output in blocks twice more
    listed = sections.select("section_id", "source", *carry, tx.normalise_claim(F.col("source")).alias("plain"), blocks(tx.text("raw")).alias("blocks"))
    split = listed.select("section_id", "source", "plain", *carry, spread)
    return read_fields(split if outer else split.where(F.col("ord").isNotNull())).select("section_id", "ord", *FIELDS, "source", "plain", *carry)


#: Words that a complete quote does not end on.
DANGLING = "and|or|but|the|a|an|of|to|in|for|with|that|which|is|are|was|were"


def reason(plain: Column | None = None, found: Column | None = None) -> Column:
    """Why a record (claim, source_quote, type, strength, source) fails verification; null if it does not.

    ``plain`` is the normalised source where it is at hand; ``found`` says
    whether the source holds the quote where that is known already.
    """
    c = {k: F.col(k) for k in FIELDS}
    held = found if found is not None else F.contains(tx.normalise_claim(F.col("source")) if plain is None else plain, tx.normalise_claim(tx.strip(c["source_quote"])))
    quote = tx.strip(c["source_quote"])
    kind, strength = (tx.lower(tx.strip(c[k])) for k in ("type", "strength"))
    missing = F.array_join(F.array_except(tx.numbers(c["claim"]), tx.numbers(quote)), ", ")
    return (
        F.when((c["claim"] == "") | (quote == ""), "missing claim or quote")
        .when(F.char_length(quote) < v.MIN_QUOTE_CHARS, "quote too short")
        .when(~F.is_valid_utf8(quote), "quote is not valid UTF-8")
        .when(F.contains(quote, F.lit("�")), "quote contains a replacement character")
        .when(~held, "quote not found in source")
        .when(F.regexp_like(F.right(quote, F.lit(len(max(DANGLING.split("|"), key=len)) + 1)), F.lit(rf"(?iu)(?:,|;|(?<![0-9A-Za-z_])(?:{DANGLING})(?![0-9A-Za-z_]))[{SP}]*\z")), "quote is a truncated fragment")
        .when((kind != "") & ~kind.isin(v.CLAIM_TYPES), F.concat(F.lit("invalid TYPE '"), kind, F.lit("'")))
        .when((strength != "") & ~strength.isin(v.STRENGTHS), F.concat(F.lit("invalid STRENGTH '"), strength, F.lit("'")))
        .when(missing != "", F.concat(F.lit("claim numbers absent from quote: "), missing))
    )


def verify(records: DataFrame) -> DataFrame:
    return records.withColumn("reason", reason(F.col("plain") if "plain" in records.columns else None))


def dedupe(records: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """The first record of each claim text, compared by single spaces and lower case.

    ``within`` names the columns of a ledger; without them all records are one
    ledger. The window's key is the claim itself, so no task holds more than
    the copies of one claim, and those stream through sorted.
    """
    key = tx.lower(tx.strip(tx.sub(F.col("claim"), rf"[{SP}]+", " ")))
    keyed = records.withColumn("claim_key", key)
    first = keyed.groupBy(*(within or []), "claim_key").agg(F.min(F.struct(*order)).alias("first"))
    joined = keyed.join(first, [*(within or []), "claim_key"])
    return joined.where(F.struct(*order) == F.col("first")).drop("first", "claim_key")


def block_text() -> Column:
    c = F.col
    return F.concat(F.lit("CLAIM: "), c("claim"), F.lit('\nSOURCE_QUOTE: "'), c("source_quote"), F.lit('"\nTYPE: '), c("type"), F.lit("\nSTRENGTH: "), c("strength"), F.lit("\n---\n"))


def render_ledger(verified: DataFrame) -> DataFrame:
    """Ledger of each section's verified records: section_id, ledger."""
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.struct("ord", block_text().alias("b"))))), lambda x: x["b"]), "")
    counted = verified.groupBy("section_id").agg(kept.alias("body"), F.count_if(F.col("reason").isNull()).alias("n"), F.count_if(F.col("reason").isNotNull()).alias("dropped"))
    text = F.concat(F.lit("# Verified Claim Ledger\n\nVerified records: "), F.col("n").cast("string"), F.lit("\nDropped records with unverifiable SOURCE_QUOTE: "), F.col("dropped").cast("string"), F.lit("\n\n"), F.col("body"))
    return counted.select("section_id", F.when(F.col("n") == 0, F.lit("# Verified Claim Ledger\n\nNONE\n")).otherwise(text).alias("ledger"))


def budget(records: DataFrame, max_claims: int = MAX_CLAIMS, max_bytes: int = MAX_LEDGER_BYTES) -> DataFrame:
    """Records (ledger_id, ord, ...) that fit a writing prompt, in order and up to the first that does not."""
    head = len("# Compact Verified Claims For Writing\n\n") + _PLACEHOLDER
    order = Window.partitionBy("ledger_id").orderBy("ord")
    sized = records.withColumn("n", F.row_number().over(order)).withColumn("bytes", F.sum(F.octet_length(block_text())).over(order.rowsBetween(Window.unboundedPreceding, 0)) + head)
    return sized.where((F.col("n") <= max_claims) & (F.col("bytes") <= max_bytes))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(inputs.extractions(spark, sf_dir))


def _ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified records, a hundred sections to a ledger."""
    kept = verify(_records(spark, sf_dir)).where("reason is null")
    return kept.withColumn("ledger_id", F.floor(F.col("section_id") / 100).cast("long")).select("ledger_id", (F.col("section_id") * 10 + F.col("ord")).alias("ord"), *FIELDS)


def resume(sections: DataFrame) -> DataFrame:
    """Records of saved ledgers (section_id, raw, source), checked again; what stands before the first claim is skipped."""
    at = F.instr("raw", "CLAIM:")
    text = F.when(at > 0, F.substring(F.col("raw"), at, F.lit(1 << 30))).otherwise(F.lit(""))
    return verify(parse(sections.withColumn("raw", text)))


def resume_against(saved: DataFrame, sources: DataFrame) -> DataFrame:
    """Records of saved ledgers (section_id, raw) with the reasons that speak against them, held against sources (section_id, source) as they are now.

    All quotes of a ledger are looked up in its source in one pass, where the
    two have met, and no record carries the source along. Several sources of
    one section hold what any of them holds. A ledger without a source has no
    rows.
    """
    at = F.instr("raw", "CLAIM:")
    text = F.when(at > 0, F.substring(F.col("raw"), at, F.lit(1 << 30))).otherwise(F.lit(""))
    current = sources.select("section_id", tx.normalise_claim(tx.text("source")).alias("plain")).groupBy("section_id").agg(F.collect_list("plain").alias("plains"))
    listed = saved.join(current, "section_id").select("section_id", "plains", blocks(text).alias("blocks"))
    quotes = F.transform(F.transform(F.transform("blocks", field_parts), lambda p: tx.strip(source_quote(p))), tx.normalise_claim)  # one by one: a variable is evaluated once
    looked = listed.select("section_id", "blocks", quotes_held(F.col("plains"), quotes).alias("held"))
    split = looked.select("section_id", F.posexplode(F.arrays_zip("blocks", "held")).alias("ord", "one")).select("section_id", "ord", F.col("one.blocks").alias("block"), F.col("one.held").alias("held"))
    return read_fields(split).withColumn("reason", reason(found=F.col("held"))).drop("held")


def _resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledgers = render_ledger(verify(_records(spark, sf_dir))).withColumnRenamed("ledger", "raw")
    changed = F.when(F.col("section_id") % 3 == 0, F.lit("another source")).otherwise(F.col("source"))
    kept = resume_against(ledgers, inputs.extractions(spark, sf_dir).select("section_id", changed.alias("source")))
    return kept.groupBy("section_id").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("dropped"))


def summary(sections: DataFrame) -> DataFrame:
    """(section_id, kept, dropped) of every section, also of those without a block."""
    found, fine = F.col("ord").isNotNull(), F.col("reason").isNull()
    return verify(parse(sections, outer=True)).groupBy("section_id").agg(F.count_if(found & fine).alias("kept"), F.count_if(found & ~fine).alias("dropped"))


def _grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.array_except(tx.numbers(F.col("claim")), tx.numbers(F.col("source_quote")))
    return _records(spark, sf_dir).select("section_id", "ord", F.array_join(n, ", ").alias("missing"))


QUERIES = {
    "parse_blocks": lambda s, d: inputs.extractions(s, d).select("section_id", F.posexplode(blocks(tx.text("raw"))).alias("ord", "block")),
    "parse_fields": lambda s, d: _records(s, d).drop("source", "plain"),
    "verify_claims": lambda s, d: verify(_records(s, d)).select("section_id", "ord", F.coalesce("reason", F.lit("verified")).alias("reason")),
    "verify_reasons": lambda s, d: verify(parse(inputs.extractions(s, d), "lang")).groupBy("lang", F.coalesce("reason", F.lit("verified")).alias("reason")).agg(F.count("*").alias("n")),
    "quote_in_source": lambda s, d: _records(s, d).select("section_id", "ord", F.contains(F.col("plain"), tx.normalise_claim(F.col("source_quote"))).alias("found")),
    "number_tokens": lambda s, d: inputs.articles(s, d).select("article_id", F.array_join(tx.numbers(tx.text("md")), " ").alias("numbers")),
    "number_grounding": _grounding,
    "parse_summary": lambda s, d: summary(inputs.extractions(s, d)),
    "resume_verify": _resume,
    "dedupe_claims": lambda s, d: dedupe(_records(s, d), ["section_id", "ord"]).select("section_id", "ord", "claim"),
    "render_ledger": lambda s, d: render_ledger(verify(_records(s, d))),
    "ledger_budget": lambda s, d: budget(_ledgers(s, d), 45, 14_000).select("ledger_id", "ord", "n", "bytes", *FIELDS),
}

_BLOCKS = rf"""{inputs.EXTRACTIONS_SQL},
    trimmed as (select section_id, lang, source, {strip_sql("raw")} as raw from extractions),
    split as (select section_id, source, unnest(list_filter(list_transform(string_split_regex(raw, '(?m)^---\s*$'), lambda x: {strip_sql("x")}), lambda x: x <> '')) as block,
        generate_subscripts(list_filter(list_transform(string_split_regex(raw, '(?m)^---\s*$'), lambda x: {strip_sql("x")}), lambda x: x <> ''), 1) - 1 as ord from trimmed where raw not in ('', 'NONE'))"""
_RECORDS_SQL = rf"""{_BLOCKS},
    ln as (select section_id, ord, i, {strip_sql("l[i]")} as line from (select section_id, ord, string_split(block, chr(10)) l, unnest(range(1, len(string_split(block, chr(10))) + 1)) i from split)),
    hd as (select *, regexp_extract(line, '^(CLAIM|SOURCE_QUOTE|TYPE|STRENGTH):', 1) as h from ln),
    gr as (select *, sum(case when h <> '' then 1 else 0 end) over (partition by section_id, ord order by i) as g from hd),
    vals as (select section_id, ord, g, max(h) as h, {strip_sql("string_agg(case when h <> '' then " + strip_sql("substr(line, length(h) + 2)") + " else line end, chr(10) order by i)")} as val from gr where g > 0 group by section_id, ord, g),
    firsts as (select section_id, ord, h, arg_min(val, g) as val from vals group by section_id, ord, h),
    records as (select s.section_id, s.ord, s.source, coalesce(max(val) filter (h = 'CLAIM'), '') as claim, trim(coalesce(max(val) filter (h = 'SOURCE_QUOTE'), ''), '"') as source_quote,
        coalesce(max(val) filter (h = 'TYPE'), '') as type, coalesce(max(val) filter (h = 'STRENGTH'), '') as strength from split s left join firsts f using (section_id, ord) group by all)"""


def _numbers_sql(expr: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all({expr}, '\d+(?:[.,]\d+)*'), lambda x: replace(x, ',', '')))"


def _norm_sql(expr: str) -> str:
    return f"lower({words_sql(f'replace(replace(replace(replace({expr}, chr(8220), chr(34)), chr(8221), chr(34)), chr(8216), chr(39)), chr(8217), chr(39))')})"


def _missing_sql(claim: str, quote: str) -> str:
    return f"array_to_string(list_sort(list_filter({_numbers_sql(claim)}, lambda n: not list_contains({_numbers_sql(quote)}, n))), ', ')"


_VERIFIED_SQL = rf"""{_RECORDS_SQL},
    checked as (select *, {strip_sql("source_quote")} as q, lower({strip_sql("type")}) as ty, lower({strip_sql("strength")}) as st, {_missing_sql("claim", "source_quote")} as missing from records),
    verified as (select section_id, ord, claim, source_quote, type, strength, source, case
        when claim = '' or q = '' then 'missing claim or quote'
        when length(q) < 12 then 'quote too short'
        when contains(q, chr(65533)) then 'quote contains a replacement character'
        when not contains({_norm_sql("source")}, {_norm_sql("q")}) then 'quote not found in source'
        when regexp_matches(q, '(?i)(?:,|;|\b(?:{DANGLING}))\s*$') then 'quote is a truncated fragment'
        when ty not in ('', {", ".join(f"'{x}'" for x in v.CLAIM_TYPES)}) then 'invalid TYPE ''' || ty || ''''
        when st not in ('', {", ".join(f"'{x}'" for x in v.STRENGTHS)}) then 'invalid STRENGTH ''' || st || ''''
        when missing <> '' then 'claim numbers absent from quote: ' || missing end as reason from checked)"""
_BLOCK_SQL = """'CLAIM: ' || claim || chr(10) || 'SOURCE_QUOTE: "' || source_quote || '"' || chr(10) || 'TYPE: ' || type || chr(10) || 'STRENGTH: ' || strength || chr(10) || '---' || chr(10)"""
ORACLE_SQL = {
    "parse_blocks": f"with {_BLOCKS} select section_id, ord, block from split",
    "parse_fields": f"with {_RECORDS_SQL} select section_id, ord, claim, source_quote, type, strength from records",
    "verify_claims": f"with {_VERIFIED_SQL} select section_id, ord, coalesce(reason, 'verified') as reason from verified",
    "verify_reasons": f"with {_VERIFIED_SQL} select lang, coalesce(reason, 'verified') as reason, count(*) as n from verified join extractions using (section_id) group by all",
    "quote_in_source": f"with {_RECORDS_SQL} select section_id, ord, contains({_norm_sql('source')}, {_norm_sql('source_quote')}) as found from records",
    "number_tokens": f"with {inputs.ARTICLES_SQL} select article_id, array_to_string(list_sort({_numbers_sql('md')}), ' ') as numbers from articles",
    "number_grounding": f"with {_RECORDS_SQL} select section_id, ord, {_missing_sql('claim', 'source_quote')} as missing from records",
    "parse_summary": f"with {_VERIFIED_SQL} select section_id, count(ord) filter (reason is null) as kept, count(reason) as dropped from extractions left join verified using (section_id) group by section_id",
    "resume_verify": f"with {_VERIFIED_SQL} select section_id, count(*) filter (section_id % 3 <> 0) as kept, count(*) filter (section_id % 3 = 0) as dropped from verified where reason is null group by section_id",
    "dedupe_claims": rf"with {_RECORDS_SQL}, k as (select section_id, ord, claim, row_number() over (partition by lower({strip_sql(r"regexp_replace(claim, '\s+', ' ', 'g')")}) order by section_id, ord) as n from records) select section_id, ord, claim from k where n = 1",
    "render_ledger": f"""with {_VERIFIED_SQL} select section_id, case when count(*) filter (reason is null) = 0 then '# Verified Claim Ledger' || chr(10) || chr(10) || 'NONE' || chr(10) else
        '# Verified Claim Ledger' || chr(10) || chr(10) || 'Verified records: ' || count(*) filter (reason is null) || chr(10) || 'Dropped records with unverifiable SOURCE_QUOTE: ' || count(reason) || chr(10) || chr(10)
        || string_agg({_BLOCK_SQL}, '' order by ord) filter (reason is null) end as ledger from verified group by section_id""",
    "ledger_budget": f"""with {_VERIFIED_SQL}, kept as (select section_id // 100 as ledger_id, section_id * 10 + ord as ord, claim, source_quote, type, strength, strlen({_BLOCK_SQL}) as b from verified where reason is null),
        run as (select *, row_number() over w as n, 65 + sum(b) over w as bytes from kept window w as (partition by ledger_id order by ord))
        select ledger_id, ord, n, bytes::bigint as bytes, claim, source_quote, type, strength from run where n <= 45 and bytes <= 14000""",
}
