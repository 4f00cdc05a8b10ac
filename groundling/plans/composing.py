"""The article pipeline as one plan: sources, sections, claims, ledger, article, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.functions import text as tx
from groundling.operators import claims as cl
from groundling.operators import edits as ed
from groundling.operators import planning, repair
from groundling.operators.faithfulness import faithfulness
from groundling.operators.metadata import split_front
from groundling.operators.running import saved_review
from groundling.operators.sections import split_sections
from groundling.plans import generate as gen
from groundling.plans import inputs, prompts
from groundling.session import materialise


def extract_claims(sections: DataFrame, generators: list[gen.Generator]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Checked records (source_id, section, ord, fields, reason) of sections (source_id, section, key, body), (source_id, failed, error) of sources with a section that no generator could read, and the table of all answers (source_id, section, body, raw, error).

    ``sections`` is read once: a section goes past the generator with its prompt and is not joined to the answer.
    """
    carried = ("source_id", "section", "body")
    asked = sections.select("key", prompts.claim_prompt(F.col("body")).alias("prompt"), *carried)
    answers = gen.with_fallback(asked, "key", "extract", generators, carried)
    outputs = materialise(answers.select(*carried, F.col("text").alias("raw"), "error"), "extracted")
    read = outputs.where("error = ''").select(F.struct("source_id", "section").alias("section_id"), F.col("body").alias("source"), "raw")
    checked = cl.verify(cl.parse(read)).select("section_id.*", "ord", *cl.FIELDS, "reason")
    first = F.min(F.struct("section", "error"))["error"]
    return checked, outputs.where("error != ''").groupBy("source_id").agg(F.count("*").alias("failed"), F.concat(F.lit("claim extraction failed: "), first).alias("error")), outputs


def resume_claims(sections: DataFrame, saved: DataFrame) -> DataFrame:
    """Checked records of saved ledgers (source_id, raw), held against all sections of their source as they are now."""
    corpus = sections.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda x: x["body"]), "\n\n").alias("source"))
    again = cl.resume_against(saved.select(F.col("source_id").alias("section_id"), "raw"), corpus.select(F.col("source_id").alias("section_id"), "source"))
    return again.select(F.col("section_id").alias("source_id"), F.lit(0).alias("section"), "ord", *cl.FIELDS, "reason")


def compose_articles(sources: DataFrame, generators: list[gen.Generator], retries: int = 1, saved: DataFrame | None = None) -> DataFrame:
    """One row of each source (source_id, name, text).

    Columns: source_id, sections, verified, dropped, failed, resumed, article,
    house, errors, warnings, error. A section that a generator fails on goes to
    the next one; a source with a section that all fail on has an error and no
    article, and costs no other source its own. ``saved`` (source_id, raw) are
    ledgers of an earlier run: their records are checked again, and a source
    with one that still stands is not extracted again. What generators return
    is materialised before it is verified; everything else is one plan.
    """
    sections = split_sections(sources, "source_id", F.col("name"), tx.text("text")).select("source_id", "section", F.concat_ws(":", "source_id", "section").alias("key"), "body")
    kinds = {c: sections.schema[c].dataType for c in ("source_id", "section")}
    again = None
    if saved is not None:
        sections = materialise(sections, "sections")
        old = materialise(resume_claims(sections, saved), "resumed")
        again = old.where("reason is null").select("source_id").distinct().withColumn("resumed", F.lit(True))
        checked, failed, _ = extract_claims(sections.join(again, "source_id", "left_anti"), generators)
        checked = checked.unionByName(old.join(again, "source_id", "left_semi").withColumn("section", F.col("section").cast(kinds["section"])))
    else:
        checked, failed, sections = extract_claims(sections, generators)  # a row for each section, without cutting again
    checked, failed = materialise(checked, "checked"), materialise(failed, "failed")
    kept = cl.dedupe(checked.where("reason is null"), ["section", "ord"], within=["source_id"])
    numbered = kept.withColumn("ord", F.struct("section", "ord")).withColumnRenamed("source_id", "ledger_id")
    fitting = materialise(cl.budget(numbered).select(F.col("ledger_id").alias("source_id"), "ord", *cl.FIELDS), "ledger")
    ledger = fitting.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", cl.block_text().alias("b")))), lambda x: x["b"]), "").alias("ledger"), F.count("*").alias("verified"))
    least, most = planning.write_budget(F.coalesce("verified", F.lit(0)))
    able = sources.select("source_id").join(failed, "source_id", "left_anti")
    wanted = able.join(ledger, "source_id", "left").select("source_id", prompts.writing_prompt(F.lit(""), tx.text("ledger"), least, most).alias("prompt"))
    claims = fitting.withColumnRenamed("source_id", "article_id")

    def facts(texts: DataFrame) -> DataFrame:
        found = faithfulness(texts.select(F.col("source_id").alias("article_id"), F.col("text").alias("md")), claims)
        return found.select(F.col("article_id").alias("source_id"), F.col("errors").alias("facts"), "warnings")

    written = gen.write_until_valid(wanted, "source_id", generators[0], repair.normalise_article, retries, facts=facts).drop("errors")
    counts = sections.groupBy("source_id").agg(F.count("*").alias("sections"))
    dropped = checked.groupBy("source_id").agg(F.count_if(F.col("reason").isNotNull()).alias("dropped"))
    out = sources.select("source_id")
    for part in (written, counts, dropped, failed, ledger.select("source_id", "verified")):
        out = out.join(part, "source_id", "left")
    out = out.join(again, "source_id", "left") if again is not None else out.withColumn("resumed", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    said = lambda c, to: F.coalesce(F.array_join(c, "\n"), F.lit("")).alias(to)
    return out.select("source_id", *map(zero, ("sections", "verified", "dropped", "failed")), F.coalesce("resumed", F.lit(False)).alias("resumed"), tx.text("text").alias("article"), said("house", "house"), said("facts", "errors"), said("warnings", "warnings"), tx.text("error").alias("error"))


def review_articles(drafts: DataFrame, claims: DataFrame, research: DataFrame, generator: gen.Generator) -> DataFrame:
    """Articles (article_id, md) after a review that may edit them, grounded in claims and research (article_id, research).

    Columns: article_id, saved (what is written back; null where the review
    failed), output (what a failed review leaves), error, edits, kept (how many
    violations stood before and are only told). Only a violation that an edit
    brings in blocks it; an answer without edits leaves the article as it is.
    """
    front, body = split_front(tx.text("md"))
    split = materialise(drafts.select("article_id", front.alias("front"), body.alias("md")), "drafts")
    listed = claims.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", cl.block_text().alias("b")))), lambda x: x["b"]), "").alias("ledger"))
    asked = split.join(listed, "article_id", "left").join(research, "article_id", "left")
    asked = asked.select("article_id", prompts.review_prompt(tx.text("research"), F.col("md"), tx.text("ledger")).alias("prompt"))
    answers = materialise(gen.generate(asked, "article_id", "edit", generator), "answers")
    parsed = split.select("article_id", "md").join(answers.where("error = ''").select("article_id", ed.parse_edits(F.col("text")).alias("edits"), F.col("text").alias("answer")), "article_id")
    some = parsed.where(F.size("edits") > 0)
    applied = materialise(ed.apply_edits(some.select("article_id", "md", "edits")), "applied")
    good = applied.where("applied").select("article_id", "md")
    gate = ed.review_gate(split.select("article_id", "md").join(good.select("article_id"), "article_id", "left_semi"), good, claims)
    joined = split.withColumnRenamed("md", "before").join(answers.select("article_id", F.col("error").alias("fault")), "article_id").join(parsed.select("article_id", "edits", "answer"), "article_id", "left")
    joined = joined.join(applied.select("article_id", F.col("md").alias("after"), "applied"), "article_id", "left").join(gate, "article_id", "left")
    error = (
        F.when(F.col("fault") != "", F.concat(F.lit("review failed: "), "fault")).when(F.col("edits").isNull(), "no edits could be read from the answer").when(F.size("edits") == 0, "")
        .when(~F.col("applied"), "edits failed to apply").when(F.col("blocked"), "the edited article broke the rules").otherwise("")
    )
    told = joined.withColumn("error", error)
    text = F.coalesce("after", "before")
    output = F.when(F.col("error") == "", "").when(F.col("blocked"), F.col("after")).otherwise(tx.text("answer"))
    return told.select("article_id", F.when(F.col("error") == "", saved_review(F.col("front"), text)).alias("saved"), output.alias("output"), "error", F.coalesce(F.size("edits"), F.lit(0)).cast("long").alias("edits"), F.coalesce("kept", F.lit(0)).alias("kept"))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = cl.render_ledger(cl.verify(cl.parse(inputs.extractions(spark, sf_dir)))).withColumnRenamed("section_id", "article_id")
    joined = inputs.articles(spark, sf_dir).join(ledger, "article_id", "left").withColumn("ledger", tx.text("ledger"))
    least, most = planning.write_budget(F.col("article_id") % 30)
    md = F.col("md")
    return joined.select("article_id", F.octet_length(prompts.claim_prompt(md)).alias("claim_bytes"), F.md5(prompts.writing_prompt(F.lit(""), F.col("ledger"), least, most)).alias("writing"), F.octet_length(prompts.continue_prompt(md)).alias("continue_bytes"), F.octet_length(prompts.review_prompt(md, md, F.col("ledger"))).alias("review_bytes"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = inputs.documents(spark, sf_dir).select(F.col("doc_id").alias("source_id"), F.format_string("doc %d", "doc_id").alias("name"), "text")
    return compose_articles(sources, [gen.fake_generator])


QUERIES = {"build_prompts": _prompts, "compose_articles": _articles}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_N = "least(350 + 110 * (article_id % 30), 3000)"
_L = f"greatest({_N} * 3 // 4, 500)"
_TAIL = "coalesce(" + ", ".join(f"try(decode(encode(md)[-{prompts.CONTINUE_BYTES - k}:]))" for k in range(4)) + ")"


def _clip(n: int) -> str:
    return f"case when strlen(md) <= {n} then strlen(md) else strlen(coalesce(" + ", ".join(f"try(decode(encode(md)[1:{n - k}]))" for k in range(4)) + ")) end"


ORACLE_SQL = {
    "build_prompts": f"""with ledgers as ({cl.ORACLE_SQL["render_ledger"]}), {inputs.ARTICLES_SQL},
        j as (select article_id, md, coalesce(ledger, '') as ledger from articles left join ledgers on section_id = article_id)
        select article_id, {len(prompts.CLAIM_HEAD.encode())} + strlen(md) as claim_bytes,
        md5({_text(prompts.WRITE_HEAD)} || {_L} || ' to ' || greatest({_N}, {_L} + 150) || ' words' || {_text(prompts.WRITE_TASK)} || {_text(prompts.STYLE_EXAMPLE)} || {_text(prompts.WRITE_RULES)} || ledger) as writing,
        {len(prompts.CONTINUE_HEAD.encode())} + case when strlen(md) <= {prompts.CONTINUE_BYTES} then strlen(md) else strlen({_TAIL}) end as continue_bytes,
        {len((prompts.REVIEW_HEAD + prompts.REVIEW_SOURCE + prompts.REVIEW_ARTICLE).encode())} + strlen(ledger) + {_clip(prompts.REVIEW_SOURCE_BYTES)} + {_clip(prompts.REVIEW_ARTICLE_BYTES)} as review_bytes from j""",
}
