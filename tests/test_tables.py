"""Sources, sinks, streams, the generator seam, and every query against its SQL."""

import json
import os
import shutil
import subprocess
import sys
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from groundling import registry
from groundling.functions import cutting
from groundling.functions import text as tx
from groundling.operators import metadata as md
from groundling.operators import ranking, running, sections
from groundling.operators.planning import unique_stems
from groundling.operators.rules import house_errors
from groundling.plans import composing
from groundling.plans import generate as gen
from groundling.sources import readers, sinks
from groundling.streaming import gate

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else str(x)
    return sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    assert len(got)
    sql = registry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for table in TABLES:
            con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\r\ny\n\n\n\n\nz")
    (tmp_path / "b.MD").write_text("# T")
    (tmp_path / "c.docx").write_bytes(b"x")
    (tmp_path / "d.pdf").write_bytes(b"x")
    (tmp_path / "e.txt").write_text("y" * 200)
    (tmp_path / "f.txt").write_bytes("caf\u00e9".encode("latin-1"))
    rows = {r["name"]: r for r in readers.read_sources(spark, str(tmp_path), limit=100).collect()}
    assert rows["a.txt"]["text"] == "x\ny\n\n\nz" and rows["b.MD"]["text"] == "# T"
    assert rows["c.docx"]["error"].startswith("not a document") and rows["d.pdf"]["error"] and rows["e.txt"]["error"] == "e.txt is 200 bytes; the limit is 100"
    assert rows["f.txt"]["error"] == "f.txt is not valid UTF-8" and rows["f.txt"]["text"] == ""
    good, about = readers.outcome(readers.read_sources(spark, str(tmp_path), limit=100))
    told = about.first()
    assert sorted(r["name"] for r in good.collect()) == ["a.txt", "b.MD"] and (told["read"], told["failed"], told["error"]) == (2, 4, "")
    told = readers.outcome(readers.read_sources(spark, str(tmp_path / "f.txt")))[1].first()
    assert told["error"] == "no source could be read: f.txt is not valid UTF-8"


def test_sinks(spark, tmp_path):
    articles = spark.createDataFrame([(1, "# Same\n\nbody"), (2, "# Same\n\nother")], "article_id int, md string")
    sinks.write_article_set(articles, str(tmp_path / "out"), "2024-03-09")
    rows = sinks.read_article_sets(spark, str(tmp_path / "out")).collect()
    assert sorted(r["name"] for r in rows if r["folder"] == "source") == ["2024-03-09-same-2-body.md", "2024-03-09-same-body.md"] and len(rows) == 6
    sinks.write_article_set(spark.createDataFrame([(5, "# Same\n\nthird"), (6, "# Same 2\n\nnamed so")], "article_id int, md string"), str(tmp_path / "out"), "2024-03-09")
    rows = sinks.read_article_sets(spark, str(tmp_path / "out")).collect()
    assert sorted(r["name"] for r in rows if r["folder"] == "final") == [f"2024-03-09-same{x}-final.md" for x in ("-2-2", "-2", "-3", "")] and len(rows) == 12
    failed, worth = sinks.split_failures(spark.createDataFrame([(1, "# T\n\n## H\n\nx"), (2, "no article")], "article_id int, md string"))
    assert failed.count() == 2 and [r["article_id"] for r in worth.collect()] == [1]
    jobs = spark.createDataFrame([(1, "a.pdf", 0, True, "", [], 5)], "job_id int, source string, words int, ok boolean, error string, warnings array<string>, duration_ms int")
    sinks.write_summaries(jobs, str(tmp_path / "jobs"))
    assert json.loads(spark.read.text(str(tmp_path / "jobs")).first()[0]) == {"source": "a.pdf", "ok": True, "duration_ms": 5}
    sinks.write_atomically({str(tmp_path / "x"): b"1", str(tmp_path / "y"): b"2"})
    assert (tmp_path / "x").read_bytes() + (tmp_path / "y").read_bytes() == b"12"
    with pytest.raises(OSError):
        sinks.write_atomically({str(tmp_path / "x"): b"3", str(tmp_path / "none" / "y"): b"4"})
    assert (tmp_path / "x").read_bytes() == b"1" and not [p for p in os.listdir(tmp_path) if p.startswith(".staged")]


def test_two_jobs_publish_at_once(spark, tmp_path, monkeypatch):
    """Both have staged the same stems before either publishes; neither loses a file or a name."""
    path, both, plain = str(tmp_path / "out"), threading.Barrier(2), sinks.publish
    waited = set()

    def together(*args):
        if threading.get_ident() not in waited:
            waited.add(threading.get_ident())
            both.wait(120)
        return plain(*args)

    monkeypatch.setattr(sinks, "publish", together)
    jobs = [spark.createDataFrame([(10 * k + i, "# Same\n\nbody") for i in range(3)] + [(10 * k + 9, f"# Own {k}\n\nbody")], "article_id int, md string") for k in (1, 2)]
    numbers = []
    threads = [threading.Thread(target=lambda job=job: numbers.append(sinks.write_article_set(job, path, "2024-03-09"))) for job in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    rows = sinks.read_article_sets(spark, path).collect()
    assert sorted(numbers) == [0, 1] and len(rows) == 24 and len({(r["folder"], r["name"]) for r in rows}) == 24
    stems = {r["article_id"]: r["name"].removesuffix("-final.md") for r in rows if r["folder"] == "final"}
    assert sorted(stems.values()) == sorted([f"2024-03-09-same{x}" for x in ("", "-2", "-3", "-4", "-5", "-6")] + ["2024-03-09-own-1", "2024-03-09-own-2"])
    for i, stem in stems.items():
        assert {r["name"] for r in rows if r["article_id"] == i} == {stem + e for e in sinks.ENDINGS.values()}
    # a job that breaks off before its entry leaves nothing behind
    monkeypatch.setattr(sinks, "publish", lambda *args: 1 // 0)
    with pytest.raises(ZeroDivisionError):
        sinks.write_article_set(jobs[0], path, "2024-03-09")
    assert sinks.read_article_sets(spark, path).count() == 24 and len(os.listdir(tmp_path / "out" / sinks.SETS)) == 2


def test_scratch_tables(spark):
    from groundling import session

    first, second = session.materialise(spark.range(5), "x"), session.materialise(spark.range(3), "y")
    assert first.count() == 5 and first._groundling_path.startswith(session.shared_dir(spark))
    session.discard(first)
    session.discard(spark.range(1))
    assert not os.path.exists(first._groundling_path.removeprefix("file://")) and second.count() == 3
    assert session.sweep() >= 1 and session.sweep() == 0 and not os.path.exists(second._groundling_path.removeprefix("file://"))


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.concat(F.lit("# "), "text").alias("md"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("ts"))
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = gate.start(gate.house_errors_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    got = {r["doc_id"]: r["errors"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["doc_id"]: r["e"] for r in docs.select("doc_id", house_errors(F.col("md")).alias("e")).collect()}
    counts = gate.violation_counts_stream(stream).writeStream.format("memory").queryName("kinds").outputMode("update").start()
    counts.processAllAvailable()
    counts.stop()
    assert spark.table("kinds").count() > 0


def test_claim_stream(spark, tmp_path):
    raw = 'CLAIM: A b\nSOURCE_QUOTE: "quoted words here"\nTYPE: result\nSTRENGTH: hedged\n---\nCLAIM: a  B\nSOURCE_QUOTE: "quoted words here"\n---\nCLAIM: c\nSOURCE_QUOTE: "not there at all"'
    frame = spark.createDataFrame([(1, "with quoted words here.", raw)], "section_id int, source string, raw string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    records = gate.distinct_claims_stream(gate.verified_claims_stream(stream).where("reason is null"))
    query = records.writeStream.format("memory").queryName("claims").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("claims").count() == 1


def test_generators(spark):
    def flaky(kind, prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("offline")
        return gen.fake_generator(kind, prompts)

    prompts = spark.createDataFrame([(1, "SOURCE\nbad source of twelve words in a row so that it has enough of them"), (2, "SOURCE\n")], "key int, prompt string").repartition(2, "key")
    one = {r["key"]: r for r in gen.generate(prompts, "key", "extract", flaky).collect()}
    assert "RuntimeError: offline" in {r["error"] for r in one.values()}
    two = gen.with_fallback(prompts, "key", "extract", [flaky, gen.fake_generator]).collect()
    assert len(two) == 2 and all(r["error"] == "" for r in two)
    sources = spark.createDataFrame([(1, "a", "Some facts of 12 words that one source states plainly and fully here. More of it."), (2, "b", None)], "source_id int, name string, text string")
    rows = {r["source_id"]: r for r in composing.compose_articles(sources, [gen.fake_generator]).collect()}
    assert rows[1]["verified"] == 1 and rows[1]["article"].startswith("# Report") and "article is" in rows[1]["house"] and rows[2]["sections"] == 0


def test_chain_of_generators():
    calls = []

    def script(name, bad=(), failure=RuntimeError):
        def ask(kind, prompts):
            calls.append((name, list(prompts)))
            if set(prompts) & set(bad):
                raise failure("no")
            return [f"{name}:{p}" for p in prompts]

        return ask

    # the first stops at c, and what follows never sees it again, in this batch or the next
    chain = [script("x", "c"), script("y", "e")]
    rows, cursor = gen.along_chain("extract", list("abcdef"), chain)
    assert [r[0] for r in rows] == ["x:a", "x:b", "y:c", "y:d", "", "y:f"] and cursor == 1
    assert [(r[1], r[2]) for r in rows] == [("", 0), ("", 0), ("", 1), ("", 1), ("RuntimeError: no", 1), ("", 1)]
    calls.clear()
    rows, cursor = gen.along_chain("extract", ["g"], chain, cursor)
    assert rows == [("y:g", "", 1)] and [c[0] for c in calls] == ["y"]
    # who cancels or runs out of time is not sent on, nor asked again
    for stop in (gen.Cancelled, TimeoutError):
        calls.clear()
        rows, cursor = gen.along_chain("extract", list("ab"), [script("x", "b", stop), script("y")])
        assert cursor == 0 and calls == [("x", ["a", "b"])] and [r[1] for r in rows] == [f"{stop.__name__}: no"] * 2
    # answers that do not match their prompts are a failure; nothing asked is nothing answered
    assert gen.along_chain("extract", list("ab"), [lambda k, p: ["one"] if len(p) > 1 else p])[0] == [("a", "", 0), ("b", "", 0)]
    assert gen.along_chain("extract", [], chain) == ([], 0)


def test_chain_stands_across_batches(spark):
    def dead(kind, prompts):
        raise RuntimeError("offline")

    def picky(kind, prompts):
        if any(p == "p7" for p in prompts):
            raise RuntimeError("p7")
        return [p.upper() for p in prompts]

    asked = spark.range(40).select(F.col("id").alias("key"), F.when(F.col("id") != 9, F.format_string("p%d", "id")).alias("prompt")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        rows = {r["key"]: r for r in gen.with_fallback(asked, "key", "extract", [dead, picky]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 40 and {r["generator"] for r in rows.values()} == {1}
    assert {k: r["error"] for k, r in rows.items() if r["error"]} == {7: "RuntimeError: p7"}
    assert rows[8]["text"] == "P8" and rows[9]["text"] == "" and gen.with_fallback(asked.limit(0), "key", "extract", [dead]).count() == 0


def test_stems_are_free(spark):
    rows = [(1, "a"), (2, "a"), (3, "a-2"), (4, "a"), (5, "a-2"), (6, "a-2-2"), (7, "b"), (8, "a-02"), (9, "a"), (10, "a-4")]
    frame = spark.createDataFrame(rows, "article_id int, base string")
    got = {r["article_id"]: r["stem"] for r in unique_stems(frame, F.col("base")).collect()}
    assert len(set(got.values())) == 10 and [got[k] for k in (1, 2, 3, 4, 5, 6, 9)] == ["a", "a-3", "a-2", "a-5", "a-2-3", "a-2-2", "a-6"]
    taken = spark.createDataFrame([("a",), ("a-3",), ("b-2",)], "stem string")
    got = {r["article_id"]: r["stem"] for r in unique_stems(frame, F.col("base"), taken).collect()}
    assert len(set(got.values())) == 10 and not {"a", "a-3", "b-2"} & set(got.values()) and got[7] == "b" and got[1] == "a-5"


def test_ranks_of_a_hot_group(spark):
    rows = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), F.lit(1).alias("_x")).orderBy(F.rand(1))
    got = ranking.ranked(rows, "g", "id", slices=16)
    nth, seen = {r["id"]: r["nth"] for r in got.collect()}, {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert nth[r["id"]] == seen[r["g"]]
    assert len(nth) == 6000 and got.columns == ["id", "g", "_x", "nth"] and ranking.ranked(rows.limit(0), "g", "id").count() == 0


def test_stems_of_one_title(spark):
    """Half of all articles have one title whose numbers an earlier run took, in runs and alone."""
    taken = {"t"} | {f"t-{k}" for k in [*range(2, 900), 905, 907, *range(1200, 1300)]}
    rows = [(k, "t" if k % 2 else f"t-{k}" if k % 5 == 0 else f"u{k}") for k in range(1, 1001)] + [(2000, None), (2001, "")]
    got = {r["article_id"]: r["stem"] for r in unique_stems(spark.createDataFrame(rows, "article_id int, base string"), F.col("base"), spark.createDataFrame([(x,) for x in taken], "stem string")).collect()}
    gone, k, want = taken | {b for _, b in rows}, 2, []
    for _ in range(500):
        while f"t-{k}" in gone:
            k += 1
        want.append(f"t-{k}")
        k += 1
    assert [got[i] for i in range(1, 1001, 2)] == want and len(set(got.values())) == 1002 and not taken & set(got.values())
    assert (got[2000], got[2001]) in (("", "-2"), ("-2", "")) and got[2000] == ""


def test_open_texts_are_continued(spark):
    asked = []

    def closing(kind, texts):
        return ["and it ends here." if "slow" not in t else "still slow" for t in texts]

    def failing(kind, texts):
        raise RuntimeError("offline")

    frame = spark.createDataFrame([(1, "It is closed."), (2, "It goes on \n"), (3, "One. Two slow"), (4, ""), (5, "never closed slow")], "key int, text string")
    got = {r["key"]: r["text"] for r in gen.continue_until_closed(frame, "key", closing, lambda c: c, 2).collect()}
    assert got == {1: "It is closed.", 2: "It goes on and it ends here.", 3: "One.", 4: "", 5: "never closed slow still slow still slow"}
    got = {r["key"]: r["text"] for r in gen.continue_until_closed(frame, "key", failing, lambda c: c).collect()}
    assert got[2] == "It goes on \n" and got[3] == "One." and not asked


def test_failed_and_resumed_sources(spark):
    text = "Some facts of 12 words that one source states plainly and fully here. More of it."

    def flaky(kind, texts):
        if kind == "extract" and any("unreadable" in t for t in texts):
            raise RuntimeError("offline")
        return gen.fake_generator(kind, texts)

    sources = spark.createDataFrame([(1, "a", text), (2, "b", "unreadable " + text), (3, "c", text.replace("12", "13")), (4, "d", None)], "source_id int, name string, text string").repartition(4, "source_id")
    saved = spark.createDataFrame([(3, 'CLAIM: It has 13 words\nSOURCE_QUOTE: "facts of 13 words that one source"\nTYPE: result\nSTRENGTH: hedged\n---\nCLAIM: gone\nSOURCE_QUOTE: "this is no longer there"\n---'), (1, 'CLAIM: old\nSOURCE_QUOTE: "nothing of this stands there"\n---')], "source_id int, raw string")
    rows = {r["source_id"]: r for r in composing.compose_articles(sources, [flaky], saved=saved).collect()}
    assert rows[2]["failed"] == 1 and rows[2]["article"] == "" and rows[2]["error"].startswith("claim extraction failed: RuntimeError")
    assert rows[3]["resumed"] and (rows[3]["verified"], rows[3]["dropped"]) == (1, 1) and "It has 13 words" in rows[3]["article"]
    assert not rows[1]["resumed"] and rows[1]["verified"] == 1 and rows[1]["article"] and rows[4]["sections"] == 0 and rows[4]["error"] == ""


def test_reviews_are_gated(spark):
    body = "# T\n\nThe cat sat on the mat. It was plain."
    answers = {1: '[{"find": "plain", "replace": "simple", "reason": "generic"}]', 2: '[{"find": "plain", "replace": "robust", "reason": "generic"}]', 3: "no edits", 4: "[]", 5: '[{"find": "absent", "replace": "x", "reason": "filler"}]', 6: None}

    def editor(kind, texts):
        return [next(a for k, a in answers.items() if f"article {k}" in t) for t in texts]

    def failing(kind, texts):
        raise RuntimeError("offline")

    drafts = spark.createDataFrame([(k, f"---\ntitle: x\n---\n{body} article {k}.") for k in answers], "article_id int, md string")
    claims = spark.createDataFrame([(1, 1, "a", "b", "result", "hedged")], "article_id int, ord int, claim string, source_quote string, type string, strength string")
    research = spark.createDataFrame([(1, "source text")], "article_id int, research string")
    rows = {r["article_id"]: r for r in composing.review_articles(drafts.where("article_id < 6"), claims, research, editor).collect()}
    rows |= {r["article_id"]: r for r in composing.review_articles(drafts.where("article_id = 6"), claims, research, failing).collect()}
    assert rows[1]["saved"] == f"---\ntitle: x\n---\n\n{body.replace('plain', 'simple')} article 1.\n" and rows[1]["kept"] > 0
    assert rows[2]["saved"] is None and rows[2]["error"] == "the edited article broke the rules" and "robust" in rows[2]["output"]
    assert rows[3]["error"] == "no edits could be read from the answer" and rows[3]["output"] == "no edits"
    assert rows[4]["saved"].endswith("article 4.\n") and rows[4]["error"] == "" and rows[5]["error"] == "edits failed to apply"
    assert rows[6]["saved"] is None and rows[6]["error"].startswith("review failed")


def test_processing_twice_changes_nothing(spark):
    text = "# A title\n\nSome text of the article about models.\n\n## H\n\nMore."
    files = spark.createDataFrame([(1, "/out/source/2024-01-05-a-title-body.md", f"---\nslug: own\n---\n{text}", "layout: post\n")], "article_id int, path string, md string, adjacent string")
    day = F.to_date(F.lit("2024-03-09"))
    once = running.process_files(files, day).first()
    assert once["final_path"] == "/out/final/2024-01-05-a-title-final.md" and "slug" in once["final"] or once["error"] == ""
    assert "layout: post\n" in once["front"] and "/2024-01-05-a-title" in once["front"]
    again = spark.createDataFrame([(1, once["final_path"], once["final"], once["front"])], files.schema)
    twice = running.process_files(again, day).first()
    assert [twice[c] for c in ("body", "front", "final", "body_path")] == [once[c] for c in ("body", "front", "final", "body_path")]


def test_site_settings():
    site = md.site_from({"GROUNDLING_SITE_NAME": " N ", "GROUNDLING_SITE_COPYRIGHT_FROM": "x", "GROUNDLING_SITE_CDN": "  "})
    assert site.name == "N" and site.copyright_from == md.Site().copyright_from and site.cdn == md.Site().cdn
    assert md.site_from({"GROUNDLING_SITE_COPYRIGHT_FROM": "2019"}).copyright_from == 2019


def test_sectioning_in_one_pass_equals_the_columns(spark):
    blank = [" ", "\n", "\t", "\r", ""]
    import random

    rng = random.Random(3)
    words = ["References", "REFERENCES", "## Appendix", "####### appendix", "acknowledgments", "Results", "Methods", "Method", "text. More", "\n\n", "# ", "références", "ſ", "\u0130", "x" * 3000, "bibliographyx", "bibliography", "Abstract"]
    texts = ["".join(rng.choice(words) + rng.choice(blank) + rng.choice(["\n", " ", "\r\n"]) for _ in range(rng.randrange(14))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    parts = frame.select("k", sections.split_headings(sections.drop_references(tx.text("t"))).alias("p")).collect()
    cut = cutting.sectioner(sections.HEADINGS, sections.STOPS, "\t\n\f\r ")
    for r in parts:
        assert cut(texts[r["k"]]) == [piece for part in r["p"] for piece in cutting.cut_part(part)], texts[r["k"]]
    long = ("word. " * 900 + "\n\n") * 60 + "é" * 6000
    pieces = cutting.cut_part(long)
    assert all(len(p.encode()) <= cutting.SECTION_BYTES for p in pieces) and "".join("".join(pieces).split()) == "".join(long.split())


def test_rest_works_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'house_errors' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)
