import json

import pytest
from pyspark.sql import functions as F

from groundling.functions import text as tx
from groundling.operators import edits, faithfulness, metadata, planning, repair, rules, streams
from groundling.operators.sections import split_sections

BODY = "It works. " * 300
VALID = f'# Title\n\n<aside class="post-lead"></aside>\n\n> **Executive Summary**\n> - One.\n\n## Part\n\n{BODY}'


def errors(spark, md):
    return spark.createDataFrame([(md,)], "md string").select(rules.house_errors(tx.text("md")).alias("e")).first()["e"]


@pytest.mark.parametrize(
    ("md", "wanted"),
    [
        (VALID, []),
        (VALID[2:], ["body-only mode must start with a Markdown H1"]),
        (VALID.replace("<aside", "<div"), ["missing post-lead aside"]),
        (VALID.replace("Executive", "Short"), ["missing Executive Summary"]),
        (VALID.replace("## Part", "Part"), ["missing section headings"]),
        (VALID.replace("## Part", "## Part\n\n### ..."), ["contains an unfilled skeleton placeholder (title, heading, or thesis)"]),
        (VALID + " \U0001f680", ["contains emoji"]),
        (VALID + " We DELVE, delved; seamlessly. Moreover, that said", ["contains banned words: delve, delved, seamlessly", "contains banned phrases: moreover, that said"]),
        (VALID + "word " * 3000, ["article is 3610 words; maximum is 3000"]),
        (None, None),
    ],
)
def test_house_rules(spark, md, wanted):
    got = errors(spark, md)
    if md is None:
        assert got[0] == "body-only mode must start with a Markdown H1" and "article is 0 words; minimum is 500" in got
    else:
        assert got == wanted


def facts(spark, md, claims):
    a = spark.createDataFrame([(1, md)], "article_id int, md string")
    c = spark.createDataFrame([(1, k, *r) for k, r in enumerate(claims)], "article_id int, ord int, claim string, source_quote string, type string, strength string")
    row = faithfulness.faithfulness(a, c).first()
    return row["errors"], row["warnings"]


CLAIMS = [("Training reached 0.98 bpb on certain data", "reached 0.98 bpb", "metric", "demonstrated"), ("Scaling might improve translation quality", "might improve", "result", "hedged")]


def test_faithfulness(spark):
    assert facts(spark, "It got 0.98 bits per byte.", CLAIMS) == ([], [])
    assert facts(spark, "The CER is low.", CLAIMS) == ([], [])  # grounded by "certain"
    assert facts(spark, "The F1 is 999", CLAIMS)[0] == ["uses metric term 'f1' that appears in no claim (possible conversion)", "article appears truncated (does not end on sentence punctuation)"]
    assert facts(spark, "Number 999 and 1.", CLAIMS)[1] == ["numbers not found in any claim: 1, 999"]
    assert facts(spark, "This proves that scaling improves translations.", CLAIMS)[1] == ['possible hedge upgrade: "This proves that scaling improves translations."']
    para = " ".join(f"word{k}" for k in range(30)) + "."
    assert facts(spark, f"{para}\n\n# {para}\n\n{para}", CLAIMS)[0] == [f'near-duplicate paragraph (>= 80% overlap with an earlier one): "{para[:70]}"...']
    assert facts(spark, "\n\n".join([para] * 5), CLAIMS)[0] == ["4 paragraphs nearly duplicate earlier ones (>= 80% overlap); give each section distinct content"]


def test_jaccard_border_is_inclusive(spark):
    words = [f"w{k}" for k in range(39)]  # 36 shingles
    other = words[:36] + ["a", "b", "c"]  # 33 of 36 in common: 33 / 39 < 0.8 is false
    exact = words[:35] + ["p", "q", "r", "s"]  # 32 / 40 is 0.8 exactly
    for second, found in ((other, True), (exact, True), (words[:34] + list("pqrst"), False)):
        a = spark.createDataFrame([(1, " ".join(words) + "\n\n" + " ".join(second))], "article_id int, md string")
        assert (faithfulness.near_duplicate_paragraphs(a).count() == 1) is found


def test_edits(spark):
    md = "One bad word. Two good ones. One end."

    def run(edits_):
        response = f"<think>[]</think> {json.dumps(edits_)} thanks"
        frame = spark.createDataFrame([(1, md, response)], "article_id int, md string, response string")
        return edits.apply_edits(frame.select("article_id", "md", edits.parse_edits(F.col("response")).alias("edits"))).first()

    e = lambda find, to, reason="generic": {"find": find, "replace": to, "reason": reason}
    assert run([e("Two", "Three"), e("bad word", "é")])["md"] == "One é. Three good ones. One end."
    assert run([])["applied"] and run([])["md"] == md
    for bad in ([e("One", "x")], [e("", "x")], [e("Two", "x", "why")], [e("Two good", "x"), e("good ones", "y")], [e("zzz", "x")], [{"find": 1, "replace": "x", "reason": "generic"}]):
        row = run([e("end", "fin"), *bad])
        assert (row["md"], row["applied"]) == (md, False)
    broken = spark.createDataFrame([("[{]",), ("none",), ('[{"find": "a"}] ]',)], "r string").select(edits.parse_edits(F.col("r")).alias("e")).collect()
    assert all(r["e"] is None for r in broken)


def test_new_violations(spark):
    frame = lambda e: spark.createDataFrame([(1, e)], "article_id int, errors array<string>")
    before = ["article is 510 words; minimum is 600", "contains banned words: delve, realm", "contains emoji"]
    after = ["article is 400 words; minimum is 600", "contains banned words: realm, robust", "contains emoji", "missing section headings"]
    got = sorted(r["message"] for r in edits.new_violations(frame(before), frame(after)).collect())
    assert got == ["contains banned words: realm, robust", "missing section headings"]


def test_sections(spark):
    def run(text):
        rows = split_sections(spark.createDataFrame([(1, "p", text)], "k int, name string, text string"), "k", F.col("name"), tx.text("text")).collect()
        return [r["body"] for r in sorted(rows, key=lambda r: r["section"])]

    assert run("Intro text\nMethods\nwe did\nMethodology not\nReferences\n[1] x") == ["Intro text", "Methods\nwe did\nMethodology not"]
    assert run("References\n[1] only") == [] and run("  \n") == [] and run(None) == []
    long = ("a" * 3000) + "\n\n" + ("b" * 3000)
    assert run(long) == ["a" * 3000, "b" * 3000]
    dots = ("a" * 3000) + ". " + ("b" * 3000)
    assert run(dots) == ["a" * 3000, ". " + "b" * 3000]
    assert all(len(p.encode()) <= 4500 for p in run("é" * 9000)) and "".join(run("é" * 9000)) == "é" * 9000


def test_metadata(spark):
    md = '---\ntitle: Kept\n---\n# A [link](x) on *agents*\n\n<p class="deck">The deck here.</p>\n\n<p class="post-lead-tldr"><strong>TL;DR.</strong> Short form.</p>\n\nagents agents ledger ledger ledger audit'
    row = metadata.extract_metadata(spark.createDataFrame([(1, md)], "article_id int, md string")).first()
    assert (row["title"], row["subtitle"], row["description"], row["excerpt"], row["slug"]) == ("A link on agents", "The deck here.", "Short form.", "The deck here.", "a-link-on-agents")
    assert row["category"] == "AI" and row["keywords"].startswith("link, agents, ledger")
    front = metadata.render(spark.createDataFrame([(1, md)], "article_id int, md string"), metadata.Site(), F.to_date(F.lit("2024-03-09"))).first()["front"]
    assert front.startswith("---\n\n") and front.endswith("\n---") and "\ntitle: Kept\n" in front and "date: \"March 9, 2024\"" in front and 'item_pub_date: "Sat, 09 Mar 2024 00:00:00 +0000"' in front


def test_echo(spark):
    style = "A long calibration paragraph that sets the tone of all that follows here."
    a = spark.createDataFrame([(1, f"# {style}\n\n{style.replace(' ', chr(10), 2)}\n\nkept")], "article_id int, md string")
    out = repair.strip_echo(a, spark.createDataFrame([(1, f"x # {style} y")], "article_id int, style string")).first()["md"]
    assert out == f"# {style}\n\nkept"


@pytest.mark.parametrize(("n", "least", "most"), [(0, 500, 650), (1, 500, 650), (6, 757, 1010), (20, 1912, 2550), (60, 2250, 3000), (500, 2250, 3000)])
def test_budget(spark, n, least, most):
    a, b = planning.write_budget(F.lit(n))
    assert tuple(spark.range(1).select(a.alias("a"), b.alias("b")).first()) == (least, most)


def test_streams(spark):
    lines = [(1, 0, "{bad"), (1, 1, '{"type":"stream_event","event":{"type":"content_block_delta","delta":{"type":"text_delta","text":"Hi"}}}'), (1, 2, '{"type":"result","result":" "}'), (2, 0, '{"type":"result","is_error":true}')]
    got = {r["job"]: r for r in streams.assemble_stream(spark.createDataFrame(lines, "job int, pos int, line string")).collect()}
    assert (got[1]["text"], got[2]["error"]) == ("Hi", "provider reported an error")
    lines = [(1, 0, '{"response":"a"}'), (1, 1, '{"response":"b","done":true,"done_reason":"length"}'), (1, 2, '{"response":"c"}'), (2, 0, '{"response":"a"}'), (2, 1, "oops")]
    got = {r["job"]: r for r in streams.assemble_ndjson(spark.createDataFrame(lines, "job int, pos int, line string")).collect()}
    assert (got[1]["text"], got[1]["truncated"], got[2]["text"], got[2]["error"]) == ("ab", True, "a", "invalid line")
