from pyspark.sql import functions as F

from groundling.operators import claims as cl

SOURCE = "The model reached 0.82 accuracy on the held-out set.\nIt costs 1,000 units per “run”. Éric said so in 漢字テスト集合研究論文要旨."


def block(claim, quote, kind="result", strength="demonstrated"):
    return f'CLAIM: {claim}\nSOURCE_QUOTE: "{quote}"\nTYPE: {kind}\nSTRENGTH: {strength}\n---\n'


def verify(spark, raws, source=SOURCE):
    frame = spark.createDataFrame([(i, source, r) for i, r in enumerate(raws)], "section_id int, source string, raw string")
    return {(r["section_id"], r["ord"]): r for r in cl.verify(cl.parse(frame)).collect()}


def test_reasons_in_order(spark):
    quote = "reached 0.82 accuracy on"
    cases = [
        (block("", quote), "missing claim or quote"),
        (block("x", "0.82"), "quote too short"),
        (block("x", "reached � accuracy on"), "quote contains a replacement character"),
        (block("x", "words that it never has"), "quote not found in source"),
        (block("x", "accuracy on the"), "quote is a truncated fragment"),
        (block("x", "reached 0.82 accuracy", "opinion"), "invalid TYPE 'opinion'"),
        (block("x", "reached 0.82 accuracy", " Metric ", "sure"), "invalid STRENGTH 'sure'"),
        (block("0.820 and 7 units", "reached 0.82 accuracy"), "claim numbers absent from quote: 0.820, 7"),
        (block("1000 units", "1,000 units per \"run\""), None),
        (block("x", "ÉRIC said so"), None),
        (block("x", "漢字テスト集合研究論文要"), None),
        (block("x", "reached 0.82 accuracy", "", ""), None),
    ]
    got = verify(spark, [c[0] for c in cases])
    assert [got[i, 0]["reason"] for i in range(len(cases))] == [c[1] for c in cases]


def test_blocks_and_fields(spark):
    raw = "Preamble\n---\nCLAIM: one\n  two \nTYPE: metric\nCLAIM: later\nSOURCE_QUOTE: \"\"quoted\"\"\n---  \n\n---\nSTRENGTH: hedged"
    got = verify(spark, [raw, "NONE", "", None, "NONE."])
    assert sorted(got) == [(0, 0), (0, 1), (0, 2), (4, 0)]
    assert (got[0, 1]["claim"], got[0, 1]["type"], got[0, 1]["source_quote"]) == ("one\ntwo", "metric", "quoted")
    assert got[0, 2]["strength"] == "hedged" and got[0, 0]["claim"] == ""


def test_dedupe_keeps_the_first(spark):
    rows = spark.createDataFrame([(2, 0, "A  b"), (1, 5, " a B"), (1, 6, "c")], "section int, ord int, claim string")
    assert sorted((r["section"], r["ord"]) for r in cl.dedupe(rows, ["section", "ord"]).collect()) == [(1, 5), (1, 6)]


def test_ledger_round_trip_and_budget(spark):
    frame = spark.createDataFrame([(0, SOURCE, block("x", "reached 0.82 accuracy") + block("y", "nowhere to be found")), (1, SOURCE, "NONE.")], "section_id int, source string, raw string")
    ledgers = {r["section_id"]: r["ledger"] for r in cl.render_ledger(cl.verify(cl.parse(frame))).collect()}
    assert "Verified records: 1\nDropped records with unverifiable SOURCE_QUOTE: 1\n\nCLAIM: x\n" in ledgers[0] and ledgers[1].endswith("NONE\n")
    saved = spark.createDataFrame([(0, ledgers[0], SOURCE), (1, ledgers[0], "changed"), (2, "no claims", SOURCE)], "section_id int, raw string, source string")
    again = {r["section_id"]: r["reason"] for r in cl.resume(saved).collect()}
    assert again == {0: None, 1: "quote not found in source"}
    records = spark.range(60).select(F.lit(1).alias("ledger_id"), F.col("id").alias("ord"), *(F.lit("x").alias(k) for k in cl.FIELDS))
    assert cl.budget(records).count() == 45
    assert cl.budget(records, 45, 39 + 26 + 2 * len('CLAIM: x\nSOURCE_QUOTE: "x"\nTYPE: x\nSTRENGTH: x\n---\n')).count() == 2
