import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundling.functions import cutting, styling
from groundling.functions import text as tx
from groundling.functions import vocabulary as v


def apply(spark, expression, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", expression(tx.text("s")).alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize(
    ("expression", "given_", "wanted"),
    [
        (tx.normalise_space, ["a\r\nb\rc", "\n\n\n\n\nx\n\n\n\n\ny \x85", None], ["a\nb\nc", "x\n\n\ny", ""]),
        (tx.normalise_claim, ["“It’s”  A\tTEST", "ÉÀ"], ["\"it's\" a test", "éà"]),
        (tx.clean_output, ["\x1b[1;31mred\x1b[0m\r\n\x07x\x7f\ty"], ["red\nx\x7f\ty"]),
        (tx.strip_thinking, ["<think>a</think>\n junk\n  # T\nbody ", "no heading ", "#\n# \nx"], ["# T\nbody", "no heading", "#\n# \nx"]),
        (tx.strip_placeholders, ["**Opening Thesis paragraph.** Real", "**...**\nx", "## …\ny", "# ...\nz"], ["Real", "x", "y", "# ...\nz"]),
        (tx.clean_text, ["<b>[a *b*](http://x)</b>\r\n c_d"], ["a b cd"]),
        (tx.slugify, ["Hello, World!", "--", "é", "a" * 89 + " b"], ["hello-world", "untitled-article", "untitled-article", "a" * 89]),
        (tx.quote_yaml, ['a "b" \\ c\n\x07\x7fd'], ['"a \\"b\\" \\\\ c d"']),
        (tx.extract_title, ["x\n#  T t \ny", "none", "#\nnext"], ["T t", "untitled-article", "next"]),
        (tx.trim_sentence, ["One. Two 3.1 and", "no end", 'He said “go.”  x'], ["One.", "", "He said “go.”"]),
        (tx.ends_sentence, ["a.", "a---", "a”", "a", "a,", ""], [True, True, True, False, False, False]),
        (lambda c: tx.truncate_word(c, 10), ["short", "hello big world", "ééééééééé", "x" * 20], ["short", "hello big", "ééééé", "x" * 10]),
        (lambda c: tx.clip_bytes(c, 5), ["éééé", "漢字x", "\U0001f680\U0001f680"], ["éé", "漢", "\U0001f680"]),
        (tx.numbers, ["1,000 and 1000, 0.820 of 3.1.4"], [["0.820", "1000", "3.1.4"]]),
        (tx.word_count, ["it's état-1 漢字", ""], [5, 0]),
    ],
)
def test_expressions(spark, expression, given_, wanted):
    assert apply(spark, expression, given_) == wanted


def test_word_borders_are_ascii(spark):
    found = apply(spark, lambda c: F.regexp_count(c, F.lit(tx.bounded("ai"))), ["ai éai aié a_ai AI", "ai"])
    assert found == [3, 1]


def test_vocabulary_is_closed():
    assert (len(v.BANNED_WORDS), len(v.BANNED_PHRASES), len(v.REPLACEMENTS), len(v.METRIC_TERMS), len(v.ASSERTIVE_VERBS), len(v.WRITER_STOPWORDS)) == (28, 23, 51, 13, 15, 58)
    assert set(v.REPLACEMENTS) == {*v.BANNED_WORDS, *v.BANNED_PHRASES}
    banned = {*v.banned_forms(), *v.BANNED_PHRASES}
    assert not banned & {v.inflect(to, kind) for to in v.REPLACEMENTS.values() for kind in v.KINDS}


@pytest.mark.parametrize(("word", "kind", "form"), [("leverage", "ing", "leveraging"), ("box", "s", "boxes"), ("use", "ed", "used"), ("basic", "ly", "basically"), ("gentle", "ly", "gently"), ("busy", "ly", "busily"), ("gray", "ly", "grayly"), ("x", "base", "x")])
def test_inflection(word, kind, form):
    assert v.inflect(word, kind) == form


def test_style_repair():
    assert styling.repair("We LEVERAGE it. Leveraging tools; leverages.") == "We Use it. Using tools; uses."
    assert styling.repair("In the realm of art, at its core.") == "In art, essentially."
    assert styling.repair("a deleverage and éleverage") == "a deleverage and éuse"
    assert styling.repair("plain") == "plain"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.é漢 \n", max_size=300))
def test_cut_keeps_bytes_and_limit(text):
    pieces = cutting.cut_part(text, 40)
    assert all(len(p.encode()) <= 40 and p for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())
