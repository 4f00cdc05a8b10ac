"""Spelling variants: words one insertion, deletion or replacement apart, and the form that each goes back to.

Near words are found by a rare-first prefix filter on q-grams. A word's
bigrams with their places are put in one global order, the rarest bigram
first. One edit changes at most two bigrams of a word, so the three rarest of
a word hold one that its near word has too, and the first of these is among
that word's three rarest as well: only those three are joined. Its place is
limited: a bigram that the edit leaves alone stands either before the edit,
at the same distance from the beginning and with the same text before it, or
after the edit, at the same distance from the end and with the same text
behind it. That text is part of the key, which keeps apart words that share
no more than a bigram. Of words that meet, those without an equal half differ
by more than one edit; Spark's edit distance verifies the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.session import discard, materialise

#: Bigrams that are joined: two that an edit may change, and one.
PREFIX = 3
#: Hashes that keep most words which share a key from the edit distance, see :func:`_halves`.
HALVES = ["head", "tail", "shorter_head", "shorter_tail"]
#: Fixed values of the query: runs of these characters are words, and only A-Z fold to lower case.
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spelled_words(docs: DataFrame, every: int = 97, text_col: str = "text", id_col: str = "doc_id", shortest: int = 1) -> DataFrame:
    """Every run of ``shortest`` letters or more of every whole text, one row each (``word``); of one in ``every`` runs a character is missing.

    Which ones, and which character, follows from the crc32 of id and run. A
    null id is an empty one; a null text has no runs.
    """
    # a match begins where its run begins, so it is the whole run
    pattern = RUN.removesuffix("+") + f"{{{shortest},}}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(pattern), F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """``word`` and its number ``n`` for words of ``shortest`` characters and ``least`` rows or more."""
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _halves() -> list[Column]:
    """Hashes of a word's two halves, and of the two halves that are left of it without the character between them.

    An edit leaves one half of a word alone: of two words of one length either
    the first or the second halves are equal, and where one word is longer,
    either half of the shorter one is the same half of the longer one without
    the middle character (the first of its second half).
    """
    size = F.col("size")
    half, less = F.floor(size / 2), F.floor((size - 1) / 2)
    return [F.hash(part).alias(name) for name, part in zip(HALVES, (F.left("word", half), F.right("word", size - half), F.left("word", less), F.right("word", size - 1 - less)), strict=True)]


def _keys(counts: DataFrame) -> DataFrame:
    """Two rows for each of a word's three rarest bigrams: key (side, and the text up to its end or from its start), word, n, size."""
    size = F.char_length("word")
    grams = counts.select("word", "n", size.alias("size"), F.explode(F.sequence(F.lit(1), size - 1)).alias("at")).withColumn("gram", F.substring("word", F.col("at"), F.lit(2)))
    # two characters of a fixed alphabet: the table of bigrams is bounded
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    placed = grams.join(often, "gram")
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("often", "gram", "at"))), 1, PREFIX)  # of the bigrams of one word
    chosen = placed.groupBy("word", "n", "size").agg(rarest.alias("rarest")).select("word", "n", "size", *_halves(), F.explode("rarest.at").alias("at"))
    before = F.concat(F.lit("<"), F.substring("word", F.lit(1), F.col("at") + 1))
    after = F.concat(F.lit(">"), F.substring("word", F.col("at"), F.col("size")))
    return chosen.select("word", "n", "size", *HALVES, F.explode(F.array(before, after)).alias("key"))


def near_words(counts: DataFrame) -> DataFrame:
    """All ordered pairs of words of ``counts`` one edit apart: word, n, near, near_n. Words have two characters or more."""
    keys = materialise(_keys(counts), "spelling-keys")
    left = keys.select("key", "word", "n", "size", "head", "tail")
    right = keys.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("size").alias("near_size"), *(F.col(c).alias(f"near_{c}") for c in HALVES))
    replaced = (F.col("near_size") == F.col("size")) & ((F.col("head") == F.col("near_head")) | (F.col("tail") == F.col("near_tail"))) & (F.col("word") < F.col("near"))
    longer = (F.col("near_size") == F.col("size") + 1) & ((F.col("head") == F.col("near_shorter_head")) | (F.col("tail") == F.col("near_shorter_tail")))
    met = left.join(right, "key").where((replaced | longer) & (F.levenshtein("word", "near", 1) == 1))
    pairs = met.select("word", "n", "near", "near_n").distinct()
    turned = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(turned)


def spelling_groups(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``counts`` (``word``, ``n``; words distinct).

    ``form`` is the near word of largest ``n`` (of several the first by code
    point) if that is ``ratio`` times the word's at least, else null; ``root``
    is where forms lead. ``ratio`` is 2 or more, so that the way to a root is
    at most as long as the counts double.
    """
    counts = materialise(counts.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = near_words(counts).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    follows = -F.col("best.less") >= ratio * F.col("n")
    joined = counts.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.less")).cast("long").alias("form_n"))
    table = materialise(joined, "spelling-forms")
    longest = table.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0].bit_length()  # steps of a way: each doubles n
    roots = materialise(table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-roots")
    steps = 1
    while steps < longest:  # each turn doubles how far a root looks
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = materialise(roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        moved = after.where("moved").limit(1).count()
        discard(roots)
        roots, steps = after.select("word", "root"), 2 * steps
        if not moved:
            break
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97, ratio: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Groups of the words of all whole texts, see :func:`spelled_words`, :func:`word_counts` and :func:`spelling_groups`.

    Rows that repeat count each; other columns are ignored; a table without
    words has no rows.
    """
    return spelling_groups(word_counts(spelled_words(docs, every, text_col, id_col, shortest), shortest, least), ratio)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_spelling": op13_spelling}
#: The crc32 that takes characters away is no function of the SQL; tests hold the whole result against loops.
ORACLE_SQL: dict[str, str] = {}
