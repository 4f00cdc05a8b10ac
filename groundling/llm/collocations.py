"""Phrase collocations.

How often a phrase occurs is counted exactly, but only for phrases that may be
frequent enough:

1. Texts become blocks of one language: pieces of lower-case words, with one
   blank around every word and a line feed between pieces.
2. A count sketch bounds every phrase from above. Its cells are numbers of so
   many bits that, however long the corpus is, few cells hold more than one
   phrase; so it is never in one place: a block sends its sorted cells, with
   counts that stop at the threshold, to the ranges that own them, and hears
   one bit for each of them: whether the cell reaches the threshold.
   ``FAN_OUT`` blocks meet at each range, are merged and sent on, level by
   level, as long as there are more.
3. The phrases of a block whose cells do are compiled into an automaton with
   the blank as guard on both sides, which counts all occurrences in that
   block, also those that overlap. An automaton is as large as its block.
4. The sums over all blocks, and not the sketch, decide which phrases are
   candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundling.llm import textkernel as tk
from groundling.llm.lm_scoring import _cut, _planes, _sorted_blob, _sorted_keys, _values, levels
from groundling.session import discard, materialise

BLOCK_BYTES = 3 << 20
#: Blocks whose counts are added before they are shuffled.
BLOCKS_PER_TASK = 16
#: Blocks that meet at one range of a level.
FAN_OUT = 256
#: Phrases to each range of the last level.
KEYS_PER_RANGE = 4_000_000
#: Bits of a cell's number beyond those that number all phrases: the chance that two share a cell is 2 to minus this.
SPARE_BITS = 6
#: Shuffle partitions at most; groups, not partitions, bound a task's memory.
MOST_PARTITIONS = 4096
#: Fixed values of the query: A-Z fold to a-z; these bytes end a piece, those end a word.
PIECE_ENDS, WORD_ENDS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[ord("A") : ord("Z") + 1] += 32
_ENDS_PIECE, _ENDS_WORD = np.zeros(256, bool), np.zeros(256, bool)
_ENDS_PIECE[list(PIECE_ENDS)] = True
_ENDS_WORD[list(PIECE_ENDS + WORD_ENDS)] = True

BLOCK = "block long, lang string, n_words long, text binary"


def normal_text(raw: np.ndarray, off: np.ndarray) -> tuple[bytes, int]:
    """Texts that lie one behind the other as pieces of words, and the number of words."""
    folded = _FOLDED[raw]
    ends = _ENDS_WORD[folded]
    head = np.zeros(len(raw) + 1, bool)
    head[off] = True
    inside = ~ends
    begins = inside.copy()
    begins[1:] &= ends[:-1] | head[1:-1]
    n = np.count_nonzero(begins)
    if not n:
        return b"", 0
    start = np.flatnonzero(begins)
    # a piece begins with the first word after a border
    border = np.cumsum(_ENDS_PIECE[folded]) + np.cumsum(head[:-1])
    new = np.ones(n, bool)
    new[1:] = np.diff(border[start]) > 0
    # one blank before every word; blank, line feed, blank where a piece begins
    before = np.where(new, 3, 1)
    before[0] = 2
    word = np.cumsum(begins) - 1
    letters = np.flatnonzero(inside)
    shift = np.cumsum(before)
    total = len(letters) + int(shift[-1]) + 2
    out = np.full(total, 0x20, np.uint8)
    place = np.arange(len(letters)) + shift[word[letters]]
    out[place] = folded[letters]
    first = place[np.searchsorted(letters, start[new])]
    out[first - 2] = 0x0A
    out[-1] = 0x0A
    return out.tobytes(), n


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of normal text (lang, text): one row for each language of about ``block_bytes``, or of one longer document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[tuple[bytes, int]]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal number
            texts = held.pop(lang)
            del sizes[lang]
            row = (number, lang, sum(n for _, n in texts), zstandard.ZstdCompressor(level=3).compress(b"".join(t for t, _ in texts)))
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["block", "lang", "n_words", "text"])

        for part in tk.slices(batches, "text", min(tk.SLICE_BYTES, block_bytes)):
            langs = np.asarray(part.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                own = part.column("text").take(pa.array(np.flatnonzero(langs == lang))) if (langs != lang).any() else part.column("text")
                text, n = normal_text(*tk.utf8(own))
                held.setdefault(lang, []).append((text, n))
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= block_bytes:
                    yield flush(lang)
            while sum(sizes.values()) >= 4 * block_bytes:
                yield flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield flush(lang)

    return docs.mapInArrow(run, BLOCK)


class Phrases:
    """The distinct phrases of up to ``most`` words of a block's normal text, sorted by hash: where one of each stands, and how many there are."""

    def __init__(self, text: bytes, lang: str, most: int):
        raw = np.frombuffer(text, np.uint8)
        blank = (raw == 0x20) | (raw == 0x0A)
        edge = np.diff(np.concatenate([[1], blank, [1]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        hashes = tk.hash_spans(raw, start, end)
        piece = np.cumsum(raw == 0x0A, dtype=np.int32)[start] if len(raw) else np.zeros(0, np.int32)
        named = np.frombuffer(lang.encode() + b" ", np.uint8)
        seed = tk.hash_spans(named, np.array([0]), np.array([len(named)]))[0]
        hash_, first, size, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int8)], [np.zeros(0, np.int32)]
        for k in range(1, most + 1):
            n = len(hashes) - k + 1
            whole = np.flatnonzero(piece[:n] == piece[k - 1 :]).astype(np.int32) if n > 0 else np.zeros(0, np.int32)
            own, some, often = np.unique(tk.combine([np.full(len(whole), seed), *(hashes[whole + j] for j in range(k))]), return_index=True, return_counts=True)
            for out, column in zip((hash_, first, size, counts), (own, whole[some], np.full(len(own), k, np.int8), often.astype(np.int32)), strict=True):
                out.append(column)
        joined = np.concatenate(hash_)
        order = np.argsort(joined)
        self.hashes, self.first, self.size, self.counts = joined[order], *(np.concatenate(x)[order] for x in (first, size, counts))
        self._start, self._end = start, end

    def cells(self, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted cells, and which of them each phrase's is."""
        return np.unique(self.hashes & np.uint64(mask), return_inverse=True)

    def strings(self, text: bytes, rows: np.ndarray) -> list[str]:
        lo, hi = self._start[self.first[rows]], self._end[self.first[rows] + self.size[rows] - 1]
        return [text[a:b].decode() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def cell_mask(n_phrases: int) -> int:
    """Which bits of a phrase's hash are the number of its cell."""
    bits = min(64, max(24, n_phrases.bit_length() + SPARE_BITS))
    return (1 << 64) - (1 << (64 - bits))


ASKED = ["child", "squad", "range", "cells", "n"]
_ASKED, _REPLIED = "child long, squad long, range long, cells binary, n binary", "child long, range long, flags binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else ((),) * len(fields)
    return pa.table({name: pa.array(list(c), pa.int64() if kind == "long" else pa.binary()) for (name, kind), c in zip(fields, columns, strict=True)})


def _merge(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted cells of all rows, where each row's are among them, and their sums."""
    each = [_sorted_keys(r["cells"]) for r in rows]
    cells, at = np.unique(np.concatenate(each), return_inverse=True)
    sums = np.bincount(at, np.concatenate([_values(r["n"], np.uint64) for r in rows]).astype(float), minlength=len(cells))
    return cells, np.split(at, np.cumsum([len(x) for x in each])[:-1]), sums


def frequent_cells(asked: DataFrame, least: int, n_phrases: int, n_blocks: int, keys_per_range: int = KEYS_PER_RANGE, fan_out: int = FAN_OUT) -> DataFrame:
    """For each child and range, which of the cells that it asked for reach ``least`` in all (one bit a cell, in order).

    ``asked`` has a row for each block: child, cells (sorted), n (counts, none
    above ``least``). Each level adds what ``fan_out`` senders say of a range,
    and cuts off at ``least`` again, so that counts stay small; answers go
    back the way the cells came.
    """
    ranges = levels(max(1, -(-n_phrases // keys_per_range)), fan_out)
    top = len(ranges) - 1
    squads = max(1, -(-n_blocks // fan_out))
    dealt = max(1, min(n_blocks, MOST_PARTITIONS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                squad = int(tk.mix(np.array([row["child"]], np.int64).view(np.uint64))[0] % np.uint64(squads))
                for piece in _cut(_sorted_keys(row["cells"]), [_values(row["n"], np.uint64)], ranges[0]):
                    yield from _table(_ASKED, [(row["child"], squad, *piece)]).to_batches()

    def up(level: int) -> Callable[[pa.Table], pa.Table]:
        def merge(group: pa.Table) -> pa.Table:
            rows = group.select(ASKED).to_pylist()
            cells, _, sums = _merge(rows)
            squad, own = rows[0]["squad"], rows[0]["range"]
            return _table(_ASKED, [(squad * ranges[level] + own, squad // fan_out, *piece) for piece in _cut(cells, [np.minimum(sums, least)], ranges[level + 1])])

        return merge

    def answer(group: pa.Table) -> pa.Table:
        rows = group.select(ASKED).to_pylist()
        _, at, sums = _merge(rows)
        return _table(_REPLIED, [(r["child"], r["range"], np.packbits(sums[mine] >= least).tobytes()) for r, mine in zip(rows, at, strict=True)])

    def down(level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def merge(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = left.select(ASKED).to_pylist()
            if not rows:
                return _table(_REPLIED, [])
            cells, at, sums = _merge(rows)
            flags = _flags(right, cells, ranges[level + 1])
            return _table(_REPLIED, [(r["child"], r["range"], np.packbits(flags[mine]).tobytes()) for r, mine in zip(rows, at, strict=True)])

        return merge

    sent = asked.mapInArrow(ask, _ASKED)
    kept: list[DataFrame] = []
    for level in range(top):
        kept.append(materialise(sent, "asked") if level else sent)  # the first is made again on the way back
        sent = kept[-1].repartition(dealt, "squad", "range").groupBy("squad", "range").applyInArrow(up(level), _ASKED)
    replies = materialise(sent.repartition(max(1, min(2 * ranges[top], MOST_PARTITIONS)), "range").groupBy("range").applyInArrow(answer, _REPLIED), "flags")
    for level in reversed(range(top)):
        own = (F.col("squad") * ranges[level] + F.col("range")).alias("me")
        left = kept[level].select(own, *ASKED).repartition(dealt, "me")
        right = replies.select(F.col("child").alias("me"), "child", "range", "flags").repartition(dealt, "me")
        after = materialise(left.groupBy("me").cogroup(right.groupBy("me")).applyInArrow(down(level), _REPLIED), "flags")
        discard(replies)
        if level:
            discard(kept[level])
        replies = after
    return replies


def _flags(replies: pa.Table, cells: np.ndarray, ranges: int) -> np.ndarray:
    """The bits of all ranges in the order of the cells."""
    rows = sorted(replies.select(["range", "flags"]).to_pylist(), key=lambda r: r["range"])
    owner = ((cells >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    sizes = dict(zip(*(x.tolist() for x in np.unique(owner, return_counts=True)), strict=True))
    bits = [np.unpackbits(np.frombuffer(r["flags"], np.uint8))[: sizes[r["range"]]] for r in rows]
    return np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)


def _plain(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def phrase_counts(docs: DataFrame, lang: str | Column = "lang", most: int = 3, least: int = 10, block_bytes: int = BLOCK_BYTES, keys_per_range: int = KEYS_PER_RANGE, fan_out: int = FAN_OUT) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of one to ``most`` words that occur ``least`` times or more in their language.

    Two written tables: phrases (lang, phrase, words, a) and languages (lang,
    n: all word occurrences).
    """
    named = F.col(lang) if isinstance(lang, str) else lang
    source = docs.select(F.coalesce(named.cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    stored = materialise(blocks(source, block_bytes), "blocks")
    totals = stored.groupBy("lang").agg(F.sum("n_words").alias("n"))
    n_blocks, n_words = stored.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    n_phrases = most * n_words
    mask = cell_mask(n_phrases)
    ranges = levels(max(1, -(-n_phrases // keys_per_range)), fan_out)[0]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                phrases = Phrases(_plain(row["text"]), row["lang"], most)
                cells, at = phrases.cells(mask)
                n = np.minimum(np.bincount(at, phrases.counts, minlength=len(cells)), least)
                yield from pa.table({"child": pa.array([row["block"]], pa.int64()), "cells": pa.array([_sorted_blob(cells)], pa.binary()), "n": pa.array([_planes(n.astype(np.uint64))], pa.binary())}).to_batches()

    asked = stored.select("block", "lang", "text").mapInArrow(ask, "child long, cells binary, n binary")
    flags = frequent_cells(asked, least, n_phrases, n_blocks, keys_per_range, fan_out)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick

        named, n = [], np.zeros(0, np.int64)
        if left.num_rows:
            (row,) = left.to_pylist()
            text = _plain(row["text"])
            phrases = Phrases(text, row["lang"], most)
            cells, at = phrases.cells(mask)
            rows = np.flatnonzero(_flags(right, cells, ranges)[at])
            names = sorted(phrases.strings(text, rows))  # what is alike lies together in the shuffle
            del phrases, cells, at, rows
            if names:
                automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                for k, name in enumerate(names):
                    automaton.add_word(f" {name} ", k)
                automaton.make_automaton()
                hits = np.fromiter((k for _, k in automaton.iter(text.decode())), np.int32)
                n = np.bincount(hits, minlength=len(names))
                named = [f"{name}\n{row['lang']}" for name in names]
        return pa.table({"key": pa.array(named, pa.string()), "a": pa.array(n, pa.int64())})

    tasks = max(1, min(-(-n_blocks // BLOCKS_PER_TASK), MOST_PARTITIONS))
    texts, answers = stored.select("block", "lang", "text").repartition(tasks, "block"), flags.select(F.col("child").alias("block"), "range", "flags").repartition(tasks, "block")
    local = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(count, "key string, a long")
    summed = local.groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    phrase = F.substring_index("key", "\n", 1)  # no word holds a line feed
    own = F.substring("key", F.char_length(phrase) + 2, F.char_length("key"))
    sums = materialise(summed.select(own.alias("lang"), phrase.alias("phrase"), (F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1).alias("words"), "a"), "phrases")
    languages = materialise(totals, "languages")
    discard(stored)
    discard(flags)
    return sums, languages


def score_phrases(counts: DataFrame, most: int = 3, scale: int = 1_000_000) -> DataFrame:
    """Each phrase of two words or more (lang, phrase, words, a) with its lowest-scoring cut: l, r, score.

    The score of a cut is ``scale * a * a / (l * r)``, rounded down, in
    decimals of 38 digits: exact for counts up to 10**14. Of equal scores the
    cut after fewer words counts. ``counts`` must hold every part of a phrase.
    """
    words = F.split("phrase", " ")
    cuts = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cut = counts.where("words > 1").select("lang", "phrase", "words", "a", words.alias("parts"), cuts)
    first, rest = F.array_join(F.slice("parts", 1, F.col("k")), " "), F.array_join(F.slice("parts", F.col("k") + 1, F.col("words") - F.col("k")), " ")
    cut = cut.select("lang", "phrase", "words", "a", "k", first.alias("first"), rest.alias("rest"))
    known = counts.select(F.col("lang"), F.col("phrase").alias("part"), F.col("a").alias("f"))
    left = known.select("lang", F.col("part").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    both = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    exact = {c: F.col(c).cast("decimal(14,0)") for c in ("a", "l", "r")}
    square, product = (exact["a"] * exact["a"]), (exact["l"] * exact["r"])
    scored = both.withColumn("_top", square * F.lit(scale).cast("decimal(7,0)")).withColumn("_under", product).withColumn("score", F.expr("_top div _under"))
    least = F.min(F.struct("score", "k", "l", "r"))
    return scored.groupBy("lang", "phrase", "words", "a").agg(least.alias("_cut")).select("lang", "phrase", "words", "a", "_cut.l", "_cut.r", "_cut.score")


def inside_longer(counts: DataFrame) -> DataFrame:
    """Phrases (lang, phrase) of two words or more inside longer ones, with the greatest count of such a longer one (``longer``)."""
    parts = F.split("phrase", " ")
    inner = counts.where("words > 2").select("lang", "a", "words", parts.alias("parts"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "parts", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    return inner.groupBy("lang", F.array_join(F.slice("parts", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, lang: str | Column = "lang", most: int = 3, least: int = 10, share: int = 50, top: int = 2000, **how: int) -> DataFrame:
    """Each language's ``top`` phrases of two to ``most`` words by score.

    Columns lang, rank, phrase, a, l, r, n, score. A phrase counts once it
    occurs ``least`` times; it goes if a longer phrase that holds it has
    ``share`` per cent of its occurrences. Order: score, then a, both
    descending, then the phrase's bytes. A null text is empty, a null language
    ``und``; repeated rows count each; other columns are ignored; an empty
    table has no phrases.
    """
    counts, languages = phrase_counts(docs, lang, most, least, **how)
    scored = score_phrases(counts, most).join(inside_longer(counts), ["lang", "phrase"], "left")
    kept = materialise(scored.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer"), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each share of a language, then the first of those
    salts = max(16, kept.count() // (20 * top))
    dealt = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    dealt = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(languages) if languages.count() < 10_000 else languages, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_collocations": op12_collocations}
ORACLE_SQL = {
    "op12_collocations": """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents),
listed AS (SELECT row_number() OVER () AS piece_id, lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
placed AS (SELECT piece_id, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM listed),
runs AS (SELECT lang, w1, lead(w1, 1) OVER (PARTITION BY piece_id ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY piece_id ORDER BY i) AS w3 FROM placed),
grams AS (
  SELECT lang, 1 AS words, w1 AS phrase FROM runs
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
candidates AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS p, a FROM f WHERE words > 1 AND a >= 10),
known AS MATERIALIZED (SELECT lang || chr(10) || phrase AS key, a FROM f WHERE a >= 10),
cuts AS MATERIALIZED (
  SELECT lang, phrase, a, 1 AS k, p[1] AS head, p[2] AS tail FROM candidates WHERE words = 2
  UNION ALL SELECT lang, phrase, a, 1, p[1], p[2] || ' ' || p[3] FROM candidates WHERE words = 3
  UNION ALL SELECT lang, phrase, a, 2, p[1] || ' ' || p[2], p[3] FROM candidates WHERE words = 3),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, (1000000 * c.a::HUGEINT * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN known x ON x.key = c.lang || chr(10) || c.head JOIN known y ON y.key = c.lang || chr(10) || c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_pairs AS (
  SELECT lang, p[1] || ' ' || p[2] AS phrase, a FROM candidates WHERE words = 3
  UNION ALL SELECT lang, p[2] || ' ' || p[3], a FROM candidates WHERE words = 3),
longer AS (SELECT lang, phrase, max(a) AS longest FROM inner_pairs GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longest IS NULL OR 100 * o.longest < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
""",
}
