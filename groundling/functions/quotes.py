"""Which of many quotes a source contains, in one pass over each source.

The quotes of a source become one automaton, and the source is read once from
end to end, however many quotes there are: the work is the length of the
source, of its quotes, and of what is found. A source with very many quotes is
dealt over tasks by its quotes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quotes of one source that meet it in one task.
QUOTES_PER_TASK = 20_000
#: So few quotes are searched for one by one, which takes less than to build an automaton.
FEW_QUOTES = 8


def quotes_of(plain: str, quotes: list[str]) -> list[str]:
    """The distinct non-empty ``quotes`` that ``plain`` contains."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for quote in quotes:
        if quote:
            automaton.add_word(quote, quote)
    if not len(automaton):
        return []
    automaton.make_automaton()
    return list(dict.fromkeys(quote for _, quote in automaton.iter(plain)))


def held(texts: list[str], quotes: list[str]) -> list[bool]:
    """Whether any of ``texts`` contains each quote; none contains an empty one."""
    if len(quotes) <= FEW_QUOTES:
        return [q != "" and any(q in text for text in texts) for q in quotes]
    found = {q for text in texts for q in quotes_of(text, quotes)}
    return [q in found for q in quotes]


def quotes_held(plains: Column, quotes: Column) -> Column:
    """For each of a row's ``quotes`` whether any of its texts ``plains`` contains it, see :func:`held`; nothing is shuffled."""
    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, asked in batches:
            yield pa.array((held(t.as_py(), q.as_py()) for t, q in zip(texts, asked, strict=True)), pa.list_(pa.bool_()), size=len(asked))

    return F.arrow_udf(search, "array<boolean>")(plains, quotes)


def quotes_found(sources: DataFrame, quotes: DataFrame, key: str, per_task: int = QUOTES_PER_TASK) -> DataFrame:
    """The rows of ``quotes`` (``key``, quote) that stand in the source (``key``, plain) of that key, once each.

    Both texts are compared as they are. A key without a source, a null and an
    empty quote have no row; several sources of one key count as one each.
    """
    wanted = quotes.select(F.col(key).alias("asked"), "quote").where(F.col("quote") != "").distinct()
    dealt = wanted.groupBy("asked").agg(F.ceil(F.count("*") / F.lit(per_task)).cast("int").alias("tasks"))
    texts = sources.select(F.col(key).alias("held"), "plain").where(F.col("plain").isNotNull())
    spread = dealt.select(F.col("asked").alias("held"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    left = texts.join(spread, "held").select("held", "plain", "task")
    right = wanted.join(dealt, "asked").select("asked", "quote", F.pmod(F.xxhash64("quote"), "tasks").cast("int").alias("part"))
    kind = quotes.schema[key].dataType

    def search(texts: pa.Table, asked: pa.Table) -> pa.Table:
        names = asked.column("quote").to_pylist()
        found = list(dict.fromkeys(q for text in texts.column("plain").to_pylist() for q in quotes_of(text, names)))
        keys = pa.concat_arrays([asked.column("asked").combine_chunks().slice(0, 1)] * len(found)) if found else asked.column("asked").combine_chunks().slice(0, 0)
        return pa.table({key: keys, "quote": pa.array(found, pa.string())})

    schema = f"`{key}` {kind.simpleString()}, quote string"
    return left.groupBy("held", "task").cogroup(right.groupBy("asked", "part")).applyInArrow(search, schema)
