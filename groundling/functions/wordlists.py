"""Which words of fixed lists a text contains, in one pass over it, in plain Python: it runs in executors' Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


_WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")


def _automaton(words: list[str]):  # noqa: ANN202
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for at, word in enumerate(words):
        automaton.add_word(word, at)
    automaton.make_automaton()
    return automaton


def _lists(batch: pa.Array, find: Callable[[str], list[str]]) -> pa.Array:
    """One text at a time becomes a Python string, so a batch of long ones is held once."""
    return pa.array((find(text) if (text := value.as_py()) else [] for value in batch), pa.list_(pa.string()), size=len(batch))


def held(text: Column, words: list[str]) -> Column:
    """The distinct ``words`` that a text contains, in the list's order: the work is the text's length, however many words there are."""
    words = list(dict.fromkeys(words))

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(words)
        for batch in batches:
            yield _lists(batch, lambda t: [words[at] for at in sorted({at for _, at in automaton.iter(t)})])

    return F.arrow_udf(search, "array<string>")(text)


def bounded(text: Column, words: list[str]) -> Column:
    """The distinct ``words`` that stand between ASCII word borders, in order of first appearance; no word may hold another between borders."""
    words = list(dict.fromkeys(words))

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(words)

        def find(t: str) -> list[str]:
            out = {}
            for last, at in automaton.iter(t):
                first = last + 1 - len(words[at])
                if (not first or t[first - 1] not in _WORD) and (last + 1 == len(t) or t[last + 1] not in _WORD):
                    out.setdefault(words[at], None)
            return list(out)

        for batch in batches:
            yield _lists(batch, find)

    return F.arrow_udf(search, "array<string>")(text)
