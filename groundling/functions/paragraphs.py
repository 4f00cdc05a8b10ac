"""Near-duplicate paragraphs and key terms of single texts, in plain Python: they run in executors' Python workers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

from groundling.functions.cutting import WHITE, lower
from groundling.functions.vocabulary import CATEGORIES, TERM_STOPWORDS

DUPLICATE_WORDS, SHINGLE = 20, 4
# Fixed value: punctuation that is no part of a term.
PUNCTUATION = ".,;:!?()[]{}'\""
_BLANK = re.compile(r"\n[\t\n\f\r ]*\n")
_TAG, _WORD = re.compile("<[^>]+>"), re.compile("[a-z0-9]+")
_MARKUP, _LINK = re.compile("<[^>]*>"), re.compile(r"\[(.*?)\]\([^)]*\)")
_STOP = frozenset(TERM_STOPWORDS)
_RUN = re.compile("[0-9a-z_]+")
_TERM = re.compile("|".join(f"(?P<{name}>(?:{pattern})\\Z)" for name, pattern in CATEGORIES.items()))


def duplicates(md: str) -> list[tuple[int, str]]:
    """(place, paragraph) of paragraphs that reach Jaccard 0.8 with an earlier one."""
    firsts: dict[frozenset, int] = {}
    index: dict[tuple, list[int]] = {}
    sizes: list[int] = []
    out = []
    for at, raw in enumerate(_BLANK.split(md)):
        paragraph = raw.strip(WHITE)
        if not paragraph or paragraph[0] == "#":
            continue
        words = _WORD.findall(lower(_TAG.sub(" ", paragraph) if "<" in paragraph else paragraph))
        if len(words) < DUPLICATE_WORDS:
            continue
        shingles = frozenset(zip(*(words[k:] for k in range(SHINGLE)), strict=False))
        if shingles in firsts:
            out.append((at, paragraph))
            continue
        firsts[shingles] = at
        shared = Counter(i for s in shingles for i in index.get(s, ()))
        if any(5 * both >= 4 * (len(shingles) + sizes[i] - both) for i, both in shared.items()):
            out.append((at, paragraph))
        for s in shingles:
            index.setdefault(s, []).append(len(sizes))
        sizes.append(len(shingles))
    return out


def duplicate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, md) to (id, pos, paragraph)."""
    for batch in batches:
        rows, places, texts = [], [], []
        for row, md in enumerate(batch.column(1)):
            for at, paragraph in duplicates(md.as_py()):
                rows.append(row)
                places.append(at)
                texts.append(paragraph)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(texts, pa.string())], [batch.schema.names[0], "pos", "paragraph"])


def spaced(text: str) -> str:
    """A Markdown text without tags and marks, link texts kept, all white space as spaces."""
    text = _MARKUP.sub("", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    for mark in "*_`~\r":
        text = text.replace(mark, "")
    for white in WHITE:
        text = text.replace(white, " ")
    return text


def terms(text: str, most: int) -> list[str]:
    """The most frequent terms of a lower-cased text, the first to appear first among equals."""
    counts = Counter([w.strip(PUNCTUATION) for w in spaced(text).split(" ")])
    kept = [w for w in counts if (len(w) > 3 or len(w.encode()) > 3) and w not in _STOP]
    return sorted(kept, key=counts.get, reverse=True)[:most]


def term_lists(texts: Iterator[pa.Array], most: int) -> Iterator[pa.Array]:
    """One text at a time becomes a Python string, so a batch of long ones is held once."""
    for batch in texts:
        yield pa.array((terms(t.as_py(), most) for t in batch), pa.list_(pa.string()), size=len(batch))


@lru_cache(maxsize=1)
def _stems():  # noqa: ANN202
    """An automaton of what the terms of all categories begin with, each with its length."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for pattern in CATEGORIES.values():
        for stem in pattern.replace("[0-9A-Za-z_]*", "").split("|"):
            automaton.add_word(stem, len(stem))
    automaton.make_automaton()
    return automaton


def category(low: str) -> str:
    """The category with most terms in a lower-cased text, the first of equals; Technology without any."""
    low = low.replace("ſ", "s")  # a search without case takes the long s for an s
    counts, starts = dict.fromkeys(CATEGORIES, 0), set()
    for last, size in _stems().iter(low):
        start = last + 1 - size
        if start not in starts and not (start and _RUN.match(low, start - 1)):
            starts.add(start)
            if found := _TERM.match(_RUN.match(low, start)[0]):
                counts[found.lastgroup] += 1
    best = max(counts, key=counts.get)
    return best if counts[best] else "Technology"


def category_names(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array((category(t.as_py()) for t in batch), pa.string(), size=len(batch))


def topics(texts: Iterator[tuple[pa.Array, pa.Array]], most: int) -> Iterator[pa.Array]:
    """Category of lower-cased headings with their texts, terms of the headings and terms of the texts; each text is read once."""
    kind = pa.struct([("category", pa.string()), ("heading", pa.list_(pa.string())), ("body", pa.list_(pa.string()))])
    for headings, bodies in texts:
        pairs = ((h.as_py(), t.as_py()) for h, t in zip(headings, bodies, strict=True))
        yield pa.array(({"category": category(f"{h} {t}"), "heading": terms(h, most), "body": terms(t, most)} for h, t in pairs), kind, size=len(bodies))
