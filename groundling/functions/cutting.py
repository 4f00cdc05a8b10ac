"""Sectioning of a text in one pass, in plain Python: it runs in executors' Python workers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa

SECTION_BYTES = 4500
#: Characters of sections that are held before they are handed on.
OUT_CHARS = 1 << 22
#: Unicode White_Space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


_WHITE_BYTES = re.compile(b"(?:" + b"|".join(re.escape(c.encode()) for c in WHITE) + b")*")


def cut_part(part: str, limit: int = SECTION_BYTES) -> list[str]:
    """A part in pieces of at most ``limit`` bytes: at a blank line, else a sentence end, else a character."""
    part = part.strip(WHITE)
    if len(part) * 4 <= limit:
        return [part] if part else []
    out, data, at = [], part.encode(), 0
    while len(data) - at > limit:
        head = data[at : at + limit]
        n = head.rfind(b"\n\n")
        if n < limit // 2:
            n = head.rfind(b". ")
        if n < limit // 2:
            n = limit
            while data[at + n] & 0xC0 == 0x80:
                n -= 1
        out.append(data[at : at + n].decode().strip(WHITE))
        at = _WHITE_BYTES.match(data, at + n).end()
    return [*out, data[at:].decode()] if at < len(data) else out


def normalise(text: str) -> str:
    """Line ends as line feeds, four or more of them as three, ends trimmed."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    while "\n\n\n\n" in text:
        text = text.replace("\n\n\n\n", "\n\n\n")
    return text.strip(WHITE)


def lower(text: str) -> str:
    """Lower case, one character for one."""
    if text.isascii():
        return text.lower()
    text = text.replace("İ", "i").replace("Σ", "σ")
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def sectioner(headings: list[str], stops: list[str], space: str) -> Callable[[str], list[str]]:
    """A function from a text to its sections: without what the last stop heading begins, split at headings, capped in bytes."""
    heading = re.compile(r"\n(?=(?:%s)(?![0-9A-Za-z_]))" % "|".join(headings))
    word = re.compile("[0-9A-Za-z_]")

    def line_start(text: str, at: int) -> int | None:
        """Where white space, and hashes before it, reach back to a line's start from ``at``."""
        to = at
        for hashes in (False, True):
            run = to
            while run and text[run - 1] in space:
                run -= 1
            if not run or "\n" in text[run:to]:
                return run
            if hashes or run == to:
                return None
            to = run
            while to and text[to - 1] == "#":
                to -= 1
            if not 1 <= run - to <= 6:
                return None
        return None

    def last_stop(text: str) -> int:
        """Where the text ends before its last stop heading; -1 without one."""
        low, best, end = lower(text).replace("ı", "i").replace("ſ", "s"), -1, -1  # a search without case takes these letters for ASCII ones
        for stop in stops:
            at = low.rfind(stop)
            while at > best:
                if not word.match(text, at + len(stop)) and (start := line_start(text, at)) is not None:
                    best, end = at, start
                    break
                at = low.rfind(stop, 0, at + len(stop) - 1)
        return end

    def sections(text: str) -> list[str]:
        text = normalise(text)
        end = last_stop(text)
        if end >= 0:
            text = text[:end].strip(WHITE)
        return [piece for part in heading.split(text) if part for piece in cut_part(part)]

    return sections


def section_batches(batches: Iterator[pa.RecordBatch], cut: Callable[[str], list[str]]) -> Iterator[pa.RecordBatch]:
    """Batches (carried columns..., body) to (carried columns..., at, body), a row for each section."""
    for batch in batches:
        *carried, texts = batch.columns
        rows, places, bodies, size = [], [], [], 0
        for row, text in enumerate(texts):
            found = cut(text.as_py())
            rows += [row] * len(found)
            places += range(len(found))
            bodies += found
            size += sum(map(len, found))
            if rows and (size >= OUT_CHARS or row == len(texts) - 1):
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in carried), pa.array(places, pa.int32()), pa.array(bodies, pa.string())], [*batch.schema.names[:-1], "at", "body"])
                rows, places, bodies, size = [], [], [], 0
