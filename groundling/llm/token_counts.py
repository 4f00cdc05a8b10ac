"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. A byte-level token's bytes are its
place in the text, so a running sum of token lengths maps every token to a
span of characters; token spans and section spans are then joined as sorted
intervals. A token that crosses a border is allocated by an explicit rule:

- ``first``: to the section that holds its first character;
- ``middle``: to the section that holds its middle character (of two, the earlier);
- ``split``: to each section by the share of its bytes there.

A token that holds a part of a character's bytes spans that whole character.
Sections that tile a document share out exactly its tokens under each rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.llm import textkernel as tk
from groundling.llm.tokens import VOCABULARY, encoder

SECTIONS = "array<struct<name:string,start:int,end:int>>"


def field_sections(fields: list[str], glue: str = "\n") -> tuple[Column, Column]:
    """Text of several columns joined by ``glue`` (nulls are empty), and the span of each as a section.

    The glue after a field is in no section.
    """
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    at, spans = F.lit(0), []
    for name, text in zip(fields, texts, strict=True):
        end = at + F.char_length(text)
        spans.append(F.struct(F.lit(name).alias("name"), at.cast("int").alias("start"), end.cast("int").alias("end")))
        at = end + len(glue)
    return F.concat_ws(glue, *texts), F.array(*spans)


class Spans:
    """Token spans of one text: byte borders, and first and last character of each token."""

    def __init__(self, raw: np.ndarray, lengths: np.ndarray):
        self.byte = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=self.byte[1:])
        leads = (raw & 0xC0) != 0x80
        char = np.cumsum(leads) - 1  # character of each byte
        self.char_at = np.append(np.flatnonzero(leads), len(raw))  # first byte of each character
        self.first = char[self.byte[:-1]] if len(lengths) else np.zeros(0, np.int64)
        self.last = char[self.byte[1:] - 1] if len(lengths) else np.zeros(0, np.int64)

    def attribute(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of character spans by ``first``, ``middle`` and ``split``, and how many cross a border of each span."""
        n_chars = len(self.char_at) - 1
        start, end = np.clip(start, 0, n_chars), np.clip(end, 0, n_chars)
        end = np.maximum(start, end)
        middle = (self.first + self.last) // 2
        by_first = np.searchsorted(self.first, end) - np.searchsorted(self.first, start)
        by_middle = np.searchsorted(middle, end) - np.searchsorted(middle, start)
        index = np.arange(len(self.byte), dtype=float)
        by_split = np.interp(self.char_at[end], self.byte, index) - np.interp(self.char_at[start], self.byte, index)
        inside = np.maximum(np.searchsorted(self.last, end) - np.searchsorted(self.first, start), 0)
        touched = np.searchsorted(self.first, end) - np.searchsorted(self.last, start)
        touched = np.where(end > start, touched, 0)
        return by_first, by_middle, by_split, touched - np.where(end > start, inside, 0)


def token_counts(docs: DataFrame, sections: Column | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each section of every whole text.

    ``sections`` is an array column of (name, start, end) in characters, in any
    order, overlapping or not; without it, sections are the lines of a text,
    each with its line feed, named by their number. One row per section:
    doc_id, section (int, from 0), name, start, end, n_first, n_middle (long),
    n_split (double), n_crossing (long: tokens that reach over its borders),
    doc_tokens (long). An empty or null text has one empty line; a null array
    has no sections. Spans are cut to the text. Repeated rows are counted each.
    """
    lines = sections is None
    schema = "doc_id long, section int, name string, start int, end int, n_first long, n_middle long, n_split double, n_crossing long, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for part in tk.slices(batches, "text"):
            raw, off = tk.utf8(part.column("text"))
            texts, ids = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
            spans_of = None if lines else part.column("sections").to_pylist()
            columns: list[list] = [[] for _ in range(10)]
            for k, text in enumerate(texts):
                own = raw[off[k] : off[k + 1]]
                got = enc.ids(text)
                tokens = Spans(own, enc.lengths[got])
                if lines:
                    feeds = np.searchsorted(tokens.char_at, np.flatnonzero(own == 0x0A)) + 1
                    n_chars = len(tokens.char_at) - 1
                    borders = np.concatenate([[0], feeds, [n_chars] if not len(feeds) or feeds[-1] < n_chars else []]).astype(np.int64)
                    start, end, names = borders[:-1], borders[1:], [str(i) for i in range(len(borders) - 1)]
                else:
                    mine = spans_of[k] or []
                    start, end = (np.array([s[f] or 0 for s in mine], np.int64) for f in ("start", "end"))
                    names = [s["name"] for s in mine]
                n = len(names)
                values = ([ids[k]] * n, range(n), names, start, end, *tokens.attribute(start, end), [len(got)] * n)
                for column, value in zip(columns, values, strict=True):
                    column.extend(value.tolist() if isinstance(value, np.ndarray) else value)
            types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "section", "name", "start", "end", "n_first", "n_middle", "n_split", "n_crossing", "doc_tokens"])

    chosen = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*chosen, *([] if lines else [sections.cast(SECTIONS).alias("sections")])).mapInArrow(run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
