"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is cut into the pieces of the public pattern with array operations, the
distinct pieces of a slice are encoded once, and every token goes to its place.

Pieces are dealt into buckets by their length in bytes and each bucket is a
padded matrix of token ids. In a round every row merges its leftmost pair of
least rank; a hash table of all pairs gives the ranks, the row's other tokens
close up, and rows without a pair that merges leave the matrix. Rows longer
than the widest bucket (a run of text without a border) keep their pairs by
rank instead, so that a round merges all pairs of the least rank from left to
right: the same merges in the same order, in as many rounds as there are
different ranks.

Decoding joins the bytes of the ids' tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.llm import textkernel as tk
from groundling.llm.tokens import VOCABULARY

#: Widest row of a bucket; each bucket is a quarter wider than the one before.
WIDEST = 256
#: Cells of a matrix.
CELLS = 1 << 20
#: Texts longer than this are cut before white space and done part by part.
PART_BYTES = 4 << 20
#: No pair.
NONE = np.int32(0x7FFFFFFF)
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point, of the Unicode version that the tokenizer library has."""
    import tiktoken

    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0
    text = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return out


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the place of the first byte of each."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[at].astype(np.uint32)
    if len(at) == len(raw):
        return lead, at
    padded = np.append(raw, np.zeros(3, np.uint8)).astype(np.uint32) & 0x3F
    out = lead.copy()
    for low, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        some = np.flatnonzero(lead >= low)
        value = lead[some] & mask
        for k in range(1, more + 1):
            value = value << 6 | padded[at[some] + k]
        out[some] = value
    return out, at


def piece_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Place of the first byte of each match of the public pattern in texts that lie one behind the other.

    Matches are runs of one class, each with one blank before it if there is
    one; of white space before anything else the last character stands alone
    unless it is that blank; an apostrophe that begins a match takes the
    letters of an English ending.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    points, at = code_points(raw)
    kind = classes()[points]
    n = len(points)
    head = np.zeros(n + 1, bool)  # first characters of texts
    head[np.searchsorted(at, off)] = True
    head[0] = head[n] = True
    begins = head[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = begins.copy()  # last character of a run: the next one begins another
    last[:-1], last[-1] = begins[1:], True
    ends_text = head[1:]
    tail = np.flatnonzero(space & last & ~ends_text)  # white space before something else of its text
    begins[tail] = True
    begins[tail[points[tail] == 0x20] + 1] = False
    quote = np.flatnonzero((points == ord("'")) & begins & ~ends_text)
    if len(quote):
        nxt = points[quote + 1]
        two = np.where(ends_text[quote + 1], 0, points[np.minimum(quote + 2, n - 1)])
        one_letter = np.isin(nxt, [ord(c) for c in "stmd"])
        pair = nxt.astype(np.int64) << 32 | two
        two_letters = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        # the apostrophe stands alone in its run where a letter follows
        short, long = quote[one_letter], quote[two_letters]
        for k, size in ((short, 1), (long, 2)):
            begins[k + 1] = False
            after = k + size + 1
            begins[after[after < n]] = True
    return at[begins]


class Pairs:
    """Ranks of pairs of tokens by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(2 * len(rank)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slots, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slots[open_]] == -1]
            self.keys[slots[free]] = keys[free]  # of several the last one stays
            mine = self.keys[slots[open_]] == keys[open_]
            self.ranks[slots[open_[mine]]] = rank[open_[mine]]
            open_ = open_[~mine]
            slots[open_] = (slots[open_] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it does not merge; a negative id has no pair."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        slots = self._slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            held = self.keys[slots[open_]]
            out[open_] = np.where(held == keys[open_], self.ranks[slots[open_]], out[open_])
            open_ = open_[(held != keys[open_]) & (held != -1)]
        out = out.reshape(left.shape)
        out[(left < 0) | (right < 0)] = NONE
        return out


class Codec:
    """Ranks of a vocabulary: pieces to ids and back."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        found = [(a, b, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None]
        left, right, rank = (np.array(x, np.int32) for x in zip(*found, strict=True))
        self.pairs = Pairs(left, right, rank)
        #: Tokens of which a pair has a lower rank than they have: after their merge such a pair may come first.
        late = np.zeros(max(self.ranks.values()) + 1, bool)
        for side in (left, right):
            late[side[rank <= side]] = True
        self.late = late
        size = np.zeros(len(late) + 1, np.int64)
        for token, r in self.ranks.items():
            size[r + 1] = len(token)
        self.start = np.cumsum(size)
        self.bytes = np.zeros(self.start[-1], np.uint8)
        for token, r in self.ranks.items():
            self.bytes[self.start[r] : self.start[r + 1]] = np.frombuffer(token, np.uint8)

    def encode_pieces(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        sizes = end - start
        ids: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        low, width = 0, 1
        while low < WIDEST:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            for k in range(0, len(rows), max(1, CELLS // width)):
                got, who = self._matrix(raw, start, sizes, rows[k : k + max(1, CELLS // width)], width)
                ids.append(got)
                owner.append(who)
            low, width = width, min(max(width + 1, width * 5 // 4), WIDEST)
        for row in np.flatnonzero(sizes > WIDEST):
            piece = raw[start[row] : end[row]]
            whole = self.ranks.get(piece.tobytes()) if sizes[row] <= 1024 else None
            got = self.merge_long(self.byte_id[piece]) if whole is None else np.array([whole], np.int32)
            ids.append(got)
            owner.append(np.full(len(got), row))
        owners = np.concatenate([np.zeros(0, np.int64), *owner])
        order = np.argsort(owners, kind="stable")
        return np.concatenate([np.zeros(0, np.int32), *ids])[order], np.bincount(owners, minlength=len(sizes))

    def _matrix(self, raw: np.ndarray, start: np.ndarray, sizes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of up to ``width`` bytes, and the piece of each id."""
        place = np.arange(width)
        inside = place < sizes[rows][:, None]
        cells = np.full((len(rows), width), -1, np.int32)
        cells[inside] = self.byte_id[raw[(start[rows][:, None] + place)[inside]]]
        ids: list[np.ndarray] = []
        owner: list[np.ndarray] = []

        def done(which: np.ndarray) -> None:
            some = cells[which]
            real = some >= 0
            ids.append(some[real])
            owner.append(np.repeat(rows[which], real.sum(axis=1)))

        # a piece that is a token is that token
        token = np.array([self.ranks.get(raw[a : a + s].tobytes(), -1) for a, s in zip(start[rows].tolist(), sizes[rows].tolist(), strict=True)], np.int32)
        known = token >= 0
        ids.append(token[known])
        owner.append(rows[known])
        rows, cells = rows[~known], cells[~known]
        ranks = self.pairs.find(cells[:, :-1], cells[:, 1:])
        while len(rows) and cells.shape[1] > 1:
            at = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[np.arange(len(rows)), at]
            merges = best != NONE
            if not merges.all():
                done(~merges)
                rows, cells, ranks, at, best = rows[merges], cells[merges], ranks[merges], at[merges], best[merges]
                if not len(rows):
                    break
            row = np.arange(len(rows))
            cells[row, at] = best
            step = np.arange(cells.shape[1] - 1)
            cells = np.take_along_axis(cells, step + (step > at[:, None]), axis=1)
            if cells.shape[1] < 2:
                break
            step = step[:-1]
            ranks = np.take_along_axis(ranks, step + (step >= at[:, None]), axis=1)
            after = np.flatnonzero(at < cells.shape[1] - 1)
            ranks[after, at[after]] = self.pairs.find(cells[after, at[after]], cells[after, at[after] + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pairs.find(cells[before, at[before] - 1], cells[before, at[before]])
        if len(rows):
            done(np.ones(len(rows), bool))
        return np.concatenate(ids), np.concatenate(owner)

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Ids of one piece of any length."""
        ids = ids.copy()
        n = len(ids)
        nxt, prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        rank = np.append(self.pairs.find(ids[:-1], ids[1:]), NONE)  # of the pair that begins here
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            kinds, first = np.unique(rank[at], return_index=True)
            for r, some in zip(kinds.tolist(), np.split(at, first[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(some)

        put(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # of pairs that overlap in a row, every second one from the left
            chained = np.zeros(len(at), bool)
            chained[1:] = nxt[at[:-1]] == at[1:]
            begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            take = at[(np.arange(len(at)) - begin) % 2 == 0]
            if self.late[r]:
                rest = np.setdiff1d(at, take[:1])
                take = take[:1]
            else:
                rest = at[:0]
            gone = nxt[take]
            ids[take] = r
            alive[gone] = False
            follower = nxt[gone]
            nxt[take] = follower
            real = follower < n
            prev[follower[real]] = take[real]
            rank[gone] = NONE
            rank[take] = NONE
            rank[take[real]] = self.pairs.find(ids[take[real]], ids[follower[real]])
            led = prev[take]
            led = led[led >= 0]
            rank[led] = self.pairs.find(ids[led], ids[nxt[led]])
            changed = np.unique(np.concatenate([take, led, rest]))
            put(changed[alive[changed]])
        return ids[alive]

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one behind the other, and the offset of each text's first id."""
        start = piece_starts(raw, off)
        borders = np.append(start, len(raw)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(raw))])
        which = pieces.dictionary_encode().indices.to_numpy()
        n = int(which.max()) + 1 if len(which) else 0
        some = np.zeros(n, np.int64)
        some[which[::-1]] = np.arange(len(which))[::-1]
        ids, count = self.encode_pieces(raw, borders[some], borders[some + 1])
        first = np.concatenate([[0], np.cumsum(count)])
        each = count[which]
        total = np.concatenate([[0], np.cumsum(each)])
        place = np.arange(total[-1]) + np.repeat(first[which] - total[:-1], each)
        return ids[place], total[np.searchsorted(start, off)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids' tokens."""
        size = self.start[ids + 1] - self.start[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.arange(total[-1]) + np.repeat(self.start[ids] - total[:-1], size)]


@lru_cache(maxsize=2)
def codec(name: str = VOCABULARY) -> Codec:
    return Codec(name)


def parts(raw: np.ndarray, limit: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Parts of about ``limit`` bytes of one text, cut where white space follows something else, which is always a border of pieces."""
    at = 0
    while len(raw) - at > limit:
        window = at + limit
        cut = None
        while cut is None and window < len(raw):
            own = raw[window - 1 : window + limit]
            blank = (own == 0x20) | (own == 0x0A)
            found = np.flatnonzero(blank[1:] & (own[:-1] > 0x20) & (own[:-1] < 0x7F))
            if len(found):
                cut = window + int(found[0])
            window += limit
        if cut is None:
            break
        yield at, cut
        at = cut
    yield at, len(raw)


SCHEMA = "doc_id long, ids binary, decoded binary"


def _texts(part: pa.RecordBatch, code: Codec) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Of each text its ids and the bytes they decode to, both in parts."""
    raw, off = tk.utf8(part.column("text"))
    if len(off) == 2 and len(raw) > PART_BYTES:
        ids = [code.encode(own, np.array([0, len(own)]))[0] for a, b in parts(raw) for own in [raw[a:b]]]
        yield ids, [code.decode(x) for x in ids]
        return
    ids, at = code.encode(raw, off)
    back = code.decode(ids)
    size = np.concatenate([[0], np.cumsum(code.start[ids + 1] - code.start[ids])])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield [ids[a:b]], [back[size[a] : size[b]]]


def bpe_ids(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) of every whole text; a null text is empty and has none, rows that repeat stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary)
        for part in tk.slices(batches, "text"):
            found = [np.concatenate([np.zeros(0, np.int32), *ids]) for ids, _ in _texts(part, code)]
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32), pa.array(np.concatenate(found), pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return _source(docs).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``text`` (binary) of rows of ``doc_id`` and ``ids``; null ids are none, an id outside the vocabulary fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary)
        for batch in batches:
            texts = [code.decode(np.array(ids or [], np.int64)).tobytes() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text binary")


def bpe_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every whole text.

    Ids count as little-endian unsigned 32-bit integers. One row per input
    row: a null text is empty, rows that repeat stay, further columns of any
    name are ignored, an empty table has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary)
        for part in tk.slices(batches, "text"):
            counts, digests = [], ([], [])
            for pair in _texts(part, code):
                counts.append(sum(map(len, pair[0])))
                for out, chunks, kind in zip(digests, pair, ("<u4", np.uint8), strict=True):
                    digest = hashlib.sha256()
                    for chunk in chunks:
                        digest.update(np.ascontiguousarray(chunk.astype(kind, copy=False)))
                    out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(x, pa.string()) for x in digests)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _source(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_bpe": op11_bpe}
#: Merges in order of rank are no SQL; tests hold ids and bytes against the tokenizer library.
ORACLE_SQL: dict[str, str] = {}
