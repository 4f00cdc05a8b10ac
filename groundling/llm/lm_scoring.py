"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of words after two, one and no
words with the uniform one,

    P(w | u, v) = a c(u, v, w) / c(u, v) + b c(v, w) / c(v) + d c(w) / N + e / (V + 1),

with weights (a, b, d, e) that depend only on the bucket of the context's
count: of c(u, v), or where that is zero of c(v). The weights are learned by
expectation-maximisation on held-out counts: a fifth of the training documents
is scored with the counts of the others, and those counts, gathered by bucket
and by half octaves of the three estimates, are all that EM needs, so that it
runs on a table of bounded size. Scores then use the counts of all training
documents.

How counts travel: documents are encoded into blocks of some megabytes, each
with its sorted distinct words and pairs. However frequent a key is, it is one
entry of a block, and no table of counts is ever in one place. Keys are
numbers, and the partitions that own them are ranges of numbers. A block cuts
its keys into ``FAN_OUT`` ranges only. Where there are more partitions than
that, ``FAN_OUT`` blocks meet at one range, are merged there, and what is
merged is cut again, level by level, until a range has one owner; sums go back
the way the keys came. So every block costs ``FAN_OUT`` rows a level, and rows
grow as the input times the logarithm of its partitions, not as blocks times
partitions.

Triples go the same way after the pairs have come back. One of whose pairs
either stands in no other block cannot stand in one either, so its count is the
block's own and it is not sent; all others are.

A word's key is 63 bits of its hash, whatever the corpus, so that the counts of
words, their number and the base score are exact. A pair's or triple's key has
so many bits, more with more tokens, that it shares its count with another key
with a probability of about ``2**-SPARE_BITS``.

Groups of rows, not partitions, bound a task's memory: there are as many as
the input asks for, dealt over ``MOST_PARTITIONS`` shuffle partitions at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.llm import textkernel as tk
from groundling.llm.docstats import fold
from groundling.session import discard, materialise

BLOCK_BYTES = 4 << 20
#: Tokens to each partition of counts.
KEYS_PER_PARTITION = 1_500_000
FAN_OUT = 256
BLOCKS_PER_TASK = 4
SPARE_BITS = 20
#: Shuffle partitions at most.
MOST_PARTITIONS = 4096
#: Set in the key of a word, and in no other.
WORD = np.uint64(1)
END = tk.mix(np.array([0xE0D], np.uint64))[0]
START = tk.mix(np.array([0x57A], np.uint64))[0]
#: Folds of documents.
HELD_OUT, COUNTED, MIXED = 0, 1, 2
_BUCKETS, _STEPS, _DEPTH = 40, 2, 30
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[ord("A") : ord("Z") + 1] += 32


def _planes(values: np.ndarray) -> bytes:
    """Compressed byte planes of an array."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _values(blob: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _sorted_blob(keys: np.ndarray) -> bytes:
    """Differences of keys; they are small where keys ascend, and wrap around where they do not."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _sorted_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_values(blob, np.uint64), dtype=np.uint64)


BLOCK = "block long, n_tokens long, doc_ids binary, missing binary, folds binary, counts binary, vocabulary binary, tokens binary"


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encoded documents (doc_id, text, part): one row for each ``block_bytes`` of text or single longer document.

    A document is its words and one end; ``tokens`` are places in the block's
    ``vocabulary`` of word hashes, the most frequent first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            ids, missing, parts, counts = (np.concatenate([h[k] for h in held]) for k in range(4))
            vocabulary, tokens, often = np.unique(np.concatenate([h[4] for h in held]), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            row = (number, len(tokens), _planes(ids), missing.tobytes(), parts.tobytes(), _planes(counts), _sorted_blob(vocabulary[order]), _planes(rank[tokens]))
            number += 1
            held.clear()
            types = (pa.int64(), pa.int64(), *(pa.binary(),) * 6)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

        for part in tk.slices(batches, "text", min(tk.SLICE_BYTES, block_bytes)):
            raw, off = tk.utf8(part.column("text"))
            if held and size + len(raw) > block_bytes:
                yield flush()
                size = 0
            size += len(raw)
            words = tk.Words(_FOLDED[raw], off)
            hashes = tk.hash_spans(words.raw, words.start, words.end)
            n = words.count
            out = np.full(len(hashes) + len(n), END, np.uint64)
            out[np.arange(len(hashes)) + words.document()] = hashes
            ids = part.column("doc_id")
            held.append((ids.fill_null(0).to_numpy().astype(np.int64), np.asarray(ids.is_null()).astype(np.uint8), part.column("part").to_numpy().astype(np.uint8), (n + 1).astype(np.int32), out))
        if held:
            yield flush()

    return docs.mapInArrow(run, BLOCK)


def key_mask(n_tokens: int) -> int:
    """Which bits of a hash are the key of a pair or triple; never the lowest, which says that a key is a word's."""
    bits = min(63, max(48, n_tokens.bit_length() + SPARE_BITS))
    return (1 << 64) - (1 << (64 - bits))


def _dealt(groups: int) -> int:
    """Shuffle partitions for so many groups."""
    return max(1, min(groups, MOST_PARTITIONS))


@dataclass
class _Block:
    """A decoded block: its distinct words and pairs, and which of each every token is."""

    doc_ids: np.ndarray
    missing: np.ndarray
    folds: np.ndarray
    counts: np.ndarray
    vocabulary: np.ndarray
    tokens: np.ndarray

    @classmethod
    def read(cls, row: dict) -> _Block:
        return cls(_values(row["doc_ids"], np.int64), np.frombuffer(row["missing"], np.uint8), np.frombuffer(row["folds"], np.uint8), _values(row["counts"], np.int32), _sorted_keys(row["vocabulary"]), _values(row["tokens"], np.int32))

    def __post_init__(self) -> None:
        self.first = np.zeros(len(self.tokens), bool)
        self.first[np.concatenate([[0], np.cumsum(self.counts)[:-1]])] = True
        self.context = np.where(self.first, len(self.vocabulary), np.roll(self.tokens, 1)).astype(np.int64)  # of a first word the start
        local, self.pair = np.unique(self.context * (len(self.vocabulary) + 1) + self.tokens, return_inverse=True)
        self._named = np.append(self.vocabulary, START)
        self.pair_hash = tk.combine([self._named[local // (len(self.vocabulary) + 1)], self.vocabulary[local % (len(self.vocabulary) + 1)]])
        self.part = np.repeat(self.folds, self.counts)

    def keys(self, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of words and pairs, and which of them each token's word and pair are."""
        words, pairs = self.vocabulary | WORD, self.pair_hash & np.uint64(mask)
        keys, at = np.unique(np.concatenate([words, pairs]), return_inverse=True)
        return keys, at[: len(words)][self.tokens], at[len(words) :][self.pair]

    def triples(self, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that follow another of their document, which of the distinct triples each ends, and a token and the key of each of these."""
        inner = np.flatnonzero(~self.first)
        local, at = np.unique(self.pair[inner - 1].astype(np.int64) * (len(self.vocabulary) + 1) + self.tokens[inner], return_inverse=True)
        some = np.zeros(len(local), np.int64)
        some[at] = inner
        keys = tk.combine([self.pair_hash[self.pair[some - 1]], self.vocabulary[self.tokens[some]]]) & np.uint64(mask)
        return inner, at, some, keys

    def counted(self, at: np.ndarray, n: int, rows: np.ndarray | None = None) -> list[np.ndarray]:
        """How often each of ``n`` keys is met by tokens of each fold."""
        part = self.part if rows is None else self.part[rows]
        return [np.bincount(at[part == f], minlength=n).astype(np.uint32) for f in (COUNTED, MIXED, HELD_OUT)]


def _owner(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each key; it rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


PLANES = ("counted", "mixed", "held")
_NUMBERS = {**dict.fromkeys(("child", "squad", "range"), pa.int64()), **dict.fromkeys(("keys", *PLANES, "every", "elsewhere"), pa.binary())}
ASKED = ["child", "squad", "range", "keys", *PLANES]
REPLIED = ["child", "range", "every", "counted", "elsewhere"]


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {'long' if _NUMBERS[n] == pa.int64() else 'binary'}" for n in names)


def _table(names: list[str], rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ((),) * len(names)
    return pa.table({n: pa.array(list(c), _NUMBERS[n]) for n, c in zip(names, columns, strict=True)})


def _cut(keys: np.ndarray, planes: list[np.ndarray], ranges: int) -> Iterator[tuple]:
    """(range, blobs of its keys and planes) of sorted keys."""
    owner = _owner(keys, ranges)
    used = np.unique(owner)
    lo, hi = np.searchsorted(owner, used), np.searchsorted(owner, used, "right")
    for r, a, b in zip(used.tolist(), lo.tolist(), hi.tolist(), strict=True):
        yield r, _sorted_blob(keys[a:b]), *(_planes(p[a:b].astype(np.uint64)) for p in planes)


def _merge(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct keys of the rows, where each row's keys are among them, and the sums of each plane."""
    each = [_sorted_keys(r["keys"]) for r in rows]
    keys, at = np.unique(np.concatenate(each), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([_values(r[f], np.uint64) for r in rows]).astype(float), minlength=len(keys)).astype(np.uint64) for f in PLANES]
    return keys, np.split(at, np.cumsum([len(x) for x in each])[:-1]), sums


def _in_order(replies: pa.Table, field: str, dtype: type = np.uint64) -> np.ndarray:
    """What replies say, in the order of a block's keys."""
    rows = sorted(replies.select(["range", field]).to_pylist(), key=lambda r: r["range"])
    return np.concatenate([_values(r[field], dtype) for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)


def levels(owners: int, fan_out: int = FAN_OUT) -> list[int]:
    """Ranges at each level: ``fan_out`` times as many as before, and at last at least ``owners``."""
    out, n = [], 1
    while n * fan_out < owners:
        n *= fan_out
        out.append(n)
    return [*out, n * -(-owners // n)]


def exchange(asked: DataFrame, owners: int, n_blocks: int, mask: int, fan_out: int = FAN_OUT) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """Counts over all blocks, for each block in the order of its keys.

    ``asked`` has a row for each block: child (its number), keys, and a plane
    of counts for each fold. The replies (child, range, every, counted,
    elsewhere) hold, range by range, the sums over training documents, those
    over documents that EM counts with (for keys that the child has in a
    document that EM scores, else 0), and whether any document of another
    child has the key. With them come the sum and number of the counts of
    words in ``every`` and ``counted``.
    """
    ranges = levels(owners, fan_out)
    top = len(ranges) - 1
    squads = max(1, -(-n_blocks // fan_out))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                squad = int(tk.mix(np.array([row["child"]], np.int64).view(np.uint64))[0] % np.uint64(squads))
                cut = _cut(_sorted_keys(row["keys"]), [_values(row[f], np.uint64) for f in PLANES], ranges[0])
                yield from _table(ASKED, [(row["child"], squad, *piece) for piece in cut]).to_batches()

    def up(level: int) -> Callable[[pa.Table], pa.Table]:
        def merge(group: pa.Table) -> pa.Table:
            rows = group.select(ASKED).to_pylist()
            keys, _, sums = _merge(rows)
            squad, own = rows[0]["squad"], rows[0]["range"]
            return _table(ASKED, [(squad * ranges[level] + own, squad // fan_out, *piece) for piece in _cut(keys, sums, ranges[level + 1])])

        return merge

    def reply(rows: list[dict], at: list[np.ndarray], every: np.ndarray, counted: np.ndarray, total: np.ndarray, beyond: np.ndarray | None = None) -> list[tuple]:
        """To each row's sender, in the order of its keys; ``total`` is what stands here, ``beyond`` whether others have a key."""
        out = []
        for r, mine in zip(rows, at, strict=True):
            own = [_values(r[f], np.uint64) for f in PLANES]
            elsewhere = total[mine] > own[0] + own[1] + own[2]
            if beyond is not None:
                elsewhere |= beyond[mine]
            out.append((r["child"], r["range"], _planes(every[mine]), _planes(np.where(own[1] > 0, counted[mine], np.uint64(0))), _planes(elsewhere)))
        return out

    def answer(group: pa.Table) -> pa.Table:
        rows = group.select(ASKED).to_pylist()
        keys, at, (counted, mixed, held) = _merge(rows)
        every = counted + mixed
        words = (keys & WORD) > 0
        totals = [np.array([v[words].sum(), np.count_nonzero(v[words])], np.uint64) for v in (every, counted)]
        return _table(REPLIED, [*reply(rows, at, every, counted, every + held), (-1, rows[0]["range"], _planes(totals[0]), _planes(totals[1]), _planes(totals[0]))])

    def down(level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def merge(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = left.select(ASKED).to_pylist()
            if not rows:
                return _table(REPLIED, [])
            _, at, sums = _merge(rows)
            every, counted = (_in_order(right, f).astype(np.uint64) for f in ("every", "counted"))
            return _table(REPLIED, reply(rows, at, every, counted, sums[0] + sums[1] + sums[2], _in_order(right, "elsewhere", bool).astype(bool)))

        return merge

    sent = asked.mapInArrow(ask, _schema(ASKED))
    kept: list[DataFrame] = []
    for level in range(top):
        kept.append(materialise(sent, "asked") if level else sent)  # the first is made again on the way back
        spread = kept[-1].repartition(_dealt(n_blocks), "squad", "range")
        sent = spread.groupBy("squad", "range").applyInArrow(up(level), _schema(ASKED))
    replies = materialise(sent.repartition(_dealt(2 * ranges[top]), "range").groupBy("range").applyInArrow(answer, _schema(REPLIED)), "replies")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                every, counted = (_values(row[f], np.uint64).astype(np.int64) for f in ("every", "counted"))
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (*every, *counted)], ["a", "b", "c", "d"])

    sums = replies.where("child = -1").select("every", "counted").mapInArrow(spread, "a long, b long, c long, d long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in "abcd")).first()
    totals = {"every": (sums[0], sums[1]), "counted": (sums[2], sums[3])}
    for level in reversed(range(top)):
        own = (F.col("squad") * ranges[level] + F.col("range")).alias("me")
        left = kept[level].select(own, *ASKED).repartition(_dealt(n_blocks), "me")
        right = replies.where("child >= 0").select(F.col("child").alias("me"), *REPLIED).repartition(_dealt(n_blocks), "me")
        after = materialise(left.groupBy("me").cogroup(right.groupBy("me")).applyInArrow(down(level), _schema(REPLIED)), "replies")
        discard(replies)
        discard(kept[level])
        replies = after
    return replies, totals


def bucket(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: 0 for none, then by octaves."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def context_bucket(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bucket of the counts of a context of two words and of its last word."""
    return np.where(two > 0, _BUCKETS + bucket(two), bucket(one))


def _level(estimate: np.ndarray) -> np.ndarray:
    """Half octaves below 1, from 1 on; 0 for an estimate of zero."""
    depth = np.clip(np.rint(-np.log2(np.maximum(estimate, 2.0**-_DEPTH)) * _STEPS), 0, _DEPTH * _STEPS).astype(np.int64)
    return np.where(estimate > 0, depth + 1, 0)


def _estimate(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 2.0 ** (-(level - 1) / _STEPS), 0.0)


def fit_weights(events: np.ndarray, vocabulary: int, rounds: int = 200) -> np.ndarray:
    """Weights (bucket x 4: after two words, after one, alone, uniform) by EM from rows (bucket, levels of the three estimates, n)."""
    weights = np.full((2 * _BUCKETS, 4), 0.25)
    weights[:_BUCKETS, 0] = 0
    weights[0, 1] = 0
    weights /= weights.sum(axis=1, keepdims=True)
    for b in np.unique(events[:, 0]):
        mine = events[events[:, 0] == b]
        parts = np.concatenate([_estimate(mine[:, 1:4]), np.full((len(mine), 1), 1 / (vocabulary + 1))], axis=1) * (weights[b] > 0)
        n = mine[:, 4].astype(float)
        w = weights[b].copy()
        for _ in range(rounds):
            joint = parts * w
            new = (joint / joint.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            moved, w = np.abs(new - w).max(), new
            if moved < 1e-9:
                break
        w[3] = max(w[3], 1e-6)
        weights[b] = w / w.sum()
    return weights


def ask_for_pairs(encoded: DataFrame, mask: int) -> DataFrame:
    """Keys of each block's words and pairs, with the block's own counts by fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block.read(row)
                keys, word, pair = block.keys(mask)
                own = [a + b for a, b in zip(block.counted(word, len(keys)), block.counted(pair, len(keys)), strict=True)]
                yield from _table(["child", "keys", *PLANES], [(row["block"], _sorted_blob(keys), *(_planes(x.astype(np.uint64)) for x in own))]).to_batches()

    return encoded.mapInArrow(run, _schema(["child", "keys", *PLANES]))


PAIRED = BLOCK.replace("n_tokens long, ", "") + ", word binary, word_counted binary, pair binary, pair_counted binary, start long, start_counted long, elsewhere binary, own binary, own_counted binary"
COUNTED_BLOCK = "block long, doc_ids binary, missing binary, folds binary, counts binary, tokens binary, word binary, pair binary, triple binary, start long, events binary"


def _typed(schema: str, values: list | None) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([] if values is None else [values[k]], pa.int64() if t == "long" else pa.binary()) for k, (n, t) in enumerate(fields)})


def attach_pairs(encoded: DataFrame, replies: DataFrame, tasks: int, mask: int) -> DataFrame:
    """Each block, a few to a task, with the counts of its words and of its tokens' pairs, and which triples may stand elsewhere too.

    ``word`` and ``word_counted`` follow the vocabulary, ``pair`` the tokens,
    ``pair_counted`` those of the documents that EM scores, ``elsewhere`` (a
    bit) and ``own`` (the block's own count of any other triple) the tokens
    that follow another of their document.
    """

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _typed(PAIRED, None)
        row = left.to_pylist()[0]
        block = _Block.read(row)
        keys, word, pair = block.keys(mask)
        every, counted = (_in_order(right, f) for f in ("every", "counted"))
        others = _in_order(right, "elsewhere", bool).astype(bool)
        vocabulary = np.searchsorted(keys, block.vocabulary | WORD)
        end = int(np.searchsorted(keys, END | WORD))
        mixed = block.part == MIXED
        inner, at, some, _ = block.triples(mask)
        own = block.counted(at, len(some), inner)
        elsewhere = others[pair[some]] & others[pair[some - 1]]
        mine = [np.where(elsewhere, 0, x)[at] for x in (own[0] + own[1], own[0])]
        plain = lambda x: _planes(x.astype(np.uint64))
        carried = [row[x.split()[0]] for x in BLOCK.split(", ") if not x.startswith("n_tokens")]
        return _typed(PAIRED, [*carried, plain(every[vocabulary]), plain(counted[vocabulary]), plain(every[pair]), plain(counted[pair[mixed]]), int(every[end]), int(counted[end]), np.packbits(elsewhere[at]).tobytes(), *map(plain, mine)])

    left, right = encoded.repartition(tasks, "block"), replies.where("child >= 0").withColumnRenamed("child", "block").repartition(tasks, "block")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(join, PAIRED)


def _asked_triples(row: dict, block: _Block, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a paired block: inner tokens, the triple of each, which triples are asked for, their sorted keys, and which of these each is."""
    inner, at, some, hashes = block.triples(mask)
    bits = np.unpackbits(np.frombuffer(row["elsewhere"], np.uint8))[: len(inner)].astype(bool)
    asked = np.zeros(len(some), bool)
    asked[at] = bits
    keys, place = np.unique(hashes[asked], return_inverse=True)
    return inner, at, asked, keys, place


def ask_for_triples(paired: DataFrame, mask: int) -> DataFrame:
    """Keys of each block's triples that may stand elsewhere too, with the block's own counts by fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block.read(row)
                inner, at, asked, keys, place = _asked_triples(row, block, mask)
                own = [np.bincount(place, x[asked], minlength=len(keys)).astype(np.uint64) for x in block.counted(at, len(asked), inner)]
                yield from _table(["child", "keys", *PLANES], [(row["block"], _sorted_blob(keys), *map(_planes, own))]).to_batches()

    return paired.select("block", "doc_ids", "missing", "folds", "counts", "vocabulary", "tokens", "elsewhere").mapInArrow(run, _schema(["child", "keys", *PLANES]))


def attach_triples(paired: DataFrame, replies: DataFrame, tasks: int, n_counted: int, mask: int) -> DataFrame:
    """Each block with its tokens' counts of pairs and triples and its words' (``start``: count of the start), and the events of its mixed documents."""

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _typed(COUNTED_BLOCK, None)
        row = left.to_pylist()[0]
        block = _Block.read(row)
        inner, at, asked, _, place = _asked_triples(row, block, mask)

        def counts_of(field: str, own: str) -> np.ndarray:
            """Of each inner token's triple, from the replies or the block's own."""
            each = np.zeros(len(asked), np.int64)
            each[asked] = _in_order(right, field)[place]
            return np.where(asked[at], each[at], _values(row[own], np.uint64).astype(np.int64))

        pair = _values(row["pair"], np.uint64).astype(np.int64)
        triple = pair.copy()  # two starts and a word are a start and a word
        triple[inner] = counts_of("every", "own")
        mixed = block.part == MIXED
        begins = block.first[mixed]
        word_c = _values(row["word_counted"], np.uint64).astype(np.int64)[block.tokens[mixed]]
        pair_c = _values(row["pair_counted"], np.uint64).astype(np.int64)
        every_c = np.zeros(len(block.tokens), np.int64)
        every_c[inner] = counts_of("counted", "own_counted")
        triple_c = np.where(begins, pair_c, every_c[mixed])
        one, two = (np.where(begins, row["start_counted"], np.roll(x, 1)) for x in (word_c, pair_c))
        code = context_bucket(two, one)
        for a, b in ((triple_c, two), (pair_c, one), (word_c, np.array(n_counted))):
            code = code * 64 + _level(a / np.maximum(b, 1))
        codes, n = np.unique(code, return_counts=True)
        events = np.stack([codes >> 18, codes >> 12 & 63, codes >> 6 & 63, codes & 63, n], axis=1).astype(np.int64)
        return _typed(COUNTED_BLOCK, [row["block"], row["doc_ids"], row["missing"], row["folds"], row["counts"], row["tokens"], row["word"], row["pair"], _planes(triple.astype(np.uint64)), row["start"], events.tobytes()])

    left, right = paired.repartition(tasks, "block"), replies.where("child >= 0").withColumnRenamed("child", "block").repartition(tasks, "block")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(join, COUNTED_BLOCK)


def lm_scores(docs: DataFrame, train_when: Column | None = None, block_bytes: int = BLOCK_BYTES, keys_per_partition: int = KEYS_PER_PARTITION, fan_out: int = FAN_OUT) -> DataFrame:
    """Log10 probability of every whole text under a model of the training texts.

    ``train_when`` is a condition on ``doc_id`` for the documents to learn
    from. One row per input row: doc_id, learned (whether it was learned
    from), n_tokens, n_known (tokens that training texts have), train_tokens,
    base_score (add-one unigram), score. A null text is an empty one: its only
    token is the end. Without training documents all estimates are uniform
    over nothing known and both scores are 0. Rows that repeat a doc_id count
    each, in the training counts too; equal texts have equal scores; other
    columns are ignored.
    """
    use = F.coalesce(train_when, F.lit(True)) if train_when is not None else F.lit(True)
    part = F.when(~use, HELD_OUT).when(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0, MIXED).otherwise(COUNTED)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("part", part.cast("int"))
    encoded = materialise(blocks(source, block_bytes), "blocks")
    n_tokens, n_blocks = encoded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    owners, tasks, mask = max(1, -(-n_tokens // keys_per_partition)), _dealt(-(-n_blocks // BLOCKS_PER_TASK)), key_mask(n_tokens)
    replies, totals = exchange(ask_for_pairs(encoded, mask), owners, n_blocks, mask, fan_out)
    paired = materialise(attach_pairs(encoded, replies, tasks, mask), "paired")
    discard(encoded)
    discard(replies)
    replies, _ = exchange(ask_for_triples(paired, mask), owners, n_blocks, mask, fan_out)
    counted = materialise(attach_triples(paired, replies, tasks, totals["counted"][0], mask), "counted")
    discard(paired)
    discard(replies)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("events").to_pylist():
                rows = np.frombuffer(blob, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, k].astype(np.int32)) for k in range(4)), pa.array(rows[:, 4])], ["b", "t", "p", "w", "n"])

    got = counted.select("events").mapInArrow(spread, "b int, t int, p int, w int, n long").groupBy("b", "t", "p", "w").agg(F.sum("n").alias("n")).toArrow()  # cells of a fixed grid
    events = np.stack([got.column(c).to_numpy() for c in ("b", "t", "p", "w", "n")], axis=1) if got.num_rows else np.zeros((0, 5), np.int64)
    weights = fit_weights(events, totals["counted"][1])
    n_train, v_train = totals["every"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = _values(row["counts"], np.int32)
                pair, triple = (_values(row[f], np.uint64).astype(float) for f in ("pair", "triple"))
                word = _values(row["word"], np.uint64).astype(float)[_values(row["tokens"], np.int32)]
                first = np.concatenate([[0], np.cumsum(counts)[:-1]])
                one, two = np.roll(word, 1), np.roll(pair, 1)
                one[first] = two[first] = row["start"]
                w = weights[context_bucket(two, one)]
                p = w[:, 0] * triple / np.maximum(two, 1) + w[:, 1] * pair / np.maximum(one, 1) + w[:, 2] * word / max(n_train, 1) + w[:, 3] / (v_train + 1)
                if not n_train:
                    p = np.ones(len(word))
                base = np.log10((word + 1) / (n_train + v_train + 1))
                ids = pa.array(_values(row["doc_ids"], np.int64), mask=np.frombuffer(row["missing"], np.uint8).astype(bool))
                known = np.add.reduceat((word > 0).astype(np.int64), first)
                columns = [ids, pa.array(np.frombuffer(row["folds"], np.uint8) != HELD_OUT), pa.array(counts.astype(np.int64)), pa.array(known), pa.array(np.full(len(counts), n_train)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.select("doc_ids", "missing", "folds", "counts", "tokens", "word", "pair", "triple", "start").mapInArrow(score, "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), train_when=fold(7) != 2)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
