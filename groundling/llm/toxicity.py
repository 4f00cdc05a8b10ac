"""Toxicity: a convolutional text classifier in numpy.

A word is the sum of three hashed embeddings: of itself and of its first four
and six bytes, so that unseen forms of a known stem share its vector. Filters
of widths 1, 2 and 3 run over the words of the whole text, their largest
responses go through a logistic layer. The network is fitted on the driver on
a bounded sample of labelled rows (``SAMPLE_ROWS`` of each class and
``SAMPLE_WORDS`` words, both parameters); its tables have a fixed size and go
to the executors as a broadcast.

Scores are calibrated by language, on all labelled rows that were kept from
the fit (a quarter): they are scored where they lie, and a histogram of
languages x logits x labels gives each language inferred from the text the
logit cutoff with the best F1, which is mapped to a score of 0.3. Language
profiles count all rows that may be learned from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.llm import textkernel as tk
from groundling.llm.docstats import fold, one_label
from groundling.llm.language_id import Profiles, _sums, fit_profiles, word_likelihoods
from groundling.session import materialise

ROWS = 1 << 17
WIDTH = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
THRESHOLD = 0.3
SAMPLE_ROWS = 2000
SAMPLE_WORDS = 2_500_000
#: Steps of a logit in the calibration's histogram, and where it ends.
LOGIT_STEPS, LOGIT_END = 50, 30
#: Labelled rows of either class that a language needs for a cutoff of its own.
LEAST_LABELS = 20
_SLICE = 1 << 20

#: ASCII punctuation separates words here.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[x for x in range(33, 127) if not chr(x).isalnum()]] = 32


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (words x 3, int32) and each document's first word."""
    raw, off = tk.utf8(pc.utf8_lower(pc.fill_null(column, "")))
    words = tk.Words(_PLAIN[raw], off)
    ids = np.empty((len(words.start), 3), np.int32)
    for k, length in enumerate((None, 4, 6)):
        end = words.end if length is None else np.minimum(words.end, words.start + length)
        ids[:, k] = (tk.mix(tk.hash_spans(words.raw, words.start, end) + np.uint64(k)) % np.uint64(ROWS)).astype(np.int32)
    return ids, words.first


@dataclass
class Network:
    embedding: np.ndarray
    filters: np.ndarray
    """WIDTH x (sum over widths of width * FILTERS); column blocks by width and place."""
    bias: np.ndarray
    weight: np.ndarray
    intercept: float
    cutoffs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    """Logit that maps to THRESHOLD, by language of the profiles."""
    slope: float = 1.0

    def scores(self, logit: np.ndarray, language: np.ndarray) -> np.ndarray:
        z = self.slope * (logit.astype(float) - self.cutoffs[language]) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @staticmethod
    def blocks() -> list[tuple[int, int, int]]:
        """(width, place, column) of each block of FILTERS columns."""
        out, at = [], 0
        for w in WIDTHS:
            for j in range(w):
                out.append((w, j, at))
                at += FILTERS
        return out

    def responses(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors, and response of every filter at every word (-inf where a window would leave the text)."""
        x = self.embedding[ids[:, 0]] + self.embedding[ids[:, 1]] + self.embedding[ids[:, 2]]
        each = x @ self.filters
        n = len(x)
        left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words from here to the end of the text
        out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for i, w in enumerate(WIDTHS):
            y = np.full((n, FILTERS), -np.inf, np.float32)
            if n >= w:
                y[: n - w + 1] = 0
                for ww, j, at in self.blocks():
                    if ww == w:
                        y[: n - w + 1] += each[j : n - w + 1 + j, at : at + FILTERS]
            y[left < w] = -np.inf
            out[:, i * FILTERS : (i + 1) * FILTERS] = y
        return x, out + self.bias

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        _, y = self.responses(ids, first)
        out = np.zeros((len(first) - 1, y.shape[1]), np.float32)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            out[full] = np.maximum(np.maximum.reduceat(y, first[full], axis=0), 0)
        return out

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first) @ self.weight + self.intercept


def batches_of(texts: list[np.ndarray], order: Iterable[int], size: int, words: int = 30_000) -> Iterator[list[int]]:
    """Runs of up to ``size`` texts and ``words`` words; a longer text is a run of its own."""
    part: list[int] = []
    total = 0
    for k in order:
        if part and (len(part) == size or total + len(texts[k]) > words):
            yield part
            part, total = [], 0
        part.append(int(k))
        total += len(texts[k])
    if part:
        yield part


def _log_odds(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of label 1 for the documents that hold each embedding row."""
    seen = np.zeros((2, ROWS))
    for ids, label in zip(texts, labels, strict=True):
        seen[int(label), np.unique(ids)] += 1
    rate = (seen + 0.5) / (np.bincount(labels, minlength=2)[:, None] + 1)
    strength = seen.sum(0) / (seen.sum(0) + 3)
    return (np.log(rate[1] / rate[0]) * strength).clip(-4, 4)


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Network:
    """Fit by AdaGrad; embeddings start from the classes' log-odds in one dimension and noise in the others."""
    rng = np.random.default_rng(seed)
    total = sum(WIDTHS) * FILTERS
    net = Network((rng.normal(0, 0.1, (ROWS, WIDTH))).astype(np.float32), rng.normal(0, 0.3, (WIDTH, total)).astype(np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.3, np.float32), -1.0)
    net.embedding[:, 0] = 0.5 * _log_odds(texts, labels)
    net.filters[0, :] = np.abs(net.filters[0, :]) + 0.2
    memory = {k: np.full_like(getattr(net, k), 1e-3) for k in ("embedding", "filters", "bias", "weight")}
    intercept_memory = 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for chosen in batches_of(texts, order[[len(texts[k]) > 0 for k in order]], batch):
            part = [texts[k] for k in chosen]
            y = labels[chosen].astype(float)
            first = np.concatenate([[0], np.cumsum([len(t) for t in part])])
            ids = np.concatenate(part)
            x, response = net.responses(ids, first)
            at = np.stack([first[d] + response[first[d] : first[d + 1]].argmax(axis=0) for d in range(len(part))])
            most = np.maximum(np.take_along_axis(response, at, axis=0), 0)
            logit = most @ net.weight + net.intercept
            delta = (1 / (1 + np.exp(-logit)) - y) / len(part)
            inner = (delta[:, None] * net.weight * (most > 0)).astype(np.float32)
            grads = {"weight": most.T @ delta, "bias": inner.sum(axis=0), "filters": np.zeros_like(net.filters)}
            touched, moves = [], []
            for w, j, column in net.blocks():
                unit = slice(WIDTHS.index(w) * FILTERS, (WIDTHS.index(w) + 1) * FILTERS)
                place, g = np.minimum(at[:, unit] + j, len(x) - 1), inner[:, unit]
                kernel = net.filters[:, column : column + FILTERS]
                grads["filters"][:, column : column + FILTERS] = np.einsum("dfe,df->ef", x[place], g)
                touched.append(ids[place].reshape(-1, 3))
                moves.append((g[:, :, None] * kernel.T[None]).reshape(-1, WIDTH))
            rows, moves = np.concatenate(touched), np.concatenate(moves)
            unique, inverse = np.unique(rows, return_inverse=True)
            step = np.zeros((len(unique), WIDTH), np.float32)
            np.add.at(step, inverse.reshape(rows.shape).ravel(), np.repeat(moves, 3, axis=0))
            memory["embedding"][unique] += step**2
            net.embedding[unique] -= rate * step / np.sqrt(memory["embedding"][unique])
            for name, grad in grads.items():
                memory[name] += grad**2
                setattr(net, name, (getattr(net, name) - rate * grad / np.sqrt(memory[name])).astype(np.float32))
            intercept_memory += delta.sum() ** 2
            net.intercept -= rate * delta.sum() / np.sqrt(intercept_memory)
    return net


def best_cutoff(logit: np.ndarray, negative: np.ndarray, positive: np.ndarray) -> float:
    """Midpoint cutoff with the best F1 from counts at distinct logits; the middle of several equally good ones."""
    order = np.argsort(-logit, kind="stable")
    z, hits = logit[order], np.cumsum(positive[order])
    f1 = 2 * hits / (np.cumsum((negative + positive)[order]) + positive.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    lower = np.append(z[1:], z[-1] - 1.0)
    return float((z[best[0]] + lower[best[-1]]) / 2)


def calibrate(net: Network, bins: np.ndarray, languages: int) -> None:
    """Cutoffs and slope from rows (language, step of the logit, label, count)."""
    def counts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        steps, at = np.unique(rows[:, 1], return_inverse=True)
        return steps / LOGIT_STEPS, *(np.bincount(at, rows[:, 3] * (rows[:, 2] == label), minlength=len(steps)) for label in (0, 1))

    net.cutoffs = np.full(max(1, languages), best_cutoff(*counts(bins)))
    for k in range(languages):
        logit, negative, positive = counts(bins[bins[:, 0] == k])
        if positive.sum() >= LEAST_LABELS and negative.sum() >= LEAST_LABELS:
            net.cutoffs[k] = best_cutoff(logit, negative, positive)
    losses = {}
    for slope in (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0):  # the steepness with the smallest log-loss
        net.slope = slope
        p = np.clip(net.scores(bins[:, 1] / LOGIT_STEPS, bins[:, 0]), 1e-6, 1 - 1e-6)
        losses[slope] = -(bins[:, 3] * np.where(bins[:, 2] == 1, np.log(p), np.log(1 - p))).sum()
    net.slope = min(losses, key=losses.get)


def infer_language(profiles: Profiles, text: pa.Array) -> np.ndarray:
    """Index of each text's likeliest language."""
    loglik, first = word_likelihoods(profiles, text)
    return _sums(loglik, first).argmax(axis=1)


def sample_ids(labels: DataFrame, rows: int) -> DataFrame:
    """Up to ``rows`` document ids of each class in a fixed random order."""
    each = [labels.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(78)), "doc_id").limit(rows) for k in (0, 1)]
    return each[0].unionByName(each[1])


def _gather(docs: DataFrame, ids: DataFrame, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Word ids and labels of the sampled documents, ``words`` words at most, each id with one text.

    What fits is settled from the texts' sizes; only its word ids come to the
    driver. A text that is longer than what is left is passed over.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text", _SLICE):
            raw, off = tk.utf8(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_class"), pa.array(np.diff(tk.Words(_PLAIN[raw], off).first))], ["doc_id", "text_class", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text", _SLICE):
            each, first = word_ids(part.column("text"))
            blobs = [each[first[k] : first[k + 1]].tobytes() for k in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(blobs, pa.binary())], ["doc_id", "label", "ids"])

    known = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("text_class", F.md5(F.coalesce("text", F.lit(""))))
    sizes = known.select("doc_id", "text", "text_class").mapInArrow(measure, "doc_id long, text_class string, n long")
    left, chosen = words, []
    for row in sizes.groupBy("doc_id").agg(F.min(F.struct("text_class", "n")).alias("t")).orderBy(F.xxhash64("doc_id", F.lit(79)), "doc_id").collect():  # as many as sampled ids
        if row["t"]["n"] <= left:
            left -= row["t"]["n"]
            chosen.append((row["doc_id"], row["t"]["text_class"]))
    if not chosen:
        return [], np.zeros(0, int)
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, text_class string"))
    got = known.join(picked, ["doc_id", "text_class"]).select("doc_id", "label", "text").mapInArrow(encode, "doc_id long, label int, ids binary").dropDuplicates(["doc_id"]).collect()  # as many words as asked for
    order = {doc_id: k for k, (doc_id, _) in enumerate(chosen)}
    got.sort(key=lambda r: order[r["doc_id"]])
    return [np.frombuffer(r["ids"], np.int32).reshape(-1, 3) for r in got], np.array([r["label"] for r in got], int)


def toxicity(docs: DataFrame, labels: DataFrame, train_when: Column | None = None, sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """Toxicity of every whole text: doc_id, score (0 to 1), predicted (1 from 0.3 on).

    ``train_when`` is a condition on ``doc_id`` that rows used for learning
    must meet. Null and empty texts have no words and get the network's value
    for nothing found. Without labelled rows of both classes every score is 0.
    A document labelled more than once counts with its highest label, a label
    other than 0 and 1 is none; equal texts have equal scores, repeated rows
    are scored alike; a score equal to the threshold is predicted 1. Other
    columns are ignored, ``lang`` only names the languages of training rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"))
    known = one_label(labels, "toxic", "max").where("label in (0, 1)")
    known = known.where(train_when) if train_when is not None else known
    kept = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(4)) == 0
    fit_ids = sample_ids(known.where(~kept), sample_rows)
    texts, y = _gather(source, fit_ids, sample_words)
    if len(set(y.tolist())) < 2:
        return source.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    net = train(texts, y)
    profiles = fit_profiles(source.where(train_when) if train_when is not None else source)
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((net, profiles))  # fixed tables: ROWS x WIDTH, and those of the languages

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, profiles = shipped.value
        for part in tk.slices(batches, "text", _SLICE):
            language = infer_language(profiles, part.column("text")) if profiles.languages else np.zeros(part.num_rows, int)
            logit = np.clip(net.logits(*word_ids(part.column("text"))).astype(float), -LOGIT_END, LOGIT_END)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(language.astype(np.int32)), pa.array(logit)], ["doc_id", "language", "logit"])

    # every text is read once; calibration and scores work on its logit
    placed = materialise(source.select("doc_id", "text").mapInArrow(place, "doc_id long, language int, logit double"), "logits")

    def histogram(rows: DataFrame) -> np.ndarray:
        step = F.rint(F.col("logit") * LOGIT_STEPS).cast("int").alias("step")
        counted = placed.join(rows, "doc_id").groupBy("language", step, "label").count().collect()  # cells of a fixed grid
        return np.array([list(r) for r in counted], np.int64).reshape(-1, 4)

    bins = histogram(known.where(kept))
    if len(set(bins[:, 2].tolist())) < 2:  # too few rows to keep any
        bins = histogram(known)
    if len(bins):
        calibrate(net, bins, len(profiles.languages))
    cutoff = F.element_at(F.array(*(F.lit(float(c)) for c in (net.cutoffs if len(net.cutoffs) else [0.0]))), F.col("language") + 1)
    z = F.lit(net.slope) * (F.col("logit") - cutoff) + float(np.log(THRESHOLD / (1 - THRESHOLD)))
    out = placed.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity(docs, labels, train_when=F.coalesce(fold(4) != 2, F.lit(True)))
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
