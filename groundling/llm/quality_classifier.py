"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of each whole text (:mod:`docstats`) are standardised and mapped by
``sqrt(2/D) cos(Wx + b)`` with Gaussian ``W``, whose inner products approximate
a Gaussian kernel. Ridge scores come from the normal equations: every
partition adds up its ``Z'Z`` and ``Z'y``, the sums are added in three levels,
and the driver solves one ``D x D`` system however many documents there are.
A fifth of the training labels is kept for calibration: pool-adjacent-violators
on a histogram of their scores turns a score into the share of good documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.llm.docstats import document_stats, fold, one_label
from groundling.session import materialise

BINS = 1000


def features() -> list[Column]:
    """Doubles that describe a document, from its statistics."""
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    chars = F.greatest(c("word_chars"), F.lit(1))
    letters = F.greatest(c("n_letters"), F.lit(1))
    return [
        F.log1p(c("n_words")),
        F.log1p(c("word_chars") / words),
        F.log1p(c("n_symbols") / words * 10),
        F.log1p(c("n_bang") / words * 10),
        c("n_upper") / letters,
        c("n_digits") / chars,
        c("n_punct") / words,
        c("n_nonascii") / chars,
        c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
        c("n_repeat_words") / words,
        c("n_distinct") / words,
        F.log1p(c("n_words") / F.greatest(c("n_lines"), F.lit(1))),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    phase: np.ndarray
    theta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weight + self.phase)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.project(x) @ self.theta[:-1] + self.theta[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(position: np.ndarray, total: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and rising values for linear interpolation."""
    blocks: list[list[float]] = []
    for p, n, k in zip(position, total, positive, strict=True):
        blocks.append([p * n, float(n), float(k)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _add_up(parts: DataFrame) -> DataFrame:
    """Sum the float64 blobs of equal ``slot``."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in group.column("blob"))
        return pa.table({"slot": group.column("slot").slice(0, 1), "blob": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy("slot").applyInArrow(add, "slot int, blob binary")


def fit(train: DataFrame, dimension: int, gamma: float, ridge: float, seed: int) -> Model | None:
    """Model from all rows (``doc_id, x, label``); None if there are none."""
    n = len(features())
    row = train.agg(F.count("*"), *(f(F.col("x")[k]) for k in range(n) for f in (F.avg, F.stddev_pop))).first()
    if not row[0]:
        return None
    mean, scale = np.array(row[1::2], float), np.array(row[2::2], float)
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, math.sqrt(2 * gamma), (n, dimension)), rng.uniform(0, 2 * np.pi, dimension), np.zeros(dimension + 1), np.zeros(1), np.zeros(1))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension + 1, dimension + 2))
        for batch in batches:
            if batch.num_rows:
                z = np.hstack([model.project(_matrix(batch)), np.ones((batch.num_rows, 1))])
                y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
                total[:, :-1] += z.T @ z
                total[:, -1] += z.T @ y
        if total[-1, -2]:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "blob"])

    held = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0
    fitted = train.where(~held).mapInArrow(equations, "slot int, blob binary")
    fitted = fitted.withColumn("slot", F.spark_partition_id())
    for slots in (256, 16, 1):
        fitted = _add_up(fitted.withColumn("slot", F.pmod("slot", F.lit(slots)).cast("int")))
    sums = fitted.collect()
    if sums:
        total = np.frombuffer(sums[0]["blob"], np.float64).reshape(dimension + 1, dimension + 2)
        penalty = np.eye(dimension + 1) * ridge * total[-1, -2]
        penalty[-1, -1] = 0
        model.theta = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.rint(model.raw(_matrix(batch)) * BINS), -BINS, 2 * BINS) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("label")], ["bin", "label"])

    kept = train.where(held) if sums else train
    bins = sorted(kept.mapInArrow(scored, "bin int, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("k")).collect())
    if not bins:  # too few rows to keep any
        bins = sorted(train.mapInArrow(scored, "bin int, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("k")).collect())
    model.knots, model.values = isotonic(np.array([b[0] / BINS for b in bins]), np.array([b[1] for b in bins]), np.array([b[2] for b in bins]))
    return model


def quality_classifier(docs: DataFrame, labels: DataFrame, train_when: Column | None = None, dimension: int = 256, gamma: float = 0.05, ridge: float = 1e-5, seed: int = 11) -> DataFrame:
    """Quality of every whole text: doc_id, score (0 to 1), predicted (1 from 0.5 on).

    ``train_when`` is a condition on ``doc_id`` that rows used for learning
    must meet. Null and empty texts are scored like any other (no words).
    Without labelled training rows every score is 0.5. A document labelled
    more than once counts with its lowest label, a label other than 0 and 1 is
    none. Equal statistics have equal scores, repeated rows are scored alike
    and each counts in the fit; other columns are ignored.
    """
    stats = materialise(document_stats(docs), "quality-stats").select("doc_id", F.array(*(x.cast("double") for x in features())).alias("x"))
    train = stats.join(one_label(labels, "quality").where("label in (0, 1)"), "doc_id")
    model = fit(train.where(train_when) if train_when is not None else train, dimension, gamma, ridge, seed)
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], ["doc_id", "score"])

    return stats.mapInArrow(score, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier(docs, labels, train_when=F.coalesce(fold(3) != 1, F.lit(True)))
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
