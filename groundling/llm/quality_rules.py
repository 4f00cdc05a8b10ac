"""Quality rules with risk-controlled cutoffs.

Each rule compares one ratio of a document with a cutoff. The cutoff is not
set by hand: labelled good documents show how many of them a cutoff would
reject, and the exact (Clopper-Pearson) binomial upper bound on that rate must
stay within the rule's share of the permitted false rejection. Cutoffs are
tried from the most lenient to the strictest and the search stops at the first
that fails (fixed-sequence testing, so the sequence needs no correction); the
confidence is divided among all rules and strata (Bonferroni). With
probability at least ``1 - delta`` every stratum therefore loses at most
``alpha`` of its good documents. Among the proven cutoffs of a rule the most
lenient one is taken that catches as many labelled bad documents as the
strictest; a rule that catches none of them is off.

A trial is one text: however many ids a text stands under, and however many
rows an id has, they are one trial, so copies prove nothing twice. The bound
is on good texts drawn like the labelled ones; near copies among these are
trials of their own although they fare alike, which makes the bound as much
too sure as families of near copies are large.

To prove anything, ``least_trials`` good texts must all pass (1,030 by
default). Neighbouring strata are joined until each has as many; the numbers
of trials alone decide that, not what the rules do to them. With fewer in all
the rules are off.

What the driver sees is a histogram of labelled texts: rules x strata x grid,
whatever the table's size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundling.llm import textkernel as tk
from groundling.llm.docstats import COUNTS, document_stats, one_label, slice_stats
from groundling.session import materialise

#: Word counts at which strata begin.
STRATA = (0, 60, 250, 1000)


@dataclass(frozen=True)
class Rule:
    name: str
    above: bool
    """Whether values over the cutoff are rejected, else those under it."""
    low: float
    high: float
    steps: int = 100

    def grid(self) -> list[float]:
        """Cutoffs from the most lenient on."""
        values = [self.low + (self.high - self.low) * k / self.steps for k in range(self.steps + 1)]
        return values[::-1] if self.above else values


RULES = (
    Rule("symbol_ratio", True, 0.0, 1.0),
    Rule("bang_ratio", True, 0.0, 2.0),
    Rule("upper_ratio", True, 0.0, 1.0),
    Rule("dup_line_ratio", True, 0.0, 1.0),
    Rule("repeat_ratio", True, 0.0, 0.2, 40),
    Rule("digit_ratio", True, 0.0, 1.0),
    Rule("word_length", True, 4.0, 24.0),
    Rule("distinct_ratio", False, 0.0, 0.5, 50),
)


def ratio(name: str) -> Column:
    c = F.col
    words, letters = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_letters"), F.lit(1))
    return {
        "symbol_ratio": c("n_symbols") / words,
        "bang_ratio": c("n_bang") / words,
        "upper_ratio": c("n_upper") / letters,
        "dup_line_ratio": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
        "repeat_ratio": c("n_repeat_words") / words,
        "digit_ratio": c("n_digits") / F.greatest(c("word_chars"), F.lit(1)),
        "word_length": c("word_chars") / words,
        "distinct_ratio": c("n_distinct") / words,
    }[name]


def stratum() -> Column:
    out = F.lit(0)
    for k, least in enumerate(STRATA[1:], 1):
        out = F.when(F.col("n_words") >= least, k).otherwise(out)
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials at rate p: the regularised incomplete beta function I(1 - p; n - k, k + 1), by its continued fraction."""
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    a, b, x = float(n - k), float(k + 1), 1.0 - p
    if x >= (a + 1) / (a + b + 2):  # the fraction is quick on one side; the other is the complement
        return 1.0 - _beta_part(b, a, p)
    return _beta_part(a, b, x)


def _beta_part(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + term * d or tiny)
            c = 1.0 + term / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Exact upper bound at confidence ``1 - delta`` for a rate seen ``k`` times in ``n``."""
    if n <= 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_tail(k, n, mid) > delta else (lo, mid)
    return hi


def most_rejections(n: int, rate: float, delta: float) -> int:
    """The largest k whose upper bound in n trials is within ``rate``; -1 if not even none rejected proves it."""
    lo, hi = -1, max(0, math.floor(rate * n))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if binomial_tail(mid, n, rate) <= delta else (lo, mid - 1)
    return lo


def least_trials(rate: float, delta: float) -> int:
    """Trials that prove a rate when none is rejected."""
    return math.ceil(math.log(delta) / math.log1p(-rate))


def joined_strata(totals: dict[int, int], alpha: float, delta: float, rules: tuple[Rule, ...] = RULES) -> dict[int, int]:
    """Stratum of proof of each stratum: neighbours are joined until each has trials enough to prove something."""
    need = least_trials(alpha / len(rules), delta / (len(rules) * len(STRATA)))
    out, at, have = {}, 0, 0
    for s in range(len(STRATA)):
        out[s] = at
        have += totals.get(s, 0)
        if have >= need:
            at, have = s + 1, 0
    if at < len(STRATA) and have < need and at:  # too few are left over: with those before
        last = out[at - 1]
        out = {s: last if t == at else t for s, t in out.items()}
    return out


def choose_cutoffs(rejections: dict[tuple[str, int], list[int]], totals: dict[int, int], alpha: float, delta: float, caught: dict[tuple[str, int], list[int]] | None = None, rules: tuple[Rule, ...] = RULES) -> dict[tuple[str, int], float]:
    """A proven cutoff of each rule and stratum; absent where none is proven or none is of use.

    ``rejections[rule, stratum][g]`` counts good documents that grid cutoff
    ``g`` rejects, ``caught`` bad ones. All cutoffs up to the first failure
    are proven at once, so any of them may be chosen: the most lenient that
    catches what the strictest does; without bad documents, the strictest.
    """
    share, level = alpha / len(rules), delta / (len(rules) * len(STRATA))
    most = {s: most_rejections(n, share, level) for s, n in totals.items()}
    out = {}
    for rule in rules:
        for s in totals:
            zeros = [0] * (rule.steps + 1)
            bad = (caught or {}).get((rule.name, s))
            best = 0
            for g, (cutoff, k) in enumerate(zip(rule.grid(), rejections.get((rule.name, s), zeros), strict=True)):
                if k > most[s]:
                    break
                if bad is None or bad[g] > best:
                    out[rule.name, s], best = cutoff, bad[g] if bad else 0
    return out


def trials(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """One row per labelled text of ``stats`` that the base rules keep.

    Of an id with several texts the least counts, of a text with several
    labels the lowest.
    """
    known = stats.where(~base_failed()).join(one_label(labels, label_col).where("label in (0, 1)"), "doc_id")
    per_id = known.groupBy("doc_id").agg(F.min_by(F.struct("label", "text_class", *COUNTS), "text_class").alias("t")).select("t.*")
    return per_id.groupBy("text_class").agg(F.min_by(F.struct("label", *COUNTS), "label").alias("t")).select("t.*")


def fit_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float, delta: float, label_col: str = "quality") -> dict[tuple[str, int], float]:
    """Cutoffs by rule and stratum, from all :func:`trials`."""
    known = trials(stats, labels, label_col)
    columns = []
    for rule in RULES:
        step = (rule.high - rule.low) / rule.steps
        # the first grid index that rejects, steps + 1 if none does
        offset = (F.lit(rule.high) - ratio(rule.name)) / step if rule.above else (ratio(rule.name) - rule.low) / step
        index = F.floor(offset + 1e-9) + 1
        columns.append(F.struct(F.lit(rule.name).alias("rule"), F.least(F.greatest(index, F.lit(0)), F.lit(rule.steps + 1)).cast("int").alias("g")))
    counts = known.select("label", stratum().alias("s"), F.explode(F.array(*columns)).alias("x")).groupBy("label", "s", "x.rule", "x.g").count().collect()
    first: dict[tuple[int, str, int], dict[int, int]] = {}
    totals: dict[tuple[int, int], int] = {}
    for row in counts:
        first.setdefault((row["label"], row["rule"], row["s"]), {})[row["g"]] = row["count"]
        if row["rule"] == RULES[0].name:
            totals[row["label"], row["s"]] = totals.get((row["label"], row["s"]), 0) + row["count"]

    def running(label: int, rule: Rule, s: int) -> list[int]:
        out = []
        for g in range(rule.steps + 1):
            out.append((out[-1] if out else 0) + first.get((label, rule.name, s), {}).get(g, 0))
        return out

    good = {s: n for (label, s), n in totals.items() if label == 1}
    proof = joined_strata(good, alpha, delta)
    zeros = {rule.name: [0] * (rule.steps + 1) for rule in RULES}
    rejections, caught = {}, {}
    for s, to in proof.items():
        for rule in RULES:
            for label, table in ((1, rejections), (0, caught)):
                if totals.get((label, s)):
                    before = table.get((rule.name, to), zeros[rule.name])
                    table[rule.name, to] = [x + y for x, y in zip(before, running(label, rule, s), strict=True)]
    joined = {to: sum(good.get(s, 0) for s, t in proof.items() if t == to) for to in set(proof.values())}
    chosen = choose_cutoffs(rejections, joined, alpha, delta, caught)
    return {(name, s): chosen[name, to] for s, to in proof.items() for name in zeros if (name, to) in chosen}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def rejected_by(cutoffs: dict[tuple[str, int], float]) -> Column:
    """Name of the first rule that rejects a document, null if none does."""
    out, s = F.lit(None).cast("string"), stratum()
    for rule in reversed(RULES):
        for k in range(len(STRATA)):
            if (rule.name, k) in cutoffs:
                # the same offset arithmetic as in the fit, so that grid borders agree
                step = (rule.high - rule.low) / rule.steps
                g = rule.grid().index(cutoffs[rule.name, k])
                offset = (F.lit(rule.high) - ratio(rule.name)) / step if rule.above else (ratio(rule.name) - rule.low) / step
                out = F.when((s == k) & (F.floor(offset + 1e-9) + 1 <= g), F.lit(rule.name)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Statistics and verdict of every document.

    One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, kept (boolean), rule (string: ``base``,
    the rejecting rule's name or null). Null and empty texts have no words and
    fail the base rules. Without labels no rule is proven and only the base
    rules reject. A document labelled more than once counts with its lowest
    label; a label other than 0 and 1 is none; a value that equals its cutoff
    is kept. Repeated rows are judged alike; other columns of either table are
    ignored.
    """
    stats = materialise(document_stats(docs), "rule-stats")
    cutoffs = fit_cutoffs(stats, labels, alpha, delta)
    rule = F.when(base_failed(), F.lit("base")).otherwise(rejected_by(cutoffs))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), rule.isNull().alias("kept"), rule.alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Rows of ``docs`` that the rules keep; the texts are read once and carry their statistics to the filter."""
    added = [(name, T.LongType()) for name in COUNTS]
    counted = materialise(tk.annotate(docs, added, lambda text: list(map(pa.array, slice_stats(text).values()))), "counted")
    ids = f"c{docs.columns.index('doc_id')}"
    text = F.col(f"c{docs.columns.index('text')}").cast("string")
    cutoffs = fit_cutoffs(counted.select(F.col(ids).cast("long").alias("doc_id"), F.md5(F.coalesce(text, F.lit(""))).alias("text_class"), *COUNTS), labels, alpha, delta)
    return tk.restore(counted.where(~base_failed() & rejected_by(cutoffs).isNull()), docs)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE_SQL: dict[str, str] = {}
