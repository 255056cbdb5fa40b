"""A quality classifier as a sparse ensemble of rules.

Small boosted trees over statistics of the text propose rules: each path from a root is a conjunction of thresholds. A
lasso logistic regression weighs the rules and sets most weights to zero. What is left compiles into one Spark column
expression over the statistics, so scoring needs no model object on the executors.

Training reads a bounded sample of labelled rows (SAMPLE, by a hash of the id); every row is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused, valid_text
from .ledger import MEASURES, measures

STATISTICS = (
    "words", "word_chars", "symbols", "line_repeats", "window_repeats", "letters", "shouted", "line_words", "distinct_words",
    "top_word", "stutters", "digits", "punctuation",
)
#: Labelled rows that training may read, trees, leaves' depth, bins, step of boosting, lasso penalty, its iterations.
SAMPLE, TREES, DEPTH, BINS, STEP, PENALTY, ROUNDS = 10_000, 24, 3, 48, 0.4, 2e-4, 400
THRESHOLD = 0.3
_digits, _punctuation = bytes(set(range(256)) - set(b"0123456789")), bytes(set(range(256)) - set(b".,;:!?\"'()-"))


def statistics(text: bytes | None) -> tuple[float, ...]:
    """The values of STATISTICS: shares and means, so that long and short texts compare; a null text is an empty one."""
    text = text or b""
    m = dict(zip(MEASURES, measures(text), strict=True))
    words, n = text.split(), max(1, m["n_words"])
    counts = Counter(words)
    return (
        float(np.log1p(m["n_words"])), m["word_chars"] / n, m["n_symbols"] / n, m["n_dup_lines"] / max(1, m["n_lines"]),
        m["n_repeat_words"] / n, m["n_letter_words"] / n, m["n_shouted_words"] / n, m["n_words"] / max(1, m["n_lines"]),
        len(counts) / n, max(counts.values(), default=0) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        len(text.translate(None, _digits)) / n, len(text.translate(None, _punctuation)) / n,
    )


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))
def text_statistics(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for text in texts:
        yield pd.DataFrame([statistics(x) for x in text], columns=list(STATISTICS), dtype=float)


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(statistic, above, threshold)`` and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float

    def sql(self, of: str) -> str:
        parts = (f"{of}.{STATISTICS[k]} {'>' if above else '<='} {at!r}D" for k, above, at in self.terms)
        return f"if({' and '.join(parts)}, {self.weight!r}D, 0D)"

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, k] > at) == above for k, above, at in self.terms])


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, of: str) -> Column:
        """The probability of label 1 from a struct column of STATISTICS."""
        total = " + ".join([f"{self.bias!r}D", *(r.sql(of) for r in self.rules)])
        return F.expr(f"1D / (1D + exp(-({total})))")

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(x))))))


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    """Per column, thresholds midway between neighbouring values at even ranks."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def _grown(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """A tree's paths, inner and outer, and the step that its leaves give each row."""
    paths, step = [], np.zeros(len(gradient))

    def split(rows: np.ndarray, terms: tuple) -> None:
        if terms:
            paths.append(terms)
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None, None)
        if len(terms) < DEPTH and len(rows) >= 20:
            for k, at in enumerate(cuts):
                if not len(at):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, k], gradient[rows], len(at) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, k], hessian[rows], len(at) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(hl < 0.5) | (h - hl < 0.5)] = 0
                if (top := int(gain.argmax())) is not None and gain[top] > best[0]:
                    best = (float(gain[top]), k, top)
        _, k, cut = best
        if k is None:
            step[rows] = g / (h + 1)
            return
        above = binned[rows, k] > cut
        split(rows[~above], (*terms, (k, False, float(cuts[k][cut]))))
        split(rows[above], (*terms, (k, True, float(cuts[k][cut]))))

    split(np.arange(len(gradient)), ())
    return paths, step


def _lasso(holds: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for logistic loss with an L1 penalty; the bias is free."""
    n, m = holds.shape
    v = np.ones(m) / max(1, m) ** 0.5
    for _ in range(20):
        v = holds.T @ (holds @ v)
        v /= max(1e-12, np.linalg.norm(v))
    rate = 1 / (0.25 * (float(np.linalg.norm(holds @ v) ** 2) / n + 1) * 1.05)
    w, b, w_at, b_at, t = np.zeros(m), float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(m), 0.0, 1.0
    b_at = b
    for _ in range(ROUNDS):
        error = 1 / (1 + np.exp(-(holds @ w_at + b_at))) - y
        w_new = w_at - rate * (holds.T @ error) / n
        w_new = np.sign(w_new) * np.maximum(0, np.abs(w_new) - rate * PENALTY)
        b_new = b_at - rate * float(error.mean())
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w_at, b_at = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return b, w


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules from rows of STATISTICS and labels 0 or 1; without both labels, a constant score near their share."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Ensemble(float(np.log(share / (1 - share))), ())
    cuts = _cuts(x)
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    raw, found = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        paths, step = _grown(binned, cuts, y - p, np.maximum(p * (1 - p), 1e-6))
        raw += STEP * step
        for terms in paths:
            holds = Rule(terms, 0).holds(x)
            if 0 < holds.sum() < len(y):
                found.setdefault(np.packbits(holds).tobytes(), (terms, holds))
    if not found:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    bias, weights = _lasso(np.stack([h for _, h in found.values()], axis=1).astype(np.float64), y.astype(np.float64))
    return Ensemble(bias, tuple(Rule(t, float(w)) for (t, _), w in zip(found.values(), weights, strict=True) if abs(w) > 1e-3))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether an id is kept from training: its text's CRC-32 leaves no remainder by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> Ensemble:
    """An ensemble from the texts of at most ``sample`` labelled ids that aren't held out; null labels and ids don't count.

    Where ids repeat in ``docs`` or ``labels``, each pair of rows trains, up to ``2 * sample`` of them, those of the least ids.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("_y")).where("_id is not null and _y is not null")
    known = known.where(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    told = docs.select(F.col("doc_id").cast("long").alias("_id"), valid_text("text").cast("binary").alias("_t")).join(F.broadcast(known), "_id")
    rows = told.select("_id", "_y", text_statistics("_t").alias("s")).select("_id", "_y", "s.*").orderBy("_id", "_y").limit(2 * sample).toPandas()
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["_y"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null and empty texts are scored as texts without words, texts of any length whole. Rows that repeat a ``doc_id`` are
    scored each by its text; a null id is never held out; a score of ``threshold`` is accepted. Where labels repeat an id,
    each row trains. An empty table gives an empty result; without labels the score is a constant. Other columns are not
    read.
    """
    model = train(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_statistics(valid_text("text").cast("binary")).alias("s")).select("doc_id", model.score("s").alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier accepts; odd rows as in ``quality_scores``."""
    model, name = train(docs, labels), unused(docs, "_statistics")
    return docs.withColumn(name, text_statistics(valid_text("text").cast("binary"))).where(model.score(f"`{name}`") >= threshold).drop(name)
