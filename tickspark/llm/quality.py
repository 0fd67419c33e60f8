"""Quality classification by Naive Bayes support vectors.

Indicators of character n-grams and of word-shape n-grams (case, ending, repeats the word before) are scaled by the log
ratio of their counts in the two classes; a linear hinge-loss model over the scaled indicators is fitted by dual
coordinate descent; its weights are interpolated with their mean magnitude. Margins are turned into probabilities on a
part of the sample that the fit doesn't see. The fit uses at most ``per_class`` labelled rows of each class (by hash of
the identifier), whatever the size of the table; every text is scored whole.

Edge cases: null and empty texts have no features and score as the model's intercept says; labels that are null or
given with both values for one identifier are left out; without labels of both classes every score is the share of label
1 (0.5 without labels); repeated rows are scored alike; a very long text is scored whole, slice by slice, and not learnt from;
an empty table gives no rows; other columns are ignored or kept as asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.features import collected, indicators, logistic, platt, remainder, sampled, scored
from tickspark.llm.text import given_back, set_aside

BITS = 18
ORDERS = (1, 2, 3, 4)
THRESHOLD = 0.3


class Model:
    """weights over scaled indicators (already multiplied by the log-count ratios), intercept, and the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, intercept: float):
        self.weights, self.bias, self.slope, self.intercept = weights, bias, slope, intercept

    def margins(self, rows: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[c].sum() / np.sqrt(len(c) or 1) + self.bias for c in rows], np.float64)

    def scores(self, of, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        return {"score": logistic(self.slope * self.margins(of(data, offsets)) + self.intercept)}


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, size), smooth)
    for codes, y in zip(rows, positive, strict=True):
        counts[int(y), codes] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return (np.log(shares[1]) - np.log(shares[0])).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], positive: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear model with squared hinge loss over the indicators times ``scale``.

    One dual variable for each row is moved to its optimum in turn; the intercept is a feature of value 1.
    """
    rng, weights, bias = np.random.default_rng(seed), np.zeros(len(scale), np.float32), 0.0
    values = [scale[c] / np.sqrt(len(c) or 1) for c in rows]
    curve = np.array([float(v @ v) for v in values]) + 1 + 1 / (2 * cost)
    dual, sign = np.zeros(len(rows)), np.where(positive, 1.0, -1.0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1 + dual[i] / (2 * cost)
            new = max(dual[i] - gradient / curve[i], 0.0)
            step = (new - dual[i]) * sign[i]
            if step:
                weights[rows[i]] += np.float32(step) * values[i]
                bias += step
                moved = max(moved, abs(step))
            dual[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float, size: int, beta: float = 0.75) -> Model:
    """beta: weight of the fitted model against its mean magnitude in the interpolation."""
    if positive.all() or not positive.any():
        p = min(max(prior, 1e-3), 1 - 1e-3) if len(positive) else 0.5
        return Model(np.zeros(size, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))

    def weighed(at: np.ndarray) -> tuple[np.ndarray, float]:
        own = [rows[i] for i in at]
        scale = log_count_ratios(own, positive[at], size)
        weights, bias = dual_coordinate_descent(own, positive[at], scale)
        return ((1 - beta) * np.abs(weights).mean() + beta * weights) * scale, bias

    held = np.arange(len(rows)) % 4 == 3
    if positive[held].all() or not positive[held].any() or positive[~held].all() or not positive[~held].any():
        held = np.zeros(len(rows), bool)
    weights, bias = weighed(np.flatnonzero(~held))
    tried = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    margins = Model(weights, bias, 1, 0).margins(rows[i] for i in tried)
    return Model(weights, bias, *platt(margins, positive[tried], prior))


def features():
    return indicators(ORDERS, BITS, shapes=True, lower=False)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] = (5, 0), per_class: int = 1500) -> Model:
    """Learns from labels whose identifier isn't in the held-out fold; at most ``per_class`` texts of each class."""
    known = labels.where((remainder(F.col("doc_id"), fold[0]) != fold[1]) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("other")).where(F.col(label) == F.col("other"))
    share, n = known.agg(F.avg(label), F.count(F.lit(1))).first()
    y, rows = collected(sampled(known, docs, label, per_class), label, features)
    return fit(rows, y == 1, share if n else 0.5, 1 << BITS)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, features, partial(_weigh, shared), "score double", keep)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    aside, names = set_aside(docs, "text")
    return given_back(score(aside, model, keep=tuple(names)).where(F.col("score") >= threshold), names, docs.columns)


def _weigh(shared, of, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    return shared.value.scores(of, data, offsets)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
