"""Quality classifier: regularised quadratic discriminant over transformed text statistics."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, label_of
from .text_stats import STOP_WORDS, SYMBOLS

#: Labelled rows a model is fitted on, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: Weight of the pooled covariance, and of its diagonal, in each class covariance.
SHRINK_POOLED = 0.1
SHRINK_DIAGONAL = 0.05
#: Added to every variance, so a statistic that never varies does not decide alone.
RIDGE = 1e-3
THRESHOLD = 0.7


#: Statistics of one text, transformed so that each class is close to a bell shape.
NAMES = ("symbols", "repeats", "lines", "stops", "word_length", "variety", "line_length")
_STOPS = frozenset(STOP_WORDS)
_ROOM = 40  # words added to denominators: shares of short texts are drawn to 0


def statistics(text: str | None) -> tuple[float, ...]:
    """Roots of shares and logs of sizes of one whole text; all 0 for null or blank text."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return (0.0,) * len(NAMES)
    lines = [x for x in text.split("\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    share = lambda part, whole: math.sqrt(part / (whole + _ROOM))
    return (
        share(sum(map(text.count, SYMBOLS)), n),
        share(len(windows) - len(set(windows)), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(sum(map(_STOPS.__contains__, words)), n),
        math.log((sum(map(len, words)) + 5 * _ROOM) / (n + _ROOM)),
        math.log1p(len(set(words))) / math.log1p(n),
        math.log(n / len(lines)),
    )


def _features():
    @F.pandas_udf(", ".join(f"{c} double" for c in NAMES))
    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=NAMES, dtype="float64")

    return features


class Gaussian(NamedTuple):
    log_prior: float
    mean: np.ndarray
    factor: np.ndarray  # inverse of the lower Cholesky factor of the covariance
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.factor.T
        return self.log_prior - self.log_det - 0.5 * (z * z).sum(axis=1)


class Discriminant(NamedTuple):
    """Two Gaussians, or a constant score where only one label (or none) was seen."""

    good: Gaussian | None
    bad: Gaussian | None
    constant: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.good is None or self.bad is None:
            return np.full(len(x), self.constant)
        gap = self.good.log_density(x) - self.bad.log_density(x)
        return 1.0 / (1.0 + np.exp(-np.clip(gap, -500, 500)))


def training_rows(docs: DataFrame, labels: DataFrame, name: str, rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents outside the held-out part.

    The chosen ids are a table of bounded size, so broadcasting them keeps the texts in place.
    """
    chosen = (
        label_of(labels, name)
        .where(~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> Discriminant:
    """Class moments are sums Spark adds up; only 2 rows of them reach the driver."""
    x = training_rows(docs, labels, "quality", rows)
    x = x.select("label", _features()("text").alias("x")).select("label", "x.*")
    pairs = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]
    got = (
        x.groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *(F.sum(c).alias(c) for c in NAMES),
            *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i, j in pairs),
        )
        .collect()
    )
    sums = {}
    for r in got:
        mean = np.array([r[c] for c in NAMES]) / r["n"]
        second = np.zeros((len(NAMES), len(NAMES)))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        sums[r["label"]] = (r["n"], mean, second - np.outer(mean, mean))
    total = sum(n for n, _, _ in sums.values())
    if len(sums) < 2:
        return Discriminant(None, None, float(next(iter(sums), 0.5)))
    pooled = sum(n * cov for n, _, cov in sums.values()) / total
    found = {}
    for label, (n, mean, cov) in sums.items():
        mixed = (1 - SHRINK_POOLED) * cov + SHRINK_POOLED * pooled
        mixed = (1 - SHRINK_DIAGONAL) * mixed + SHRINK_DIAGONAL * np.diag(np.diag(mixed))
        lower = np.linalg.cholesky(mixed + RIDGE * np.eye(len(NAMES)))
        found[label] = Gaussian(
            float(np.log(n / total)), mean, np.linalg.inv(lower), float(np.log(np.diag(lower)).sum())
        )
    return Discriminant(found[1], found[0], 0.5)


def _scorer(model: Discriminant):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))
        return pd.Series(model.score(rows))

    return score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null and empty texts have all statistics 0 and get the score of the origin. Without labels of
    both kinds every score is the one label seen, or 0.5. Repeated rows are scored alike; a row
    without id is not held out. Labels, language, source and id never enter a score.
    """
    model = fit(docs, labels)
    scored = docs.select("doc_id", _scorer(model)("text").alias("score"))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, model: Discriminant, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns unchanged."""
    return docs.where(_scorer(model)("text") >= threshold)
