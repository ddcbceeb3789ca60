"""Toxicity: a logistic classifier that is indifferent to which group a sentence names.

Labelled sentences that name a group are copied with the term swapped for the others of its kind and
for a neutral word; the training loss adds the squared change of the logit between both. The change
is that of all features: the term and its beginnings go as far as no other word of the sentence has
them, those of the other come as far as they are new. Weight on either then costs as much as it moves
scores, and words of abuse must carry the label.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import held_out, label_of
from .quality_classifier import training_rows

#: Labelled rows of each label the model is fitted on, at most: the smallest hashes of the id.
SAMPLE_ROWS = 6_000
#: Words and word beginnings that may carry weight: those that tell the labels apart best, by the
#: likelihood ratio of their presence.
FEATURES = 400
BEGINNINGS = (4, 5, 6)
RIDGE = 3e-3
COUNTERFACTUAL = 2.0
STEPS = 300
THRESHOLD = 0.3

#: Group terms by kind, swapped within their kind; the first word of a kind is its neutral one.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "gay", "straight", "lesbian", "trans"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("citizens", "black", "white", "asian", "latino", "arab", "african", "european"),
    ("residents", "immigrants", "refugees", "foreigners", "natives"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("personnes", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words and, marked by a star, their beginnings."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*map(beginnings, words))


def beginnings(word: str) -> set[str]:
    return {word[:k] + "*" for k in BEGINNINGS if len(word) > k}


def telling(rows: list[tuple[set[str], int]], count: int = FEATURES) -> list[str]:
    """The ``count`` tokens whose presence has the largest likelihood ratio against the label."""
    n = np.array([sum(y == v for _, y in rows) for v in (0, 1)], dtype=float)
    seen: dict[str, list[int]] = {}
    for words, y in rows:
        for w in words:
            seen.setdefault(w, [0, 0])[y] += 1
    names = sorted(seen)
    have = np.array([seen[w] for w in names], dtype=float).reshape(-1, 2)
    ratio = np.zeros(len(names))
    for part in (have, n - have):
        expected = part.sum(axis=1, keepdims=True) * n / n.sum()
        ratio += (part * np.log(np.maximum(part, 1e-9) / np.maximum(expected, 1e-9))).sum(axis=1)
    return [names[i] for i in np.argsort(-ratio, kind="stable")[:count]]


def telling_of(rows: DataFrame, count: int = FEATURES) -> list[str]:
    """:func:`telling` over a table ``label, words``: tokens are counted by Spark."""
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = (sizes.get(0, 0), sizes.get(1, 0))
    counted = (
        rows.select("label", F.explode("words").alias("w"))
        .groupBy("w")
        .agg(F.sum(1 - F.col("label")).alias("c0"), F.sum("label").alias("c1"))
    )
    ratio = F.lit(0.0)
    for part in ((F.col("c0"), F.col("c1")), (n[0] - F.col("c0"), n[1] - F.col("c1"))):
        whole = part[0] + part[1]
        for have, of_label in zip(part, n):
            expected = whole * (of_label / max(sum(n), 1))
            few = F.lit(1e-9)
            ratio = ratio + have * F.log(F.greatest(have, few) / F.greatest(expected, few))
    top = counted.select("w", ratio.alias("r")).orderBy(F.desc("r"), "w").limit(count)
    return [r["w"] for r in top.collect()]


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        known = self.weights
        z = self.bias + sum(known[w] for w in tokens(text) & known.keys())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def swaps(words: set[str], terms=IDENTITY_TERMS) -> list[tuple[str, str]]:
    """Every exchange of a group term of the text for another term of its kind."""
    return [(a, b) for kind in terms for a in kind if a in words for b in kind if b != a]


def exchanges(words: set[str], terms=IDENTITY_TERMS) -> list[tuple[frozenset, frozenset]]:
    """Per swap the tokens of the text that it takes away and the ones that it adds."""
    found, whole = [], {w for w in words if not w.endswith("*")}
    for a, b in swaps(words, terms):
        rest = (whole - {a}) | {b}
        after = rest.union(*map(beginnings, rest))
        own, new = {a} | beginnings(a), {b} | beginnings(b)
        found.append((frozenset((own & words) - after), frozenset((new & after) - words)))
    return found


def train(
    rows: list[tuple[set[str], int]], *, counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE
) -> Model:
    """Training on word sets held in memory; see :func:`descend`."""
    names = features(telling(rows))
    at = {w: i for i, w in enumerate(names)}
    found = [([at[w] for w in words if w in at], y) for words, y in rows]
    moves = [m for words, _ in rows for m in known_exchanges(words, at)]
    return descend(names, found, moves, counterfactual=counterfactual, ridge=ridge)


def known_exchanges(words: set[str], at: dict[str, int]) -> list[tuple[tuple, tuple]]:
    """:func:`exchanges` as places of weights, without tokens that have none."""
    place = lambda ws: tuple(sorted(at[w] for w in ws if w in at))
    return [(place(gone), place(new)) for gone, new in exchanges(words)]


def features(chosen: list[str]) -> list[str]:
    """The chosen tokens and all group terms, in the order of the weights."""
    return sorted({t for kind in IDENTITY_TERMS for t in kind}.union(chosen))


def descend(
    names: list[str],
    rows: list[tuple[list[int], int]],
    moves: list[tuple[tuple, tuple]],
    *,
    counterfactual: float = COUNTERFACTUAL,
    ridge: float = RIDGE,
) -> Model:
    """Full-batch training on the features each row has; both labels weigh the same. ``moves`` are the
    features that each swap in a row takes away and adds."""
    labels = np.array([y for _, y in rows], dtype=float)
    if not len(rows) or labels.min() == labels.max():
        return Model({}, 0.0 if not len(rows) else (30.0 if labels[0] else -30.0))
    col = np.array([i for found, _ in rows for i in found], dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), [len(found) for found, _ in rows])
    changes = sorted(Counter(moves).items())
    often = np.array([n for _, n in changes], dtype=float) / len(rows)
    parts = [(c, i, sign) for c, (m, _) in enumerate(changes) for side, sign in zip(m, (1, -1)) for i in side]
    which, swap, sign = np.array(parts, dtype=np.int64).reshape(-1, 3).T
    share = labels.mean()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) / len(rows)
    m, w, bias = len(names), np.zeros(len(names) + 1), 0.0
    mean, square = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, STEPS + 1):  # Adam with a soft threshold towards sparse weights
        z = np.bincount(row, w[:m][col], len(rows)) + bias
        gap = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels)
        grad = np.append(np.bincount(col, gap[row], m), 0.0)
        if len(swap):
            gaps = np.bincount(which, sign * w[swap], len(changes))
            np.add.at(grad, swap, sign * (counterfactual * often * gaps)[which])
        grad[:m] += ridge / m * w[:m]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        rate = 0.1 / (1 + step / 100)
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        w = w - move
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * 0.02)
        w[m] = 0.0
        bias -= rate * float(gap.sum()) * 4
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w[:m]) > 0.05)}, bias)


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> Model:
    """A bounded sample of each label is tokenised once into a table; Spark counts its tokens and
    only the features each sampled row has reach the driver."""
    known = label_of(labels, "toxic").where(~held_out())

    def words(frames):
        for f in frames:
            yield pd.DataFrame({"label": f["label"], "words": [sorted(tokens(t)) for t in f["text"]]})

    parts = [
        training_rows(
            docs, known.where(F.col("label") == v).withColumnRenamed("label", "toxic"), "toxic", rows
        )
        for v in (0, 1)
    ]
    sample = cut(
        parts[0].union(parts[1]).select("label", "text").mapInPandas(words, "label int, words array<string>"),
        "toxicity",
    )
    names = features(telling_of(sample))
    at = {w: i for i, w in enumerate(names)}

    def known_only(frames):
        for f in frames:
            yield pd.DataFrame(
                {
                    "label": f["label"],
                    "found": [[at[w] for w in ws if w in at] for ws in f["words"]],
                    "moves": [[[*map(list, m)] for m in known_exchanges(set(ws), at)] for ws in f["words"]],
                }
            )

    schema = "label int, found array<int>, moves array<array<array<int>>>"
    got = sample.mapInPandas(known_only, schema).toArrow().to_pylist()
    moves = [(tuple(gone), tuple(new)) for r in got for gone, new in r["moves"]]
    return descend(names, sorted((r["found"], r["label"]) for r in got), moves)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row: ``doc_id, held_out, score, predicted``.

    Null, empty and blank texts get the score of a text without known words. Without labels every score
    is 0.5, with one label it is that label. Repeated rows and null ids are scored like any other.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.value.score(t) for t in texts], dtype="float64")

    return docs.select("doc_id", score("text").alias("score")).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
