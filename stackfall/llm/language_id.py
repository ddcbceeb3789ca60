"""Language identification with bit-sliced Bloom filters over character n-grams.

Every slot of a slice is a bit mask with one bit per language: a look-up of one n-gram ands
one mask per slice and returns all languages that contain it at once. A language's count of
hits, less the hits its fill rate explains, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Documents per language the filters are learned from, at most: those of the smallest id hash.
SAMPLE_ROWS = 4_000
#: N-grams per language, the most telling ones, and slots of each slice.
GRAMS = 4_000
SLOTS = 1 << 16
SLICES = 3
#: An n-gram belongs to a language whose rate of it is at least this part of the highest rate.
BELONGS = 0.2
SIZES = (2, 3, 4)

_U = np.uint64
_PIECE = 1 << 20  # characters looked up at a time
_MUL = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a lower-cased text between two spaces, part by part; parts overlap,
    so that n-grams over a cut are found once and a cut adds none."""
    padded = f" {text} ".lower()
    for at in range(0, len(padded), _PIECE):
        part = padded[at : at + _PIECE + max(SIZES) - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "replace"), dtype=np.uint32).astype(_U)
        for n in SIZES:
            own = codes[: _PIECE + n - 1]  # n-grams that begin before the next part
            if len(own) >= n:
                h = np.full(len(own) - n + 1, n, dtype=_U)
                for k in range(n):
                    h = (h ^ own[k : len(own) - n + 1 + k]) * _MUL[0]
                    h ^= h >> _U(29)
                yield h


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Filters(NamedTuple):
    languages: tuple[str, ...]
    slices: np.ndarray  # SLICES x slots masks
    false_rate: np.ndarray  # per language: chance that a foreign n-gram hits all slices

    def masks(self, h: np.ndarray) -> np.ndarray:
        found = None
        for i, row in enumerate(self.slices):
            at = ((h * _MUL[i % 3] + _U(i)) >> _U(40)) & _U(row.shape[0] - 1)
            found = row[at] if found is None else found & row[at]
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of all corrected counts; ``und`` without any letter."""
        if not self.languages or not has_letter(text):
            return "und", 0.0
        hits, total = np.zeros(len(self.languages)), 0
        for h in grams(text):
            found = self.masks(h)
            total += len(found)
            for i in range(len(self.languages)):
                hits[i] += np.count_nonzero(found & _U(1 << i))
        # observed = true + (total - true) * false rate
        true = np.maximum(0.0, (hits - total * self.false_rate) / (1.0 - self.false_rate))
        best = int(np.argmax(true))
        whole = float(true.sum())
        return self.languages[best], float(true[best] / whole) if whole else 0.0


def fit(docs: DataFrame) -> Filters:
    """Learn from text and language of rows that are not held out; counts are added up by Spark.

    More than 63 languages do not fit a mask and are refused.
    """
    chosen = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()
    ).select("lang", "doc_id", "text")
    total = chosen.groupBy("lang").count().collect()
    rates = {r["lang"]: min(1.0, SAMPLE_ROWS / r["count"]) for r in total}
    if len(rates) > 63:
        raise ValueError("a mask holds 63 languages at most")
    languages = tuple(sorted(rates))
    if not languages:
        return Filters((), np.zeros((SLICES, SLOTS), _U), np.zeros(0))
    limit = F.element_at(
        F.create_map(*(F.lit(x) for lang in languages for x in (lang, rates[lang]))), F.col("lang")
    )
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = chosen.where(spread < limit)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                h, n = np.unique(
                    np.concatenate([h for t in part["text"] for h in grams(t)] or [np.empty(0, _U)]),
                    return_counts=True,
                )
                yield pd.DataFrame({"lang": lang, "h": h.view(np.int64), "n": n})

    counted = (
        sample.select("lang", "text")
        .mapInPandas(count, "lang string, h long, n long")
        .groupBy("lang", "h")
        .agg(F.sum("n").alias("n"))
    )
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))
    top = counted.withColumn("r", rank).where(F.col("r") <= GRAMS).toPandas()
    sums = top.groupby("lang")["n"].sum()
    table = top.pivot_table(index="h", columns="lang", values="n", fill_value=0)
    rate = (table / sums).reindex(columns=list(languages), fill_value=0.0).fillna(0.0).to_numpy()
    belongs = rate >= BELONGS * rate.max(axis=1, keepdims=True)
    belongs &= rate > 0
    h = table.index.to_numpy().view(np.int64).view(_U)
    mask = (belongs * (1 << np.arange(len(languages)))).sum(axis=1).astype(_U)
    slices = np.zeros((SLICES, SLOTS), dtype=_U)
    for i in range(SLICES):
        at = ((h * _MUL[i % 3] + _U(i)) >> _U(40)) & _U(SLOTS - 1)
        np.bitwise_or.at(slices[i], at.astype(np.int64), mask)
    fill = np.array(
        [[np.count_nonzero(row & _U(1 << i)) / SLOTS for row in slices] for i in range(len(languages))]
    )
    return Filters(languages, slices, fill.prod(axis=1))


def identify(docs: DataFrame) -> DataFrame:
    """One row per row: ``doc_id, held_out, lang_pred, score``.

    Null texts and texts without letter are ``und`` with score 0; a text none of whose n-grams is
    known gets the first language with score 0, as do ties. Repeated rows and null ids stay.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [model.value.predict(t) for t in texts], columns=["lang_pred", "score"]
        ).astype({"score": "float64"})

    return docs.select("doc_id", predict("text").alias("p")).select(
        "doc_id", held_out().alias("held_out"), "p.lang_pred", "p.score"
    )
