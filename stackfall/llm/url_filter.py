"""URL filters: host and path rules, and a logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ``(verdict, host, path)``; a rule fits its host and all subdomains from its path on.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: The labelled URL table that models are trained from unless another is given.
LABELLED = (
    ("https://www.city-library.example.org/en/opening-hours", 0),
    ("https://news.example.org/2021/05/election-results.html", 0),
    ("https://docs.python-guide.example.org/en/tutorial/", 0),
    ("http://university.example.edu/physics/lectures/12", 0),
    ("https://blog.gardening.example.org/de/roses.html", 0),
    ("https://m.weather.example.org/fr/paris", 0),
    ("https://recipes.example.org/es/tortilla?page=2", 0),
    ("https://museum.example.org/de/ausstellung/", 0),
    ("https://www.train-times.example.org/en/timetable", 0),
    ("https://wiki.example.org/en/History_of_art", 0),
    ("https://open-data.example.org/en/catalog/14", 0),
    ("https://health-service.example.org/fr/vaccination", 0),
    ("https://chess.example.org/en/openings/853/", 0),
    ("https://letters.example.org/en/774#top", 0),
    ("https://theriver.example.org/fr/414", 0),
    ("https://blog.thenorth.example.org/de/612?utm_source=feed", 0),
    ("https://cheap-pills.example.org/en/450?page=2", 1),
    ("http://www.cheap-pills-online.example.org/buy-now", 1),
    ("https://spam-farm.example.org/en/728", 1),
    ("http://spam-links.example.org/click/here", 1),
    ("https://ads-track.example.org/es/14868/", 1),
    ("https://pixel.ads-tracker.example.org/click?id=9", 1),
    ("http://casino-bonus.example.org/free-spins", 1),
    ("https://win-casino.example.org/jackpot/777", 1),
    ("https://xxx-adult-cams.example.org/live", 1),
    ("https://free-porn-video.example.org/xxx/12", 1),
    ("http://payday-loans-fast.example.org/apply-now", 1),
    ("https://replica-watches-cheap.example.org/sale", 1),
    ("https://get-rich-click.example.org/offer", 1),
    ("https://malware-download.example.org/crack/keygen.exe", 1),
    ("https://buy-viagra-pills.example.org/discount", 1),
    ("https://track.ads-banner.example.org/pop-under", 1),
)
SIZES = (3, 4, 5)
BUCKETS = 1 << 15
RIDGE = 1e-3
STEPS = 400


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(found, F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end."""
    found = F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(found, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null without one."""
    text = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def grams(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams of host and path; digits count as one character."""
    found = set()
    for part, text in (("h", f"^{host}$"), ("p", f"^{path.lower()}$")):
        text = "".join("0" if c.isdigit() else c for c in text)
        for n in SIZES:
            found.update(part + text[i : i + n] for i in range(len(text) - n + 1))
    return np.unique([zlib.crc32(g.encode()) % BUCKETS for g in found]).astype(np.int64)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        at = grams(host, path)
        z = self.bias + self.weights[at].sum() / np.sqrt(max(1, len(at)))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[cut:].partition("#")[0].partition("?")[0]
    return rest[:cut].lower(), tail


def train(labelled: Sequence[tuple[str, int]] = LABELLED) -> Model:
    """Gradient descent on the small table; an empty one gives a model that allows everything."""
    weights, bias = np.zeros(BUCKETS), -2.0
    rows = [grams(*split(url)) for url, _ in labelled]
    y = np.array([label for _, label in labelled], dtype=float)
    for _ in range(STEPS if rows else 0):
        z = np.array([bias + weights[r].sum() / np.sqrt(len(r)) for r in rows])
        gap = (1 / (1 + np.exp(-z)) - y) / len(rows)
        weights *= 1 - RIDGE
        for r, g in zip(rows, gap):
            weights[r] -= 4 * g / np.sqrt(len(r))
        bias -= gap.sum()
    return Model(weights, bias)


def judge(pages: DataFrame, rules: Sequence = RULES, model: Model | None = None) -> DataFrame:
    """One row per row: ``page_id, host, path, rule, verdict, score``.

    The longest rule decides, else the model (``block`` from a score of 0.5). A url that is
    null or has no ``://`` has empty host and path, which fit no rule, and is allowed or blocked by the
    model like any other. Null ids and repeated rows stay; other columns are ignored.
    """
    model = train() if model is None else model
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([known.score(h, p) for h, p in zip(hosts, paths)], dtype="float64")

    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    scored = parts.withColumn("rule", rule).withColumn("_v", verdict).withColumn(
        "score", score("host", "path")
    )
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("_v", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
