"""Signal and anomaly tables out of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.signals import AMS, ANOMALY, may_be_ams, may_be_anomaly
from ..functions.steps import pinned
from ..schema import SESSION
from . import chunks as H

SIGNAL_COLUMNS = (
    "device_serial", "session_id", "seq", "line_index", "kind", "process", "pid", "uid",
    "reason", "crashing", "detail", "ms",
)
ANOMALY_COLUMNS = (
    "device_serial", "session_id", "seq", "line_index", "kind", "severity", "process", "pid",
    "detail",
)


def parsed_rows(records: DataFrame, *columns: str, raw: str, also: Column | None = None) -> DataFrame:
    """``columns``, the ``line``, and its signal ``ams`` and ``anomaly`` (NULL when it has none) of the
    rows with a needle of either, or for which ``also`` holds. Needles are looked for once a row."""
    text = F.col(raw)
    gates = F.struct(may_be_ams(text).alias("ams"), may_be_anomaly(text).alias("anomaly"))
    marked = pinned(records, "_may", gates)
    ams, anomaly = F.col("_may.ams"), F.col("_may.anomaly")
    kept = marked.where(ams | anomaly if also is None else also | ams | anomaly).select(
        *columns, text.alias("line"), "_may"
    )
    out = AMS.on(kept, F.when(ams, F.col("line")), "ams")
    return ANOMALY.on(out, F.when(anomaly, F.col("line")), "anomaly").drop("_may")


def evidence(
    records: DataFrame, *, raw: str = "raw", ranks: DataFrame | None = None
) -> DataFrame:
    """The few rows that carry a signal or an anomaly, both parsed in one pass.

    A needle gate runs before any regular expression. ``line_index`` counts all rows of the
    session, found through a rank structure (``ranks``, where it is stored), so the log itself is
    never shuffled.
    """
    parsed = parsed_rows(records, *SESSION, "seq", raw=raw)
    found = parsed.where(F.col("ams").isNotNull() | F.col("anomaly").isNotNull())
    return H.place_in(found, H.line_ranks(records) if ranks is None else ranks)


def signals_of(found: DataFrame, *, strict_uid: bool = False) -> DataFrame:
    """Activity-manager signals. With ``strict_uid`` only a start names the uid."""
    rows = found.where(F.col("ams").isNotNull()).select(
        *SESSION, "seq", "line_index", "ams.*", R.ms_of_day(F.col("line")).alias("ms"),
        F.col("line").alias("raw"),
    )
    if strict_uid:
        rows = rows.withColumn("uid", F.when(F.col("kind") == "amProcStart", F.col("uid")))
    return rows


def anomalies_of(found: DataFrame) -> DataFrame:
    return found.where(F.col("anomaly").isNotNull()).select(
        *SESSION, "seq", "line_index", "anomaly.*", F.col("line").alias("raw")
    )


def ams_signals(records: DataFrame, *, ranks: DataFrame | None = None, **options) -> DataFrame:
    return signals_of(evidence(records, ranks=ranks), **options)


def anomalies(records: DataFrame, *, ranks: DataFrame | None = None) -> DataFrame:
    return anomalies_of(evidence(records, ranks=ranks))


def anomaly_counts(found: DataFrame, *keys: Column | str) -> DataFrame:
    """Counts by kind and severity (per session unless ``keys`` says otherwise)."""
    return found.groupBy(*(keys or SESSION), "kind", "severity").agg(
        F.count(F.lit(1)).alias("n")
    )
