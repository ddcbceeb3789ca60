"""What a collection read, and what it could not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..schema import SESSION


def read_outcomes(reads: DataFrame) -> DataFrame:
    """Adds ``status`` and ``hint`` to reads (text, error_text, exit_code, records).

    A found artifact without records carries no hint.
    """
    out = reads.withColumn(
        "status", C.read_status(F.col("text"), F.col("error_text"), F.col("exit_code"))
    )
    return out.withColumn("hint", C.read_remedy(F.col("status")))


def collection_report(outcomes: DataFrame) -> DataFrame:
    """One row per session: sources found, records, failure, and the hints in order.

    Hints are a handful of fixed texts; they are made distinct before they are collected.
    """
    hints = (
        outcomes.where(F.col("hint").isNotNull())
        .groupBy(*SESSION, "hint")
        .agg(F.min("ordinal").alias("_at"))
        .groupBy(*SESSION)
        .agg(F.array_sort(F.collect_list(F.struct("_at", "hint"))).alias("_h"))
        .select(*SESSION, F.transform("_h", lambda h: h.getField("hint")).alias("hints"))
    )
    totals = outcomes.groupBy(*SESSION).agg(
        F.count_if(F.col("status") == "found").alias("sources_found"),
        F.sum(F.col("records").cast("bigint")).alias("records"),
        (~F.bool_or(F.col("status").isin("found", "empty"))).alias("failed"),
    )
    return totals.join(hints, list(SESSION), "left").withColumn(
        "hints", F.coalesce("hints", F.array().cast("array<string>"))
    )
