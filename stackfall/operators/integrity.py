"""How complete a capture is: counters, gaps, and six checks per session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import is_binary_line, requested_buffers
from ..schema import CHECK_RANK, SESSION
from . import chunks as H


@dataclass(frozen=True)
class Limits:
    unparsed_notice: float = 0.01
    unparsed_warning: float = 0.10
    gap_notice_ms: int = 5_000
    gap_warning_ms: int = 30_000


def ring_stats(records: DataFrame, capacity: int) -> DataFrame:
    """What a ring of ``capacity`` records would hold and have dropped."""
    size = max(int(capacity), 1)
    pushed = F.col("total_pushed")
    return (
        records.groupBy(*SESSION)
        .agg(F.count(F.lit(1)).alias("total_pushed"))
        .select(
            *SESSION,
            F.least(pushed, F.lit(size)).cast("bigint").alias("len"),
            F.lit(size).cast("bigint").alias("capacity"),
            "total_pushed",
            F.greatest(pushed - size, F.lit(0)).cast("bigint").alias("total_dropped"),
        )
    )


def capture_counters(records: DataFrame) -> DataFrame:
    """Records, unparsed and binary rows per session: one map-side aggregate."""
    return records.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~F.col("parsed")).alias("unparsed"),
        F.count_if(is_binary_line(F.col("raw"))).alias("binary"),
    )


def gaps(records: DataFrame, *, ts: str = "device_ts", chunk_rows: int = H.CHUNK_ROWS) -> DataFrame:
    """Positive time to the previous timestamped record, in milliseconds.

    A record that lies back in time gives no gap but becomes the new baseline.
    """
    stamped = records.where(F.col(ts).isNotNull()).select(*SESSION, "seq", ts)
    before = H.scan(
        stamped, last={"_prev": F.col(ts)}, before=True, chunk_rows=chunk_rows
    )
    gap = _millis(F.col(ts)) - _millis(F.col("_prev"))
    return before.select(*SESSION, "seq", gap.alias("gap_ms")).where(F.col("gap_ms") > 0)


def _millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def gap_summary(found: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return found.groupBy(*SESSION).agg(
        F.max("gap_ms").alias("largest_gap_ms"),
        F.count(F.lit(1)).alias("n_gaps"),
        F.count_if(F.col("gap_ms") >= limits.gap_notice_ms).alias("n_long_gaps"),
    )


def stackless_crashes(events: DataFrame) -> DataFrame:
    return events.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("crashes"), F.count_if(F.col("n_frames") == 0).alias("stackless")
    )


def missing_buffers(sessions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requested buffers the device does not have. NULL when the device reported none."""
    asked = sessions.select(*SESSION, requested_buffers(F.col("command")).alias("requested"))
    have = profiles.select("device_serial", F.col("logcat_buffers").alias("available"))
    known = F.size(F.coalesce("available", F.array().cast("array<string>"))) > 0
    return asked.join(have, "device_serial", "left").select(
        *SESSION, "requested", "available",
        F.when(known, F.array_except("requested", "available")).alias("missing"),
    )


def assess_integrity(
    sessions: DataFrame,
    counters: DataFrame,
    gap_totals: DataFrame,
    crash_totals: DataFrame,
    buffers: DataFrame,
    *,
    dropped: DataFrame | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Six rows per session, also for a session that received nothing."""
    keys = list(SESSION)
    wide = sessions.select(*SESSION)
    for part in (counters, gap_totals, crash_totals, buffers, dropped):
        if part is not None:
            wide = wide.join(part, keys, "left")
    if dropped is None:
        wide = wide.withColumn("total_dropped", F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    for name in ("records", "unparsed", "largest_gap_ms", "n_long_gaps", "crashes", "stackless",
                 "total_dropped"):
        wide = wide.withColumn(name, F.coalesce(name, zero))
    records, lost = F.col("records"), F.col("total_dropped")
    share = F.when(records > 0, F.col("unparsed") / records).otherwise(F.lit(0.0))
    gap = F.col("largest_gap_ms")
    missing = F.col("missing")

    def status(warning: Column, notice: Column) -> Column:
        return F.when(warning, "warning").when(notice, "notice").otherwise("ok")

    def share_of(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    never = F.lit(False)
    checks = [
        ("records", status(never, records == 0), records.cast("double"),
         F.concat(records.cast("string"), F.lit(" lines received"))),
        ("dropped", status(lost > 0, never), share_of(lost, records + lost),
         F.concat(lost.cast("string"), F.lit(" lines dropped from the buffer"))),
        ("unparsed", status(share >= limits.unparsed_warning, share >= limits.unparsed_notice),
         share, F.concat(F.col("unparsed").cast("string"), F.lit(" lines kept as raw text"))),
        ("buffers", status(F.coalesce(F.size(missing) > 0, never), missing.isNull()),
         F.size(missing).cast("double"),
         F.when(missing.isNull(), "the device reported no buffers")
         .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
         .otherwise(F.concat(F.lit("present: "), F.array_join("requested", ", ")))),
        ("gaps", status(gap >= limits.gap_warning_ms, gap >= limits.gap_notice_ms),
         gap.cast("double"),
         F.concat(F.lit("longest gap "), gap.cast("string"), F.lit(" ms, "),
                  F.col("n_long_gaps").cast("string"), F.lit(" long ones"))),
        ("stacks", status(F.col("stackless") > 0, never), F.col("stackless").cast("double"),
         F.concat(F.col("stackless").cast("string"), F.lit(" of "),
                  F.col("crashes").cast("string"), F.lit(" crashes without a stack"))),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("check_no"), F.lit(name).alias("id"), state.alias("status"),
                value.alias("value"), detail.alias("detail"),
            )
            for i, (name, state, value, detail) in enumerate(checks)
        ]
    )
    rank = F.when(F.col("status") == "warning", CHECK_RANK["warning"]).when(
        F.col("status") == "notice", CHECK_RANK["notice"]
    ).otherwise(CHECK_RANK["ok"])
    return wide.select(*SESSION, F.inline(rows)).withColumn("status_rank", rank)


def worst_first(checks: DataFrame) -> DataFrame:
    """Warnings before notices before ok, otherwise in the order of the checks."""
    return checks.orderBy(*SESSION, F.desc("status_rank"), "check_no")


def mixed_dates(records: DataFrame) -> DataFrame:
    """Sessions whose stamps carry more than one ``MM-DD`` date, with the count of each.

    Stamps with a year are not counted.
    """
    date = F.substring("timestamp", 1, 5)
    per_date = (
        records.where(F.substring("timestamp", 3, 1) == "-")
        .groupBy(*SESSION, date.alias("date"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    many = per_date.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("n_dates"), F.sum("n").alias("n_total")
    ).where(F.col("n_dates") >= 2)
    return per_date.join(many, list(SESSION))
