"""Views over records and events: tails, timelines, groupings, unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.steps import pinned
from ..schema import CRASH_EVENT_COLUMNS, SESSION
from .chunks import CHUNK_ROWS


def with_crash_kind(records: DataFrame) -> DataFrame:
    """Adds ``kind``: the crash family of every row worth scanning, else NULL."""
    text = C.record_text(F.col("tag"), F.col("message"), F.col("raw"), F.col("parsed"))
    lower = F.when(C.is_scannable(F.col("level")), F.lower(text))
    masked = pinned(pinned(records, "_text", lower), "_mask", C.family_mask_lower(F.col("_text")))
    return pinned(masked, "kind", C.family_of_mask(F.col("_mask"))).drop("_text", "_mask")


def crash_rows(records: DataFrame) -> DataFrame:
    """(session, seq, kind) of the classified rows, for a stored classification."""
    return (
        with_crash_kind(records)
        .where(F.col("kind").isNotNull())
        .select(*SESSION, "seq", "kind")
    )


def join_crash_kind(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Family of a row by ``seq`` from a stored classification; the first entry counts."""
    order = "entry_no" if "entry_no" in stored.columns else "kind"
    first = stored.groupBy(*SESSION, "seq").agg(F.min_by("kind", order).alias("kind"))
    return records.join(first, [*SESSION, "seq"], "left")


def crash_only(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Records that have a stored crash classification."""
    return records.join(stored.select(*SESSION, "seq"), [*SESSION, "seq"], "left_semi")


def by_origin(events: DataFrame, origin: str) -> DataFrame:
    """One tab of the timeline; ``all`` keeps everything."""
    return events if origin == "all" else events.where(F.col("origin") == origin)


def tail(
    records: DataFrame,
    n: int,
    *,
    keys: Sequence[str] = SESSION,
    order: str = "seq",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Newest ``n`` rows per key (``order`` is unique within the key).

    Counts per chunk of ``order`` say which chunks can hold them; only rows of those chunks are
    shuffled, and only the oldest of them is cut by rank. A giant session never meets one task.
    """
    n = max(int(n), 1)
    chunk = F.expr(f"`{order}` div {int(chunk_rows)}")
    counts = records.groupBy(*keys, chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_n"))
    newer = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("_chunk"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("bigint")
    held = counts.select(
        *keys, "_chunk", (n - F.coalesce(F.sum("_n").over(newer), zero)).alias("_need")
    ).where(F.col("_need") > 0)
    ranked = Window.partitionBy(*keys, "_chunk").orderBy(F.desc(order))
    return (
        records.withColumn("_chunk", chunk)
        .join(held, [*keys, "_chunk"])
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= F.col("_need"))
        .select(*records.columns)
    )


def tail_lines(
    lines: DataFrame, n: int, *, keys: Sequence[str], order: str = "line_no"
) -> DataFrame:
    """Newest ``n`` lines of each text, with ``trimmed`` telling whether any were left out."""
    totals = lines.groupBy(*keys).agg(F.max(order).alias("_end"), F.count(F.lit(1)).alias("_n"))
    return (
        lines.join(totals, list(keys))
        .where(F.col(order) > F.col("_end") - n)
        .withColumn("trimmed", F.col("_n") > n)
        .drop("_end", "_n")
    )


def cap_events(
    events: DataFrame,
    n: int,
    *,
    newest: bool = True,
    order: str = "start_seq",
) -> DataFrame:
    """Newest (or first) ``n`` events per session."""
    by = [F.desc(order), F.desc("event_id")] if newest else [F.asc(order), F.asc("event_id")]
    ranked = Window.partitionBy(*SESSION).orderBy(*by)
    return (
        events.withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= n)
        .drop("_rank")
    )


def keep_boot_sets(files: DataFrame, n: int = 3, *, keys: Sequence[str] = ("device_serial",)) -> DataFrame:
    """Files of the newest ``n`` boots; all files of one stamp stay together.

    Only names the boot recorder writes are considered; the stamps are ranked, not the files.
    """
    name = F.col("name")
    mine = files.where(name.rlike(r"^[0-9]{8}-[0-9]{6}\.") | name.startswith("bootup-"))
    stamped = mine.withColumn("stamp", F.substring_index("name", ".", 1))
    stamps = stamped.select(*keys, "stamp").distinct()
    ranked = stamps.withColumn(
        "boot_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("stamp")))
    ).where(F.col("boot_rank") <= n)
    return stamped.join(ranked, [*keys, "stamp"])


def group_crashes(events: DataFrame) -> DataFrame:
    """Repeats of one crash (same exception, same stack) as one row with their count.

    The stack is compared through its 128-bit hash, so no stack text is shuffled.
    """
    return events.groupBy(
        *SESSION, F.coalesce("exception", F.lit("")).alias("exception"), "n_frames", "stack_hash"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("event_id", F.struct("start_seq", "event_id")).alias("first_event"),
        F.min("start_seq").alias("first_seq"),
    )


def count_by_origin(events: DataFrame) -> DataFrame:
    return events.groupBy(*SESSION, "origin").agg(F.count(F.lit(1)).alias("n"))


def count_by_kind(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*(keys or SESSION), "kind").agg(F.count(F.lit(1)).alias("n"))


def fleet_crashes(events: DataFrame) -> DataFrame:
    """Crash totals of a fleet: per device and family with all subtotals."""
    return events.cube("device_serial", "kind").agg(F.count(F.lit(1)).alias("n"))


def timeline(events: DataFrame) -> DataFrame:
    """Events in capture order."""
    return events.orderBy(*SESSION, "start_seq", "event_id")


def all_crash_events(buffer_events: DataFrame, artifact_events: DataFrame) -> DataFrame:
    """One stream out of crash buffer and artifacts; artifact ids carry ``probe:``."""
    probed = artifact_events.withColumn("event_id", F.concat(F.lit("probe:"), F.col("event_id")))
    return buffer_events.select(*CRASH_EVENT_COLUMNS).unionByName(
        probed.select(*CRASH_EVENT_COLUMNS)
    )


def settle(updates: DataFrame, *, version: str | Column = "version") -> DataFrame:
    """Newest state of every event id: a repeated id replaces, it never appends."""
    order = F.col(version) if isinstance(version, str) else version
    rest = [c for c in updates.columns if c not in (*SESSION, "event_id")]
    return updates.groupBy(*SESSION, "event_id").agg(
        F.max_by(F.struct(*rest), order).alias("_newest")
    ).select(*SESSION, "event_id", "_newest.*")


def mentions_target(line: Column, package: str | None, typed: str) -> Column:
    """An artifact line that names the followed application in its text."""
    hit = F.lit(False)
    if package:
        hit = hit | F.contains(line, F.lit(package))
    if len(typed.strip()) >= 3:
        hit = hit | F.contains(line, F.lit(typed.strip()))
    return hit


def incremental_lines(polls: DataFrame, *, keep: int | None = None) -> DataFrame:
    """Lines of a poll that the poll before (its newest ``keep`` lines, if given) did not have.

    ``polls`` has ``device_serial``, ``poll_no``, ``line_no``, ``line``. The comparison is with a
    *set* of lines: a repeat inside one poll stays, a repeat of the last poll goes. Equality is
    on the text, with its hash as the join key.
    """
    held = polls
    if keep is not None:
        ends = polls.groupBy("device_serial", "poll_no").agg(F.max("line_no").alias("_end"))
        held = polls.join(ends, ["device_serial", "poll_no"]).where(
            F.col("line_no") > F.col("_end") - keep
        )
    seen = held.select(
        "device_serial", (F.col("poll_no") + 1).alias("poll_no"),
        F.xxhash64("line").alias("_hash"), "line",
    ).distinct()
    return (
        polls.withColumn("_hash", F.xxhash64("line"))
        .join(seen, ["device_serial", "poll_no", "_hash", "line"], "left_anti")
        .drop("_hash")
    )


def register_views(spark, **frames: DataFrame) -> None:
    """Temp views for plain SQL over the analysed frames."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
