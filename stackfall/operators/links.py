"""Causal links: which process a crash took down.

A victim is linked to the latest earlier crash source of another process inside the line and
time windows. This is an as-of lookup, so no pair of signals is ever formed: along the session
run the latest source and the latest source of a *different* process than that one, and one of
the two is the answer for every victim.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import ams_label, is_crash_reason, is_source, is_victim
from ..schema import DAY_MS, SESSION
from . import chunks as H

#: A step back of more than this is a new day, a smaller one is clock jitter.
ROLLOVER_SLACK_MS = 60_000
CONFIRMED_GAP_MS = 2_000


def with_context(signals: DataFrame, *, chunk_rows: int = H.CHUNK_ROWS) -> DataFrame:
    """Adds per signal: ``pos`` (ordinal), ``role``, ``name``/``name_pid`` (own, else the process
    last named before it) and ``at_ms`` (milliseconds since the first day, midnights counted)."""
    source = is_source(F.col("kind")) & ~F.coalesce(~F.col("crashing"), F.lit(False))
    named = F.when(
        ~source & F.col("process").isNotNull(),
        F.struct(F.col("process").alias("process"), F.col("pid").alias("pid")),
    )
    here, before = H.in_chunk(), H.in_chunk_before()
    local = (
        H.with_chunk(signals, chunk_rows)
        .withColumn("_source", source)
        .withColumn("_named", named)
        .withColumn("_row", F.count(F.lit(1)).over(here))
        .withColumn("_context", F.last("_named", ignorenulls=True).over(before))
        .withColumn("_prev", F.last("ms", ignorenulls=True).over(before))
        .withColumn(
            "_roll",
            F.when(F.col("ms") + ROLLOVER_SLACK_MS < F.col("_prev"), 1).otherwise(0),
        )
        .withColumn("_rolls", F.sum("_roll").over(here))
    )
    tails = local.groupBy(*SESSION, H.CHUNK).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_roll").alias("_nr"),
        H.oldest("ms").alias("_first_ms"),
        H.newest("ms").alias("_last_ms"),
        H.newest("_named").alias("_last_named"),
    )
    over = H.earlier_chunks()
    zero = F.lit(0).cast("bigint")
    carry = (
        tails.withColumn("_prev_ms", F.last("_last_ms", ignorenulls=True).over(over))
        .withColumn(
            "_edge",
            F.when(F.col("_first_ms") + ROLLOVER_SLACK_MS < F.col("_prev_ms"), 1).otherwise(0),
        )
        .select(
            *SESSION, H.CHUNK, "_edge",
            F.coalesce(F.sum("_n").over(over), zero).alias("_rows"),
            F.coalesce(F.sum(F.col("_nr") + F.col("_edge")).over(over), zero).alias("_days"),
            F.last("_last_named", ignorenulls=True).over(over).alias("_carried"),
        )
    )
    context = F.coalesce(F.col("_context"), F.col("_carried"))
    day = F.col("_days") + F.col("_edge") + F.col("_rolls")
    return H.join_carry(local, carry).select(
        *signals.columns,
        (F.col("_row") + F.col("_rows") - 1).alias("pos"),
        F.when(F.col("_source"), "source").when(is_victim(F.col("kind")), "victim").alias("role"),
        F.when(F.col("_source"), F.coalesce(F.col("process"), context.getField("process")))
        .otherwise(F.col("process")).alias("name"),
        F.when(F.col("_source"), F.coalesce(F.col("pid"), context.getField("pid")))
        .otherwise(F.col("pid")).alias("name_pid"),
        (F.col("ms") + day * DAY_MS).alias("at_ms"),
    )


_TRACKS = ("timed", "untimed")


def _latest_sources(context: DataFrame, chunk_rows: int) -> DataFrame:
    """Adds ``timed``/``untimed`` (latest source), ``*_other`` (latest source of another process
    than that one) and ``reached_ms`` (time of the last named victim so far)."""
    here, before = H.in_chunk(), H.in_chunk_before()
    source = (F.col("role") == "source") & F.col("name").isNotNull()
    is_timed = F.col("at_ms").isNotNull()
    item = F.struct(
        F.col("name").alias("name"), F.col("name_pid").alias("pid"), F.col("pos").alias("pos"),
        F.col("line_index").alias("line_index"), F.col("seq").alias("seq"),
        F.col("at_ms").alias("at_ms"), F.col("detail").alias("detail"),
    )
    gone = (F.col("role") == "victim") & F.col("name").isNotNull()
    local = H.with_chunk(context, chunk_rows).withColumns(
        {
            "_s_timed": F.when(source & is_timed, item),
            "_s_untimed": F.when(source & ~is_timed, item),
            "_gone": F.when(gone, F.col("at_ms")),
        }
    )
    for t in _TRACKS:
        local = local.withColumn(f"_p_{t}", F.last(f"_s_{t}", ignorenulls=True).over(before))

    def turned(t: str, previous: Column) -> Column:
        """The source before a change of process."""
        return F.when(F.col(f"_s_{t}.name") != previous.getField("name"), previous)

    over = H.earlier_chunks()
    tails = local.withColumns({f"_m_{t}": turned(t, F.col(f"_p_{t}")) for t in _TRACKS}).groupBy(
        *SESSION, H.CHUNK
    ).agg(
        *[H.newest(f"_s_{t}").alias(f"_s_{t}") for t in _TRACKS],
        *[H.newest(f"_m_{t}").alias(f"_m_{t}") for t in _TRACKS],
        H.newest("_gone").alias("_gone"),
    )
    for t in _TRACKS:
        tails = tails.withColumn(f"_i_{t}", F.last(f"_s_{t}", ignorenulls=True).over(over))
        tails = tails.withColumn(
            f"_m_{t}", F.coalesce(F.col(f"_m_{t}"), turned(t, F.col(f"_i_{t}")))
        )
    carry = tails.select(
        *SESSION, H.CHUNK,
        *[F.col(f"_i_{t}") for t in _TRACKS],
        *[F.last(f"_m_{t}", ignorenulls=True).over(over).alias(f"_o_{t}") for t in _TRACKS],
        F.last("_gone", ignorenulls=True).over(over).alias("_gone_before"),
    )
    out = H.join_carry(local, carry)
    for t in _TRACKS:
        out = out.withColumn(f"_q_{t}", F.coalesce(F.col(f"_p_{t}"), F.col(f"_i_{t}")))
        out = out.withColumn(f"_m_{t}", turned(t, F.col(f"_q_{t}")))
    return out.select(
        *context.columns,
        *[F.col(f"_q_{t}").alias(t) for t in _TRACKS],
        *[
            F.coalesce(F.last(f"_m_{t}", ignorenulls=True).over(here), F.col(f"_o_{t}"))
            .alias(f"{t}_other")
            for t in _TRACKS
        ],
        F.coalesce(F.last("_gone", ignorenulls=True).over(here), F.col("_gone_before"))
        .alias("reached_ms"),
    )


def victim_links(
    signals: DataFrame,
    *,
    max_lines: int = 60,
    max_gap_ms: int = 5_000,
    line_window: str = "lines",
    chunk_rows: int = H.CHUNK_ROWS,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DataFrame:
    """One row per linked victim signal, before repeats are merged.

    ``keep`` may write a frame that is read several times as a table and go on from there
    (:func:`stackfall.session.cut`).

    ``line_window="lines"`` compares the victim's signal ordinal with the source's line index
    (saturating at 0); ``"signals"`` compares both as signal ordinals.
    """
    if line_window not in ("lines", "signals"):
        raise ValueError(f"unknown line_window: {line_window}")
    context = keep(
        with_context(signals, chunk_rows=chunk_rows)
        .where(F.col("role").isNotNull() & F.col("name").isNotNull())
        .select(
            *SESSION, "seq", "line_index", "kind", "reason", "detail", "pid", "pos", "role", "name",
            "name_pid", "at_ms",
        ),
        "context",
    )
    rows = _latest_sources(context, chunk_rows).where(
        (F.col("role") == "victim") & F.col("name").isNotNull()
    )
    # a process that crashed earlier is never a victim later
    crashed = (
        context.where((F.col("role") == "source") & F.col("name").isNotNull())
        .groupBy(*SESSION, "name")
        .agg(F.min("pos").alias("_crashed_at"))
    )
    rows = rows.join(crashed, [*SESSION, "name"], "left").where(
        F.col("_crashed_at").isNull() | (F.col("_crashed_at") > F.col("pos"))
    )

    def other(t: str) -> Column:
        return F.when(F.col(f"{t}.name") != F.col("name"), F.col(t)).otherwise(F.col(f"{t}_other"))

    place = "line_index" if line_window == "lines" else "pos"
    now = F.coalesce(F.col("at_ms"), F.col("reached_ms"))

    def alive(t: str) -> Column:
        item = F.col(f"_{t}")
        near = F.greatest(F.col("pos") - item.getField(place), F.lit(0)) <= max_lines
        if t == "untimed":
            return item.isNotNull() & near
        gap = now - item.getField("at_ms")
        own = F.col("at_ms").isNull() | (F.abs(gap) <= max_gap_ms)
        return item.isNotNull() & near & own & F.coalesce(gap <= max_gap_ms, F.lit(True))

    rows = rows.withColumns({f"_{t}": other(t) for t in _TRACKS})
    rows = rows.withColumns({f"_{t}": F.when(alive(t), F.col(f"_{t}")) for t in _TRACKS})
    timed_first = F.col("_untimed").isNull() | (F.col("_timed.pos") > F.col("_untimed.pos"))
    rows = rows.withColumn(
        "_s", F.when(F.col("_timed").isNotNull() & timed_first, F.col("_timed")).otherwise(F.col("_untimed"))
    ).where(F.col("_s").isNotNull())
    gap = F.col("at_ms") - F.col("_s.at_ms")
    confirmed = is_crash_reason(F.col("reason")) & F.coalesce(
        F.abs(gap) <= CONFIRMED_GAP_MS, F.lit(False)
    )
    return rows.select(
        *SESSION, "pos", "seq",
        F.col("_s.name").alias("source"), F.col("_s.pid").alias("source_pid"),
        F.col("name").alias("victim"), F.col("pid").alias("victim_pid"),
        F.col("kind").alias("victim_kind"),
        gap.alias("gap_ms"),
        F.col("_s.detail").alias("source_detail"),
        F.col("_s.line_index").alias("source_line"), F.col("line_index").alias("victim_line"),
        F.col("_s.seq").alias("source_seq"),
        confirmed.alias("confirmed"),
    )


def link_reason(row_or_prefix: str = "") -> Column:
    """English sentence for a link: after, before, or without a known time."""
    p = row_or_prefix
    src, vic, gap = F.col(p + "source"), F.col(p + "victim"), F.col(p + "gap_ms")
    did = ams_label(F.col(p + "victim_kind"))
    note = F.coalesce(
        F.concat(F.lit(" ("), F.col(p + "source_detail"), F.lit(")")), F.lit("")
    )
    return (
        F.when(
            gap >= 0,
            F.concat(src, F.lit(" crashed"), note, F.lit("; "), gap.cast("string"),
                     F.lit(" ms later "), vic, F.lit(" was "), did),
        )
        .when(
            gap < 0,
            F.concat(vic, F.lit(" was "), did, F.lit(" "), (-gap).cast("string"),
                     F.lit(" ms before "), src, F.lit(" crashed")),
        )
        .otherwise(
            F.concat(src, F.lit(" crashed"), note, F.lit("; "), vic, F.lit(" was "), did)
        )
    )


def merge_links(found: DataFrame) -> DataFrame:
    """One link per (source, victim): the first names the pids, the last confirmed one (else the
    first) gives reason and evidence. All partial aggregates."""
    confirmed_at = F.when(F.col("confirmed"), F.col("pos"))
    proof = F.struct("gap_ms", "source_detail", "source_line", "victim_line", "source_seq",
                     F.col("seq").alias("victim_seq"), "victim_kind")
    merged = found.groupBy(*SESSION, "source", "victim").agg(
        F.min_by(F.struct("source_pid", "victim_pid"), "pos").alias("_pids"),
        F.max_by(proof, confirmed_at).alias("_sure"),
        F.min_by(proof, "pos").alias("_first"),
        F.bool_or("confirmed").alias("_confirmed"),
    )
    out = merged.select(
        *SESSION, "source", F.col("_pids.source_pid").alias("source_pid"),
        "victim", F.col("_pids.victim_pid").alias("victim_pid"),
        F.coalesce("_sure", "_first").alias("_p"),
        F.when(F.col("_confirmed"), "confirmed").otherwise("likely").alias("confidence"),
    ).select("*", "_p.*")
    return out.select(
        *SESSION, "source", "source_pid", "victim", "victim_pid",
        link_reason().alias("reason"),
        F.array("source_line", "victim_line").alias("evidence"),
        "confidence", "gap_ms", "source_line", "victim_line", "source_seq", "victim_seq",
    )


def link_deaths(signals: DataFrame, **options) -> DataFrame:
    """Causal links of every session; see :func:`victim_links` for the options."""
    return merge_links(victim_links(signals, **options))


def evidence_rows(links: DataFrame, records: DataFrame) -> DataFrame:
    """The log rows a link points at, in the order of its evidence."""
    wanted = links.select(
        *SESSION, F.col("source").alias("link_source"), F.col("victim").alias("link_victim"),
        F.posexplode(F.array("source_seq", "victim_seq")).alias("evidence_no", "seq"),
    )
    return wanted.join(records, [*SESSION, "seq"])
