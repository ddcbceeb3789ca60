"""Composite jobs: the questions a user asks in one call."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import rules as FR
from ..functions.records import device_time
from ..operators import blocks as B
from ..operators import chunks as H
from ..operators import identity as I
from ..operators import integrity as Q
from ..operators import known as N
from ..operators import links as L
from ..operators import reports as R
from ..operators import signals as G
from ..operators import stories as T
from ..operators import views as V
from ..schema import SESSION
from ..session import cut as cut_table
from ..sources import artifacts as A
from ..sources.lines import parse_records


@dataclass(frozen=True)
class Forensics:
    """Everything known about a set of captures, as frames keyed by session."""

    signals: DataFrame
    links: DataFrame
    anomalies: DataFrame
    events: DataFrame
    stories: DataFrame
    story_events: DataFrame
    episodes: DataFrame
    victims: DataFrame
    correlation_counts: DataFrame
    story_anomalies: DataFrame
    unattached: DataFrame
    checks: DataFrame
    notes: DataFrame
    summary: DataFrame

    def register(self, spark: SparkSession, prefix: str = "") -> None:
        """Temp views of every frame, so plain SQL works over the result."""
        names = {f.name: prefix + f.name for f in fields(self)}
        V.register_views(spark, **{names[n]: getattr(self, n) for n in names})


def gate(records: DataFrame) -> DataFrame:
    """The rows any analyser can use, signals and anomalies already parsed: one pass over the
    log, no shuffle. Usually a few per cent of it."""
    return G.parsed_rows(
        records, *SESSION, "seq", "tag", "message", "package", "pid", raw="raw",
        also=C.is_interesting_tag(F.col("tag")),
    )


def analyse(
    records: DataFrame,
    sessions: DataFrame,
    *,
    profiles: DataFrame | None = None,
    artifacts: DataFrame | None = None,
    year: int | None = None,
    limits: Q.Limits = Q.Limits(),
    max_lines: int = 60,
    max_gap_ms: int = 5_000,
    line_window: str = "lines",
    chunk_rows: int = H.CHUNK_ROWS,
    ranks: DataFrame | None = None,
    cut: bool = True,
) -> Forensics:
    """Crashes, causal links, stories, resource pressure and integrity of every session.

    ``records`` should be a stored table (see ``write_records``): it is read column-pruned for
    the gate, the counters and the gaps, and for the ordinals unless their structure is stored too
    (``ranks``, see ``write_ranks``). With ``cut`` the gated rows and the small
    event and link tables are written once in the shared folder, so nothing is parsed twice.
    """
    keep = cut_table if cut else (lambda df, name: df)
    if "device_ts" not in records.columns:
        records = records.withColumn(
            "device_ts", device_time(F.col("timestamp"), F.lit(1970 if year is None else year))
        )
    gated = keep(gate(records), "gated")
    found = H.place_in(
        gated.where(F.col("ams").isNotNull() | F.col("anomaly").isNotNull()),
        H.line_ranks(records) if ranks is None else ranks,
    )
    found = keep(found, "evidence")
    signals, anomalies = keep(G.signals_of(found), "signals"), G.anomalies_of(found)
    links = keep(
        L.link_deaths(
            signals, max_lines=max_lines, max_gap_ms=max_gap_ms, line_window=line_window,
            chunk_rows=chunk_rows, keep=keep,
        ),
        "links",
    )
    events = B.live_crash_events(B.live_blocks(gated, chunk_rows=chunk_rows))
    if artifacts is not None:
        events = V.all_crash_events(events, A.artifact_events(artifacts))
    events = keep(events, "events")
    story = T.correlate(events, signals, links)
    attached = T.attach_anomalies(anomalies, story.stories, story.episodes)
    buffers = (
        Q.missing_buffers(sessions, profiles)
        if profiles is not None
        else sessions.select(
            *SESSION,
            C.requested_buffers(F.col("command")).alias("requested"),
            F.lit(None).cast("array<string>").alias("available"),
            F.lit(None).cast("array<string>").alias("missing"),
        )
    )
    checks = Q.assess_integrity(
        sessions,
        Q.capture_counters(records),
        Q.gap_summary(Q.gaps(records, chunk_rows=chunk_rows), limits),
        Q.stackless_crashes(events),
        buffers,
        limits=limits,
    )
    checks = keep(checks, "checks")
    return Forensics(
        signals=signals, links=links, anomalies=anomalies, events=events,
        stories=story.stories, story_events=story.story_events, episodes=story.episodes,
        victims=story.victims, correlation_counts=story.counts,
        story_anomalies=attached.by_story, unattached=attached.unattached,
        checks=checks, notes=N.known_notes(events),
        summary=summarise(sessions, story.stories, links, anomalies, checks),
    )


def summarise(
    sessions: DataFrame,
    stories: DataFrame,
    links: DataFrame,
    anomalies: DataFrame,
    checks: DataFrame,
) -> DataFrame:
    """Headline numbers per session."""
    keys = list(SESSION)

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    told = stories.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("processes"), F.sum("n_crashes").alias("crashes")
    )
    out = sessions.select(*keys)
    for part in (
        told, count(links, "links"), count(anomalies, "anomalies"),
        count(checks.where(F.col("status") == "warning"), "warnings"),
    ):
        out = out.join(part, keys, "left")
    names = ("processes", "crashes", "links", "anomalies", "warnings")
    zero = F.lit(0).cast("bigint")
    return out.select(*keys, *[F.coalesce(n, zero).alias(n) for n in names])


# --- scenes ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Scene:
    events: DataFrame
    records: DataFrame
    outcomes: DataFrame
    report: DataFrame


def crash_scene(
    reads: DataFrame,
    *,
    package: str | None = None,
    typed: str = "",
    newest: int | None = None,
    max_lines: int | None = None,
) -> Scene:
    """Events, log rows and the report of a collection.

    ``reads``: session keys, dir, name, ordinal, text, error_text, exit_code. Of every directory
    the newest ``newest`` files are followed. Blank and binary lines are left out of the rows;
    with a followed application only lines that name it stay. ``max_lines`` keeps the newest lines
    of each text only.
    """
    status = C.read_status(F.col("text"), F.col("error_text"), F.col("exit_code"))
    read = reads.withColumn("status", status)
    if newest is not None:
        read = A.newest_files(read, newest)
    found = read.where(F.col("status") == "found")
    events = A.artifact_events(found)
    lines = A.artifact_lines(found)
    if max_lines is not None:
        lines = V.tail_lines(lines, max_lines, keys=A.ARTIFACT_KEY, order="seq").drop("trimmed")
    kept = lines.where((F.trim("line") != "") & ~C.is_binary_line(F.col("line")))
    if package or typed.strip():
        kept = kept.where(V.mentions_target(F.col("line"), package, typed))
    records = parse_records(
        kept.withColumns(
            {"source": F.lit("crash"), "received_at_ms": F.lit(None).cast("bigint")}
        )
    )
    counted = records.groupBy(*A.ARTIFACT_KEY).agg(F.count(F.lit(1)).alias("records"))
    outcomes = (
        read.drop("text")
        .join(counted, list(A.ARTIFACT_KEY), "left")
        .withColumn("records", F.coalesce("records", F.lit(0).cast("bigint")))
        .withColumn("hint", C.read_remedy(F.col("status")))
    )
    return Scene(events, records, outcomes, R.collection_report(outcomes))


def boot_log(
    polls: DataFrame, states: DataFrame, *, window_ms: int = 120_000, seed_only: bool = True
) -> DataFrame:
    """Kernel lines that appeared while a device booted, parsed.

    ``states``: device_serial, boot_id, poll_no, polled_at_ms, booted. ``polls``: device_serial,
    poll_no, line_no, line. Each poll only adds the lines the poll before did not show; a seed
    poll adds none.
    """
    wanted = I.boot_window(states, window_ms=window_ms, seed_only=seed_only)
    inside = polls.join(
        wanted.select("device_serial", "boot_id", "poll_no", "seed"), ["device_serial", "poll_no"]
    )
    fresh = V.incremental_lines(inside).where(~F.col("seed") & (F.trim("line") != ""))
    lines = fresh.select(
        "device_serial",
        F.col("boot_id").cast("string").alias("session_id"),
        (F.col("poll_no") * F.lit(1 << 32) + F.col("line_no")).alias("seq"),
        F.lit("boot").alias("source"),
        F.lit(None).cast("bigint").alias("received_at_ms"),
        "line",
    )
    return parse_records(lines)


def follow_app(
    records: DataFrame, inputs: DataFrame, ps: DataFrame, uids: DataFrame
) -> DataFrame:
    """Records of the applications a user asked for by pid, uid or package."""
    return I.follow(records, I.resolve_targets(inputs, ps, uids))


@dataclass(frozen=True)
class Timeline:
    events: DataFrame
    groups: DataFrame
    tabs: DataFrame


def timeline(updates: DataFrame, *, version: str | Column = "version") -> Timeline:
    """Settled crash events in capture order, repeats grouped, and the count of each tab."""
    settled = V.settle(updates, version=version)
    groups = V.group_crashes(settled)
    origin = settled.select(*SESSION, F.col("event_id").alias("first_event"), "origin")
    tabs = groups.join(origin, [*SESSION, "first_event"]).groupBy(*SESSION, "origin").agg(
        F.count(F.lit(1)).alias("n")
    )
    return Timeline(V.timeline(settled), groups, tabs)


def filtered(records: DataFrame, rules, *, as_of_ms=None) -> DataFrame:
    """Records that pass every enabled rule."""
    return records.where(FR.compile_rules(rules, as_of_ms=as_of_ms))
