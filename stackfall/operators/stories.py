"""Crash stories: one per application identity, over all its processes and restarts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SESSION


@dataclass(frozen=True)
class Correlation:
    """Lazy frames of one correlation; nothing is nested so nothing grows within a row."""

    stories: DataFrame
    story_events: DataFrame
    episodes: DataFrame
    victims: DataFrame
    counts: DataFrame


def _pids(signals: DataFrame) -> DataFrame:
    """Per pid: the process last named for it, its line range, uid and whether it started."""
    named = signals.where(F.col("process").isNotNull() & F.col("pid").isNotNull())
    return named.groupBy(*SESSION, "pid").agg(
        F.max_by("process", "line_index").alias("pid_process"),
        F.max_by("uid", F.when(F.col("uid").isNotNull(), F.col("line_index"))).alias("pid_uid"),
        F.min("line_index").alias("pid_first"),
        F.max("line_index").alias("pid_last"),
        F.bool_or(F.col("kind").isin("amProcStart", "processRecord")).alias("pid_started"),
    )


def _names(signals: DataFrame) -> DataFrame:
    return (
        signals.where(F.col("process").isNotNull())
        .groupBy(*SESSION, F.col("process").alias("identity"))
        .agg(
            F.min("line_index").alias("name_first"),
            F.max_by("uid", F.when(F.col("uid").isNotNull(), F.col("line_index"))).alias("name_uid"),
        )
    )


def identify(events: DataFrame, signals: DataFrame) -> DataFrame:
    """Adds ``identity`` (own process, else the process of the pid), ``pid_uid`` and
    ``position`` (first line of its pid, else of its identity)."""
    pids = _pids(signals).select(*SESSION, "pid", "pid_process", "pid_uid", "pid_first")
    named = events.join(pids, [*SESSION, "pid"], "left").withColumn(
        "identity", F.coalesce("process", "pid_process")
    )
    names = _names(signals).select(*SESSION, "identity", "name_first")
    return (
        named.join(names, [*SESSION, "identity"], "left")
        .withColumn("position", F.coalesce("pid_first", "name_first"))
        .drop("pid_process", "pid_first", "name_first")
    )


def correlate(events: DataFrame, signals: DataFrame, links: DataFrame) -> Correlation:
    """Stories out of crash events, signals and links. Every step is a keyed aggregate or an
    N:1 join; one identity holding most rows is pre-aggregated on the map side."""
    known = identify(events, signals)
    story_events = known.where(F.col("identity").isNotNull())
    crashes = story_events.groupBy(*SESSION, "identity").agg(
        F.count(F.lit(1)).alias("n_crashes"),
        F.min("position").alias("_first"),
        F.max("position").alias("_last"),
        F.min_by("pid_uid", F.when(F.col("pid_uid").isNotNull(), F.struct("start_seq", "event_id")))
        .alias("_pid_uid"),
    )
    owners = crashes.select(*SESSION, "identity")
    episodes = (
        _pids(signals)
        .withColumnRenamed("pid_process", "identity")
        .join(owners, [*SESSION, "identity"], "left_semi")
        .select(
            *SESSION, "identity", "pid", F.col("pid_first").alias("first_line"),
            F.col("pid_last").alias("last_line"), F.col("pid_started").alias("started"),
        )
    )
    spans = episodes.groupBy(*SESSION, "identity").agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.min("first_line").alias("_e_first"),
        F.max("last_line").alias("_e_last"),
    )
    victims = links.withColumnRenamed("source", "identity").join(
        owners, [*SESSION, "identity"], "left_semi"
    )
    taken = victims.groupBy(*SESSION, "identity").agg(
        F.count(F.lit(1)).alias("n_victims"),
        F.min("source_line").alias("_v_first"),
        F.max("victim_line").alias("_v_last"),
    )
    zero = F.lit(0).cast("bigint")
    stories = (
        crashes.join(spans, [*SESSION, "identity"], "left")
        .join(taken, [*SESSION, "identity"], "left")
        .join(_names(signals), [*SESSION, "identity"], "left")
        .select(
            *SESSION, "identity",
            F.coalesce("name_uid", "_pid_uid").alias("uid"),
            "n_crashes",
            F.coalesce("n_episodes", zero).alias("n_episodes"),
            F.greatest(F.coalesce("n_episodes", zero) - 1, zero).alias("restarts"),
            F.coalesce("n_victims", zero).alias("n_victims"),
            F.least("_first", "_e_first", "_v_first").alias("first_line"),
            F.greatest("_last", "_e_last", "_v_last").alias("last_line"),
        )
    )
    return Correlation(stories, story_events, episodes, victims, _counts(known, links, owners))


def _counts(known: DataFrame, links: DataFrame, owners: DataFrame) -> DataFrame:
    """Events and links without a story, per session."""
    events = known.groupBy(*SESSION).agg(F.count_if(F.col("identity").isNull()).alias("unlinked_events"))
    lost = (
        links.join(
            owners.withColumnRenamed("identity", "source"), [*SESSION, "source"], "left_anti"
        )
        .groupBy(*SESSION)
        .agg(F.count(F.lit(1)).alias("unlinked_links"))
    )
    zero = F.lit(0).cast("bigint")
    return events.join(lost, list(SESSION), "full").select(
        *SESSION,
        F.coalesce("unlinked_events", zero).alias("unlinked_events"),
        F.coalesce("unlinked_links", zero).alias("unlinked_links"),
    )


@dataclass(frozen=True)
class Attachment:
    by_story: DataFrame
    unattached: DataFrame


def attach_anomalies(anomalies: DataFrame, stories: DataFrame, episodes: DataFrame) -> Attachment:
    """Anomalies of a story by identity or by one of its pids.

    Identity and pid each name at most one story, so the OR becomes two N:1 joins on the same
    anomaly row; no union of copies has to be made distinct.
    """
    by_name = stories.select(*SESSION, F.col("identity").alias("process"), F.col("identity").alias("_named"))
    by_pid = episodes.select(*SESSION, "pid", F.col("identity").alias("_owned"))
    hits = (
        anomalies.join(by_name, [*SESSION, "process"], "left")
        .join(by_pid, [*SESSION, "pid"], "left")
        .withColumn(
            "_stories", F.array_compact(F.array_distinct(F.array("_named", "_owned")))
        )
        .drop("_named", "_owned")
    )
    by_story = hits.select(
        F.explode("_stories").alias("identity"), *[c for c in hits.columns if c != "_stories"]
    )
    unattached = hits.groupBy(*SESSION).agg(
        F.count_if(F.size("_stories") == 0).alias("unattached")
    )
    return Attachment(by_story, unattached)


def top_stories(stories: DataFrame, k: int | None = None) -> DataFrame:
    """Stories that crashed or lost a process, most crashes first."""
    out = stories.where((F.col("n_crashes") > 0) | (F.col("n_victims") > 0)).orderBy(
        F.desc("n_crashes"), F.asc_nulls_last("first_line"), *SESSION, "identity"
    )
    return out if k is None else out.limit(k)
