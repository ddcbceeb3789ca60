"""Processes, packages and uids: who a record belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import is_valid_package, package_of_process, uid_of_user
from ..functions.text import strip, to_int
from ..schema import BOOT_WINDOW_MS, DAY_MS, INVENTORY_TTL_MS
from . import chunks as H

#: Span of receive time whose process snapshots are looked up together.
AS_OF_CHUNK_MS = 600_000


def pids_of_package(ps: DataFrame, package: str) -> DataFrame:
    """Pids of a package per device, its ``package:child`` processes included."""
    own = (F.col("name") == package) | F.col("name").startswith(package + ":")
    return _pids(ps.where(own))


def pids_of_uid(ps: DataFrame, uid: int) -> DataFrame:
    return _pids(ps.where(uid_of_user(F.col("user")) == uid))


def _pids(ps: DataFrame) -> DataFrame:
    return ps.groupBy("device_serial").agg(F.array_sort(F.collect_set("pid")).alias("pids"))


def running_apps(ps: DataFrame) -> DataFrame:
    """Base package -> first known uid and sorted distinct pids, per device.

    ``line_no`` of the process table is the order in which the first known uid wins.
    """
    rows = ps.withColumn("package", package_of_process(F.col("name"))).where(
        F.col("package").isNotNull()
    )
    rows = rows.withColumn("_uid", uid_of_user(F.col("user")))
    return rows.groupBy("device_serial", "package").agg(
        F.min_by("_uid", F.when(F.col("_uid").isNotNull(), F.col("line_no"))).alias("uid"),
        F.array_sort(F.collect_set("pid")).alias("pids"),
    )


def display_name(package: Column, known: Column | None = None) -> Column:
    """A known name, else the capitalised last segment of the package."""
    segments = F.filter(F.split(package, r"\."), lambda s: s != "")
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), package)
    derived = F.concat(F.upper(F.substring(last, 1, 1)), F.substr(last, F.lit(2)))
    return derived if known is None else F.coalesce(known, derived)


def running_named(apps: DataFrame, labels: DataFrame) -> DataFrame:
    """Running applications with their label, or a name derived from the package."""
    names = labels.where(F.col("label") != "").select("device_serial", "package", "label")
    joined = apps.join(names, ["device_serial", "package"], "left")
    return joined.withColumn("name", F.coalesce("label", display_name(F.col("package")))).drop(
        "label"
    )


def with_package(records: DataFrame, ps: DataFrame, *, chunk_ms: int = AS_OF_CHUNK_MS) -> DataFrame:
    """Fills ``package`` from the process snapshot valid when the record arrived.

    As-of lookup by (device, pid) as an equi-join: the package of a pid hardly ever changes, so the
    changes of a span of ``chunk_ms``, after the package carried into it, are one short list, and a
    record picks from the list of its span. Records are joined, not sorted; a pid that logs a third
    of all rows is spread over its spans, and a hot span is a skewed join that AQE splits.
    """
    keys = ["device_serial", "pid"]
    span = lambda at: F.expr(f"{at} div {int(chunk_ms)}").alias("_span")
    snapshots = ps.where(F.col("pid").isNotNull() & F.col("polled_at_ms").isNotNull())
    snapshots = snapshots.groupBy(*keys, F.col("polled_at_ms").alias("at")).agg(
        F.min(package_of_process(F.col("name"))).alias("package")
    )
    along = Window.partitionBy(*keys).orderBy("at")
    before = F.lag(F.struct("package")).over(along)
    changes = snapshots.withColumn("_was", before).where(
        F.col("_was").isNull() | ~F.col("package").eqNullSafe(F.col("_was.package"))
    )
    entry = F.struct("at", "package")
    by_span = changes.groupBy(*keys, span("at")).agg(
        F.array_sort(F.collect_list(entry)).alias("_changes"), F.max(entry).alias("_last")
    )
    asked = records.where(F.col("pid").isNotNull()).select(*keys, span("received_at_ms")).distinct()
    earlier = (
        Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = F.array(F.last("_last", ignorenulls=True).over(earlier))
    held = asked.join(by_span, [*keys, "_span"], "full").select(
        *keys, "_span",
        F.filter(
            F.concat(carried, F.coalesce("_changes", F.array().cast(by_span.schema["_changes"].dataType))),
            lambda e: e.isNotNull(),
        ).alias("_held"),
    )
    valid = F.filter("_held", lambda e: e.getField("at") <= F.col("received_at_ms"))
    found = F.try_element_at(valid, F.lit(-1)).getField("package")
    rows = records.withColumn("_span", span("received_at_ms"))
    return (
        rows.join(held, [*keys, "_span"], "left")
        .withColumn("package", F.coalesce("package", found))
        .select(*records.columns)
    )


# --- targets ----------------------------------------------------------------------------


def resolve_targets(
    inputs: DataFrame, ps: DataFrame, uids: DataFrame, cmdlines: DataFrame | None = None
) -> DataFrame:
    """User input (``device_serial``, ``input``) to an identity.

    A number is a running pid first, a uid second. A package stays a package: it is never
    widened to all applications sharing its uid. ``uids`` is (device, package, uid);
    ``cmdlines`` (device, pid, package) wins over the process name where it is given.
    """
    asked = inputs.select("device_serial", strip(F.col("input")).alias("input")).where(
        F.col("input") != ""
    )
    asked = asked.withColumn("_n", to_int(F.col("input")))
    table = ps.withColumn("_pkg", package_of_process(F.col("name"))).withColumn(
        "_uid", uid_of_user(F.col("user"))
    )
    by_pid = table.groupBy("device_serial", F.col("pid").alias("_n")).agg(
        F.min_by("_pkg", "line_no").alias("_pid_package"),
        F.min_by("_uid", "line_no").alias("_pid_uid"),
        F.lit(True).alias("_is_pid"),
    )
    if cmdlines is not None:
        named = cmdlines.select("device_serial", F.col("pid").alias("_n"), F.col("package").alias("_cmd"))
        by_pid = (
            by_pid.join(named, ["device_serial", "_n"], "left")
            .withColumn("_pid_package", F.coalesce("_cmd", "_pid_package"))
            .drop("_cmd")
        )
    by_uid = (
        table.where(F.col("_uid").isNotNull())
        .groupBy("device_serial", F.col("_uid").alias("_n"))
        .agg(F.array_sort(F.collect_set("pid")).alias("_uid_pids"))
    )
    by_package = (
        table.where(F.col("_pkg").isNotNull())
        .groupBy("device_serial", F.col("_pkg").alias("_package"))
        .agg(F.array_sort(F.collect_set("pid")).alias("_package_pids"))
    )
    installed = uids.groupBy("device_serial", F.col("package").alias("_package")).agg(
        F.min("uid").alias("_package_uid")
    )
    keys = ["device_serial", "_n"]
    out = asked.join(by_pid, keys, "left").join(by_uid, keys, "left")
    is_number = F.col("_n").isNotNull()
    is_pid = F.coalesce(F.col("_is_pid"), F.lit(False))
    is_uid = is_number & ~is_pid & F.col("_uid_pids").isNotNull()
    name = F.when(is_number, F.col("_pid_package")).otherwise(F.col("input"))
    out = out.withColumn("_package", name)
    out = out.join(by_package, ["device_serial", "_package"], "left").join(
        installed, ["device_serial", "_package"], "left"
    )
    package_found = ~is_number & F.col("_package_pids").isNotNull()
    no_pids = F.array().cast("array<int>")
    pids = (
        F.when(is_pid, F.coalesce("_package_pids", F.array("_n")))
        .when(is_uid, F.col("_uid_pids"))
        .when(package_found, F.col("_package_pids"))
        .otherwise(no_pids)
    )
    reason = (
        F.when(is_pid | is_uid | package_found, F.lit(None).cast("string"))
        .when(is_number, "neither a running pid nor the uid of a process")
        .when(~is_valid_package(F.col("input")), "not a package name")
        .when(F.col("_package_uid").isNotNull(), "installed but not running")
        .otherwise("not installed")
    )
    return out.select(
        "device_serial", "input",
        F.when(is_pid, "pid").when(is_uid, "uid").when(is_number, "pid")
        .otherwise("package").alias("kind"),
        F.when(is_pid, F.col("_pid_package")).when(package_found, F.col("input")).alias("package"),
        F.when(is_pid & F.col("_pid_package").isNotNull(), F.col("_package_uid"))
        .when(is_pid, F.col("_pid_uid"))
        .when(is_uid, F.col("_n"))
        .when(package_found, F.col("_package_uid")).alias("uid"),
        pids.alias("pids"),
        (is_pid | is_uid | package_found).alias("found"),
        reason.alias("reason"),
    )


def follow_predicate(
    *, pids=(), uid: int | None = None, package: str | None = None, found: bool = True
) -> Column:
    """One followed application as a predicate: any of pid, uid, package. An application that
    was not found keeps nothing."""
    if not found:
        return F.lit(False)
    hit = F.lit(False)
    if pids:
        hit = hit | F.col("pid").isin(*pids)
    if uid is not None:
        hit = hit | (F.col("uid") == uid)
    if package is not None:
        hit = hit | (F.col("package") == package)
    return F.coalesce(hit, F.lit(False))


def follow(records: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Records of any followed application; no target table keeps all.

    The OR over pid, uid and package becomes three N:1 lookups against distinct keys, so it
    needs neither a nested-loop join nor a distinct over the log; small target sets are
    broadcast by the adaptive planner, large ones are not.
    """
    if targets is None:
        return records
    live = targets.where("found")

    def keys(value: Column, name: str) -> DataFrame:
        return (
            live.select("device_serial", value.alias(name))
            .where(F.col(name).isNotNull())
            .distinct()
            .withColumn(f"_by_{name}", F.lit(True))
        )

    out = records
    for name, value in (
        ("pid", F.explode("pids")), ("uid", F.col("uid")), ("package", F.col("package")),
    ):
        out = out.join(keys(value, name), ["device_serial", name], "left")
    hit = F.coalesce("_by_pid", "_by_uid", "_by_package", F.lit(False))
    return out.where(hit).select(*records.columns)


# --- inventory ---------------------------------------------------------------------------


def installed_apps(labels: DataFrame, facts: DataFrame, *, include_system: bool = True) -> DataFrame:
    """Labelled packages with their facts; a device without any label falls back to its facts."""
    bare = (
        facts.join(labels.select("device_serial").distinct(), "device_serial", "left_anti")
        .select(
            "device_serial", "package", F.lit("").alias("label"),
            F.lit(None).cast("int").alias("uid"), "system",
        )
    )
    rows = labels.select("device_serial", "package", "label", "uid", "system").unionByName(bare)
    if not include_system:
        rows = rows.where(~F.col("system"))
    return rows.join(facts.drop("system"), ["device_serial", "package"], "left")


def latest_inventory(snapshots: DataFrame, as_of_ms: int | Column, *, ttl_ms: int = INVENTORY_TTL_MS) -> DataFrame:
    """Rows of each device's newest snapshot within its lifetime that has any label."""
    now = F.lit(as_of_ms) if isinstance(as_of_ms, int) else as_of_ms
    fresh = snapshots.where(
        (F.col("taken_at_ms") <= now) & (now - F.col("taken_at_ms") <= ttl_ms)
    )
    newest = (
        fresh.where(F.col("label") != "")
        .groupBy("device_serial")
        .agg(F.max("taken_at_ms").alias("taken_at_ms"))
    )
    return fresh.join(newest, ["device_serial", "taken_at_ms"], "left_semi")


def _with_previous(feed: DataFrame, value: Column, keys, order: str) -> DataFrame:
    """Adds ``_before``: the value of the poll before, over any number of polls (day chunks)."""
    rows = feed.withColumn("seq", F.col(order)).withColumn("_held", value)
    out = H.scan(
        rows, last={"_before": F.col("_held")}, before=True, keys=tuple(keys), chunk_rows=DAY_MS
    )
    return out.drop("seq")


def app_launches(states: DataFrame) -> DataFrame:
    """Start, stop and pid-change edges of a followed application over its polls.

    ``states``: device_serial, package, polled_at_ms, pids (empty when it is not running). The
    first poll that sees it running is a start.
    """
    rows = _with_previous(states, F.col("pids"), ("device_serial", "package"), "polled_at_ms")
    was = F.col("_before")
    up, was_up = F.size("pids") > 0, F.coalesce(F.size(was) > 0, F.lit(False))
    edge = (
        F.when(up & ~was_up, "start")
        .when(~up & was_up, "stop")
        .when(up & was_up & (F.col("pids") != was), "restart")
    )
    return (
        rows.withColumn("edge", edge)
        .where(F.col("edge").isNotNull())
        .select(*states.columns, "edge")
    )


def device_changes(
    feed: DataFrame, *, keys=("device_serial",), order: str = "polled_at_ms"
) -> DataFrame:
    """Rows of a device feed that differ from the one before."""
    content = F.struct(*[c for c in feed.columns if c not in (*keys, order)])
    rows = _with_previous(feed, content, keys, order)
    return rows.where(~F.col("_held").eqNullSafe(F.col("_before"))).select(*feed.columns)


def boot_window(
    polls: DataFrame,
    *,
    window_ms: int = BOOT_WINDOW_MS,
    seed_only: bool = True,
) -> DataFrame:
    """Polls that belong to a boot capture: up to the poll that sees the boot completed, or the
    end of the window. With ``seed_only`` the first poll only aligns the line tail.

    ``polls``: device_serial, boot_id, polled_at_ms, booted.
    """
    ends = polls.groupBy("device_serial", "boot_id").agg(
        F.min("polled_at_ms").alias("_start"),
        F.min(F.when(F.col("booted"), F.col("polled_at_ms"))).alias("_booted"),
    )
    deadline = F.least(F.col("_booted"), F.col("_start") + window_ms)
    return (
        polls.join(ends, ["device_serial", "boot_id"])
        .where(F.col("polled_at_ms") <= deadline)
        .withColumn("seed", (F.col("polled_at_ms") == F.col("_start")) & F.lit(seed_only))
        .drop("_start", "_booted")
    )
