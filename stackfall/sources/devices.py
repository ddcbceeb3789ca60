"""Device texts: process tables, package inventories, profiles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.records import uid_from_cmd_list
from ..functions.text import first_token, non_empty, rest_from, strip, to_int
from ..operators import chunks as H
from ..schema import SNAPSHOT_VERSION

_STATES = list("SDIRTWZXVt")


def parse_ps(lines: DataFrame, *, keys=("device_serial", "polled_at_ms")) -> DataFrame:
    """``ps -A`` text lines (keys, ``line_no``, ``line``) to process rows.

    Columns are found through the header line; the name begins behind the last one-letter state
    that follows a hexadecimal token, so it may contain spaces.
    """
    keys = list(keys)
    words = F.split(strip(F.col("line")), r"\s+")
    heads = (
        lines.where(F.contains("line", F.lit("PID")))
        .groupBy(*keys)
        .agg(F.min("line_no").alias("_at"), F.min_by("line", "line_no").alias("_head"))
        .withColumn("_titles", F.split(strip(F.col("_head")), r"\s+"))
        .withColumn("_user", F.array_position("_titles", "USER"))
        .withColumn("_pid", F.array_position("_titles", "PID"))
        .where((F.col("_user") > 0) & (F.col("_pid") > 0))
        .select(*keys, "_at", "_user", "_pid")
    )
    rows = (
        lines.join(heads, keys)
        .where((F.col("line_no") > F.col("_at")) & (strip(F.col("line")) != ""))
        .withColumn("_w", words)
    )
    state_at = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size("_w") - 1, F.lit(1))),
        lambda i: F.coalesce(
            F.get("_w", i).isin(*_STATES) & F.get("_w", i - 1).rlike(r"^[0-9a-fA-F]*\z"),
            F.lit(False),
        ),
    )
    rows = rows.withColumn("_state", F.try_element_at(state_at, F.lit(-1))).withColumn(
        "name",
        F.when(
            F.col("_state") + 1 < F.size("_w"),
            F.array_join(F.slice("_w", F.col("_state") + 2, F.size("_w")), " "),
        ),
    )
    return rows.select(
        *keys,
        to_int(F.try_element_at("_w", F.col("_pid").cast("int"))).alias("pid"),
        F.try_element_at("_w", F.col("_user").cast("int")).alias("user"),
        "name", "line_no",
    ).where(F.col("pid").isNotNull() & F.col("user").isNotNull() & F.col("name").isNotNull())


def parse_app_labels(lines: DataFrame) -> DataFrame:
    """``package TAB label TAB uid TAB system`` rows; short rows and blank packages drop out."""
    cells = F.split("line", "\t", -1)

    def cell(i: int):
        return strip(F.get(cells, F.lit(i)))

    others = [c for c in lines.columns if c != "line"]
    return lines.where((F.size(cells) >= 4) & (cell(0) != "")).select(
        *others,
        cell(0).alias("package"), cell(1).alias("label"),
        to_int(cell(2)).alias("uid"), (cell(3) == "1").alias("system"),
    )


def _value_after(key: str):
    return non_empty(F.regexp_extract(rest_from(F.col("_t"), key), r"^\S*", 0))


def _rest_after(key: str):
    return non_empty(strip(rest_from(F.col("_t"), key)))


# fixed values: code paths of system packages
_SYSTEM_PATHS = r"^codePath=/(?:system|system_ext|product|vendor|apex)"


def parse_package_dump(
    lines: DataFrame, *, keys=("device_serial",), chunk_rows: int = H.CHUNK_ROWS
) -> DataFrame:
    """``Package [x]`` blocks to one row of facts per package.

    First wins per fact, except the target SDK, where the last statement wins. ``lines`` is
    ordered by ``seq`` within ``keys``.
    """
    keys = tuple(keys)
    rows = lines.withColumn("_t", strip(F.col("line"))).withColumn(
        "_name",
        F.when(
            F.col("_t").rlike(r"^Package \[[^\]]*\]"),
            strip(F.regexp_extract("_t", r"^Package \[([^\]]*)\]", 1)),
        ),
    )
    inside = H.scan(rows, last={"package": F.col("_name")}, keys=keys, chunk_rows=chunk_rows)
    inside = inside.where(F.col("package").isNotNull())
    user = F.col("_t").rlike(r"^User 0[: ]")
    body = F.col("_name").isNull() & ~user
    enabled = _value_after("enabled=")
    facts = inside.select(
        *keys, "package", "seq",
        F.when(body, _value_after("versionName=")).alias("_version"),
        F.when(
            body, F.coalesce(_rest_after("lastUpdateTime="), _rest_after("firstInstallTime="))
        ).alias("_installed"),
        F.when(body & _value_after("targetSdk=").isNotNull(),
               F.struct(to_int(_value_after("targetSdk=")).alias("v"))).alias("_sdk"),
        F.when(
            F.col("_name").isNull() & user,
            F.when(enabled == "0", False).when(enabled.isin("1", "2", "3", "4"), True),
        ).alias("_enabled"),
        F.when(
            body, F.col("_t").rlike(_SYSTEM_PATHS) | F.contains("_t", F.lit("SYSTEM"))
        ).alias("_system"),
    )

    def first(name: str):
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("seq")))

    return facts.groupBy(*keys, "package").agg(
        first("_version").alias("version_name"),
        first("_installed").alias("installed_at"),
        F.max_by("_sdk", F.when(F.col("_sdk").isNotNull(), F.col("seq"))).getField("v").alias("target_sdk"),
        first("_enabled").alias("enabled"),
        F.coalesce(F.bool_or("_system"), F.lit(False)).alias("system"),
    )


def parse_package_uids(lines: DataFrame) -> DataFrame:
    """Package uids out of three listings, in priority order: a package dump (``dumpsys``), the
    uid listing (``cmd``), the package table (``list``).

    ``lines``: device_serial, listing, package (of the dump; NULL elsewhere), line_no, line.
    """
    text = strip(F.col("line"))
    dump = to_int(first_token(F.when(text.startswith("userId="), F.substr(text, F.lit(8)))))
    cmd = uid_from_cmd_list(F.col("line"))
    listed = F.split(text, r"\s+")
    row = (
        F.when(
            (F.col("listing") == "dumpsys") & dump.isNotNull(),
            F.struct(F.lit(0).alias("rank"), F.col("package").alias("package"), dump.alias("uid")),
        )
        .when(
            F.col("listing") == "cmd",
            F.struct(F.lit(1).alias("rank"), cmd.getField("package").alias("package"),
                     cmd.getField("uid").alias("uid")),
        )
        .when(
            F.col("listing") == "list",
            F.struct(F.lit(2).alias("rank"), F.get(listed, F.lit(0)).alias("package"),
                     to_int(F.get(listed, F.lit(1))).alias("uid")),
        )
    )
    found = lines.select("device_serial", "line_no", row.alias("_r")).where(
        F.col("_r.package").isNotNull() & F.col("_r.uid").isNotNull()
    )
    return found.groupBy("device_serial", F.col("_r.package").alias("package")).agg(
        F.min_by("_r.uid", F.struct("_r.rank", "line_no")).alias("uid")
    )


def parse_profile(lines: DataFrame) -> DataFrame:
    """Kernel release, era and buffers of a device from ``uname -r`` and ``logcat -g`` lines.

    ``lines``: device_serial, command (``uname`` or ``logcat``), line_no, line.
    """
    uname = (F.col("command") == "uname") & (strip(F.col("line")) != "")
    buffer = F.when(F.col("command") == "logcat", C.buffer_name(F.col("line")))
    seen = lines.withColumn("_b", buffer).groupBy("device_serial").agg(
        F.min_by(strip(F.col("line")), F.when(uname, F.col("line_no"))).alias("kernel_raw"),
    )
    # a device has a handful of buffers: reduced to distinct names before they are collected
    names = (
        lines.withColumn("_b", buffer)
        .where(F.col("_b").isNotNull())
        .groupBy("device_serial", "_b")
        .agg(F.min("line_no").alias("_at"))
        .groupBy("device_serial")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_b"))).alias("_found"))
        .select(
            "device_serial",
            F.transform("_found", lambda p: p.getField("_b")).alias("logcat_buffers"),
        )
    )
    none = F.array().cast("array<string>")
    return (
        seen.join(names, "device_serial", "left")
        .withColumn("kernel", C.kernel_version(F.col("kernel_raw")))
        .withColumn("era", C.kernel_era(F.col("kernel")))
        .withColumn("logcat_buffers", F.coalesce("logcat_buffers", none))
        .select("device_serial", "kernel_raw", "kernel", "era", "logcat_buffers")
    )


# fixed values: probes that only some devices can answer
_BUFFER_PROBES = {"crash-events": "events", "boot-kernel": "kernel", "crash-kernel": "kernel"}
_STANDARD_BUFFERS = ("main", "system", "crash")


def has_buffer(buffers, name: str):
    """A device that reported no buffers is taken to have the standard ones."""
    standard = F.lit(name in _STANDARD_BUFFERS)
    return F.when(
        F.coalesce(F.size(buffers), F.lit(0)) <= 0, standard
    ).otherwise(F.array_contains(buffers, name))


def applicable(probes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Probes (device_serial, probe) that make sense on the device's kernel and buffers."""
    joined = probes.join(
        profiles.select("device_serial", "era", "logcat_buffers"), "device_serial", "left"
    )
    probe, buffers = F.col("probe"), F.col("logcat_buffers")
    era = F.coalesce("era", F.lit("unknown"))
    keep = F.when(F.lit(False), F.lit(True))
    for name, buffer in _BUFFER_PROBES.items():
        keep = keep.when(probe == name, has_buffer(buffers, buffer))
    keep = (
        keep.when(probe == "boot-dmesg", ~has_buffer(buffers, "kernel"))
        .when(probe == "boot-last-kmsg", era.isin("legacyLastKmsg", "unknown"))
        .when(probe.isin("boot-pstore", "recovery-pstore"), era.isin("pstore", "unknown"))
        .otherwise(F.lit(True))
    )
    return joined.where(keep).select(*probes.columns)


def load_snapshot(spark: SparkSession, path: str, version: int = SNAPSHOT_VERSION) -> DataFrame | None:
    """A stored snapshot; ``None`` when it is missing, unreadable or of another version."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return None
    if "version" not in found.columns:
        return None
    return found.where(F.col("version") == version)
