"""Activity-manager signals and resource anomalies out of one raw line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .steps import Steps
from .text import (
    after, before, contains_any, first_token, literal_map, non_empty, number_after,
    package_token, rest_from, strip, to_int,
)

AMS_TYPE = (
    "struct<kind:string,process:string,pid:int,uid:int,reason:string,crashing:boolean,"
    "detail:string>"
)

# --- fixed values: events-buffer names and text shapes -----------------------------------
_EVENT_NAMES = (
    ("am_crash:", "amCrash"),
    ("am_anr:", "amAnr"),
    ("am_proc_died:", "amProcDied"),
    ("am_kill:", "amKill"),
    ("am_proc_start:", "amProcStart"),
    ("am_low_memory:", "amKill"),
)
_TEXT_NEEDLES = (
    "isCrashing=", "ProcessRecord{", "Force finishing activity", "Force stopping ",
    "Killing ", "has died", "ANR in ", "Scheduling restart of crashed service",
)
_CRASH_REASON = ("crash", "anr", "error", "watchdog", "force stop", "force finish")


def may_be_ams(line: Column) -> Column:
    """Cheap gate: no line without one of these needles can be a signal."""
    return contains_any(line, [n for n, _ in _EVENT_NAMES] + list(_TEXT_NEEDLES))


def _signal(kind, process=None, pid=None, uid=None, reason=None, crashing=None, detail=None):
    def col(value, kind_of):
        return (F.lit(None) if value is None else value).cast(kind_of)

    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(
        kind.alias("kind"),
        col(process, "string").alias("process"),
        col(pid, "int").alias("pid"),
        col(uid, "int").alias("uid"),
        col(reason, "string").alias("reason"),
        col(crashing, "boolean").alias("crashing"),
        col(detail, "string").alias("detail"),
    )


def _event_kind(line: Column) -> Column:
    event = F.when(F.lit(False), F.lit(None).cast("string"))
    for needle, kind in _EVENT_NAMES:
        event = event.when(F.contains(line, F.lit(needle)), F.lit(kind))
    return F.when(F.contains(line, F.lit("[")), event)


def _from_event(v) -> Column:
    """An events-buffer payload, read by position."""

    def field(i: int) -> Column:
        return non_empty(F.get(v.fields, F.lit(i)))

    uid = to_int(field(3))
    sentence = F.filter(v.fields, lambda f: F.contains(f, F.lit(" ")))
    reason = F.coalesce(
        F.try_element_at(sentence, F.lit(-1)), non_empty(F.try_element_at(v.fields, F.lit(-1)))
    )
    detail = F.when(
        field(4).isNotNull() | field(5).isNotNull(), F.concat_ws(": ", field(4), field(5))
    )
    return _signal(
        v.event,
        process=F.coalesce(field(2), v.package),
        pid=to_int(field(1)),
        uid=F.when(uid > 0, uid),
        reason=F.when(v.event.isin("amKill", "amAnr"), reason),
        crashing=F.when(v.event == "amCrash", F.lit(True)),
        detail=F.when(v.event == "amCrash", detail),
    )


def _killed_pid(line: Column) -> Column:
    return to_int(strip(before(before(rest_from(line, "Killing "), "Killing "), ":")))


def _from_text(v) -> Column:
    """The text shapes, in their fixed order."""
    line = v.line

    def has(needle: str) -> Column:
        return F.contains(line, F.lit(needle))

    def token_after(key: str) -> Column:
        return non_empty(first_token(after(line, key)))

    activity = non_empty(strip(before(after(line, "Force finishing activity "), "/")))
    victim = strip(before(F.substr(v.victim, F.locate(":", v.victim) + 1), "/"))
    return (
        F.when(
            has("isCrashing="),
            _signal(
                "isCrashing",
                process=v.package,
                pid=F.coalesce(v.record_pid, number_after(line, "pid ")),
                crashing=after(line, "isCrashing=").startswith("true"),
            ),
        )
        .when(
            has("ProcessRecord{"),
            F.when(
                v.package.isNotNull(),
                _signal("processRecord", process=v.package, pid=v.record_pid),
            ),
        )
        .when(
            has("Force finishing activity"),
            _signal("forceFinish", process=F.coalesce(activity, v.package)),
        )
        .when(
            has("Force stopping "),
            _signal(
                "forceStop",
                process=token_after("Force stopping "),
                pid=number_after(line, "appid="),
                reason=after(line, "reason="),
            ),
        )
        .when(
            F.coalesce(v.victim.rlike(r"^[0-9]+:"), F.lit(False)),
            _signal(
                "killing",
                process=non_empty(victim),
                pid=_killed_pid(line),
                reason=F.when((v.last != "") & (v.last != line), v.last),
            ),
        )
        .when(
            has("has died"),
            _signal(
                "processDied",
                process=token_after("Process "),
                pid=number_after(line, "(pid "),
            ),
        )
        .when(
            has("ANR in "),
            _signal("anrIn", process=token_after("ANR in "), reason=after(line, "Reason:")),
        )
        .when(
            has("Scheduling restart of crashed service"), _signal("restart", process=v.package)
        )
    )


AMS = Steps(
    inside=lambda v: F.regexp_extract(v.line, r"(?s)\[([^\]]*)", 1),
    fields=lambda v: F.transform(F.split(v.inside, ",", -1), strip),
    event=lambda v: F.when(v.inside.rlike(r"[^\s,]"), _event_kind(v.line)),
    package=lambda v: package_token(v.line),
    record_pid=lambda v: to_int(
        F.regexp_extract(rest_from(v.line, "ProcessRecord{"), r"^\s*\S+\s+([^\s:]*)", 1)
    ),
    victim=lambda v: after(v.line, "Killing "),
    last=lambda v: strip(F.substring_index(v.line, "): ", -1)),
    signal=lambda v: F.when(v.event.isNotNull(), _from_event(v)).otherwise(_from_text(v)),
)


def parse_ams(line: Column) -> Column:
    """Activity-manager signal of a line as a struct, NULL when it carries none."""
    return AMS.column(line)


def is_source(kind: Column) -> Column:
    return kind.isin(*S.AMS_SOURCE_KINDS)


def is_victim(kind: Column) -> Column:
    return kind.isin(*S.AMS_VICTIM_KINDS)


def is_crash_reason(reason: Column) -> Column:
    return F.coalesce(contains_any(F.lower(reason), _CRASH_REASON), F.lit(False))


def ams_label(kind: Column) -> Column:
    return literal_map(S.AMS_LABEL, kind)


def activity_package(process: Column) -> Column:
    """Package inside an ``ActivityRecord{… com.x`` name; other names stay as they are."""
    return F.when(
        F.contains(process, F.lit("{")), F.coalesce(package_token(process), process)
    ).otherwise(process)


# --- resource anomalies -----------------------------------------------------------------

# fixed values: kind, severity, needles; the first needle found names the fragment
_OOM = ("OutOfMemoryError", "Failed to allocate")
_FD = ("EMFILE", "Too many open files", "fdsan", "FileDescriptorLimit")
_THREAD = (
    "pthread_create", "unable to create thread", "Thread creation failed",
    "OutOfResources: thread",
)
_BINDER = (
    "TransactionTooLargeException", "DeadSystemException",
    "Failed to find prepared transaction", "transaction failed",
)
_BINDER_GATE = (
    "TransactionTooLargeException", "Binder transaction failed", "binder transaction failed",
    "DeadSystemException", "Failed to find prepared transaction",
)


def may_be_anomaly(line: Column) -> Column:
    return contains_any(line, ("lowmemorykiller", "lmkd") + _OOM + _FD + _THREAD + _BINDER_GATE)


def _fragment(line: Column, needles) -> Column:
    rest = F.lit(None).cast("string")
    for needle in reversed(tuple(needles)):
        rest = F.when(
            F.contains(line, F.lit(needle)), F.concat(F.lit(needle), rest_from(line, needle))
        ).otherwise(rest)
    return rest


# fixed values: anomaly kind, severity, needles that decide it, needles that name the fragment
_ANOMALIES = (
    ("outOfMemory", "critical", _OOM, _OOM),
    ("fdExhaustion", "critical", _FD, _FD),
    ("threadExhaustion", "critical", _THREAD, _THREAD),
    ("binderFailure", "warning", _BINDER_GATE, _BINDER),
)


def _anomaly_kind(line: Column) -> Column:
    rule = F.when(
        contains_any(line, ("lowmemorykiller", "lmkd"))
        & contains_any(line, ("Killing", "Kill ")),
        "lowMemoryKill",
    )
    for kind, _, gate, _ in _ANOMALIES:
        rule = rule.when(contains_any(line, gate), kind)
    return rule


def _anomaly_rest(v) -> Column:
    rule = F.when(v.kind == "lowMemoryKill", _fragment(v.line, ("Killing", "Kill ")))
    for kind, _, _, needles in _ANOMALIES:
        rule = rule.when(v.kind == kind, _fragment(v.line, needles))
    return rule


ANOMALY = Steps(
    kind=lambda v: _anomaly_kind(v.line),
    rest=_anomaly_rest,
    process=lambda v: F.coalesce(
        non_empty(strip(F.regexp_extract(v.line, r"(?s)^[^']*'([^']*)'", 1))),
        package_token(v.line, extra="'"),
    ),
    anomaly=lambda v: F.when(
        v.kind.isNotNull(),
        F.struct(
            v.kind.alias("kind"),
            F.when(v.kind == "binderFailure", "warning").otherwise("critical").alias("severity"),
            v.process.alias("process"),
            F.coalesce(
                to_int(F.regexp_extract(v.line, r"(?s)^[^(]*\(([0-9]+)", 1)),
                _killed_pid(v.line),
            ).alias("pid"),
            strip(v.rest).alias("detail"),
        ),
    ),
)


def parse_anomaly(line: Column) -> Column:
    """Resource anomaly of a line as a struct, NULL when it names none."""
    return ANOMALY.column(line)
