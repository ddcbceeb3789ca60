"""Line grammars as Column builders.

A grammar runs its regular expression once: the groups are written out with a separator and
split again, and every field then reads one element of that array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .steps import Steps, let
from .text import (
    first_token, literal_map, lstrip, non_empty, strip, to_double, to_int,
)

RECORD_TYPE = (
    "struct<level:string,timestamp:string,uptime_seconds:double,pid:int,tid:int,uid:int,"
    "tag:string,message:string>"
)

_SEP = "\uf8fe"
_THREADTIME = (
    r"(?s)^([0-9-]{5}(?:[0-9-]{5})?) \s*"
    r"(\+?([0-9]+):\+?([0-9]+):\+?([0-9]+)(?:\.[^ :]*)?) "
    r"\s*(?:([^:\s]++)\s++)?([+-]?[0-9]+)\s++([+-]?[0-9]+)\s++([VDIWEFSA])\s++([^:\s]++)\s*+:(.*)$"
)
_BRIEF = r"(?s)^([VDIWEFSA])/([^:(]*)(?:\(([^:]*))?:(.*)$"
_UPTIME = r"(?s)^\[([^\]]*)\](.*)$"
_SUBSYSTEM = r"(?s)^\s*+([A-Za-z0-9_./-]++(?: [A-Za-z0-9_./-]++)?)\s*+:(.*)$"


def _marked(text: Column, pattern: str, n: int) -> Column:
    """``text`` rewritten to the ``n`` groups of ``pattern``, each behind a mark; a text that does
    not match stays as it is. The pattern runs once per line."""
    return F.regexp_replace(text, pattern, "".join(f"{_SEP}${i}" for i in range(1, n + 1)))


def _groups(marked: Column, text: Column, n: int) -> Column:
    """The groups of :func:`_marked` as an array, NULL when there was no match."""
    return F.when(
        marked.startswith(_SEP) & ~text.startswith(_SEP),
        F.slice(F.split(marked, _SEP, n + 1), 2, n),
    )


def _record(
    level: Column,
    message: Column,
    tag: Column,
    timestamp: Column | None = None,
    uptime: Column | None = None,
    pid: Column | None = None,
    tid: Column | None = None,
    uid: Column | None = None,
) -> Column:
    null = F.lit(None)
    return F.struct(
        level.cast("string").alias("level"),
        (null if timestamp is None else timestamp).cast("string").alias("timestamp"),
        (null if uptime is None else uptime).cast("double").alias("uptime_seconds"),
        (null if pid is None else pid).cast("int").alias("pid"),
        (null if tid is None else tid).cast("int").alias("tid"),
        (null if uid is None else uid).cast("int").alias("uid"),
        tag.cast("string").alias("tag"),
        message.cast("string").alias("message"),
    )


# --- levels ---------------------------------------------------------------------------


def level_of_letter(letter: Column) -> Column:
    return F.coalesce(literal_map(S.LEVEL_OF_LETTER, F.upper(letter)), F.lit("unknown"))


def level_of_digit(digit: Column) -> Column:
    return literal_map(S.LEVEL_OF_DIGIT, F.pmod(digit, F.lit(8)).cast("int"))


def level_of_name(name: Column) -> Column:
    """Parse a level name; NULL for an unknown name."""
    return literal_map(S.LEVEL_NAMES, F.lower(strip(name)))


def level_rank(level: Column) -> Column:
    return literal_map(S.LEVEL_RANK, level).cast("int")


def level_badge(level: Column) -> Column:
    return literal_map(S.LEVEL_BADGE, level)


def passes_min(level: Column, minimum: str) -> Column:
    """An unknown level always passes a minimum."""
    return (level == "unknown") | (level_rank(level) >= F.lit(S.LEVEL_RANK[minimum]))


# --- uid tokens -----------------------------------------------------------------------

_USER_UID = {"root": 0, "system": 1000, "radio": 1001, "shell": 2000}
_USER_APP = r"^u([+-]?[0-9]+)_a([+-]?[0-9]+)$"


def uid_of_user(user: Column) -> Column:
    """A number, a well-known name, or ``u<user>_a<app>``."""
    who = to_int(F.regexp_extract(user, _USER_APP, 1)).cast("bigint")
    app = to_int(F.regexp_extract(user, _USER_APP, 2)).cast("bigint")
    top = F.lit(2_147_483_647).cast("bigint")
    low = F.lit(-2_147_483_648).cast("bigint")
    scaled = F.greatest(F.least(who * 100_000, top), low)
    return F.coalesce(
        to_int(user),
        literal_map(_USER_UID, user).cast("int"),
        F.when(who.isNotNull() & app.isNotNull(), F.least(scaled + 10_000 + app, top).cast("int")),
    )


def uid_token(token: Column) -> Column:
    return uid_of_user(non_empty(strip(F.regexp_replace(token, r"^uid=", ""))))


# --- logcat ---------------------------------------------------------------------------


def _strip_one_space(text: Column) -> Column:
    return F.regexp_replace(text, "^ ", "")


def _field(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def _threadtime_record(v) -> Column:
    def clock(i: int) -> Column:
        return _field(v.parts, i).try_cast("bigint")

    valid = (
        (clock(2) < 24) & (clock(3) < 60) & (clock(4) < 61)
        & v.pid.isNotNull() & v.tid.isNotNull()
    )
    return F.when(
        valid,
        _record(
            level=level_of_letter(_field(v.parts, 8)),
            timestamp=F.concat_ws(" ", _field(v.parts, 0), _field(v.parts, 1)),
            pid=v.pid,
            tid=v.tid,
            uid=v.uid,
            tag=_field(v.parts, 9),
            message=_strip_one_space(_field(v.parts, 10)),
        ),
    )


THREADTIME = Steps(
    marked=lambda v: _marked(v.line, _THREADTIME, 11),
    parts=lambda v: _groups(v.marked, v.line, 11),
    pid=lambda v: _field(v.parts, 6).try_cast("int"),
    tid=lambda v: _field(v.parts, 7).try_cast("int"),
    uid=lambda v: F.when(_field(v.parts, 5) != "", let(_field(v.parts, 5), uid_token)),
    record=_threadtime_record,
)


def _brief_record(v) -> Column:
    tail = F.get(v.parts, F.lit(2))
    pid = F.when(tail.endswith(")"), to_int(strip(F.regexp_replace(tail, r"\)\z", ""))))
    return F.when(
        v.parts.isNotNull() & (v.tag != ""),
        _record(
            level=level_of_letter(F.get(v.parts, F.lit(0))),
            pid=pid,
            tag=v.tag,
            message=_strip_one_space(F.get(v.parts, F.lit(3))),
        ),
    )


BRIEF = Steps(
    marked=lambda v: _marked(v.line, _BRIEF, 4),
    parts=lambda v: _groups(v.marked, v.line, 4),
    tag=lambda v: strip(F.get(v.parts, F.lit(1))),
    record=_brief_record,
)


def parse_threadtime(line: Column) -> Column:
    """``date time [uid] pid tid L tag: message``."""
    return THREADTIME.column(line)


def parse_brief(line: Column) -> Column:
    """``L/tag(pid): message``, pid optional."""
    return BRIEF.column(line)


def parse_logcat(line: Column) -> Column:
    return F.coalesce(parse_threadtime(line), parse_brief(line))


# --- kernel ---------------------------------------------------------------------------


def _split_subsystem(v) -> Column:
    head = F.get(v.head, F.lit(0))
    plausible = F.octet_length(head) <= 24
    return F.struct(
        F.when(plausible, head).alias("tag"),
        F.when(plausible, lstrip(F.get(v.head, F.lit(1)))).otherwise(v.line).alias("message"),
    )


SUBSYSTEM = Steps(
    marked=lambda v: _marked(v.line, _SUBSYSTEM, 2),
    head=lambda v: _groups(v.marked, v.line, 2),
    out=_split_subsystem,
)


def split_subsystem(message: Column) -> Column:
    """Kernel subsystem in front of the first colon (NULL when it does not look like one)."""
    return SUBSYSTEM.column(message)


def _u8(text: Column) -> Column:
    value = F.when(text.rlike(r"^\+?[0-9]+\z"), text.try_cast("int"))
    return F.when(value <= 255, value)


def _kernel_record(level: Column, uptime: Column, v) -> Column:
    head = F.get(v.head, F.lit(0))
    plausible = F.octet_length(head) <= 24
    return _record(
        level=level,
        uptime=uptime,
        tag=F.when(plausible, head),
        message=F.when(plausible, lstrip(F.get(v.head, F.lit(1)))).otherwise(v.body),
    )


DMESG = Steps(
    digit=lambda v: _u8(F.regexp_extract(v.line, r"^<([^>]*)>", 1)),
    rest=lambda v: lstrip(
        F.when(v.digit.isNotNull(), F.regexp_replace(v.line, r"^<[^>]*>", "")).otherwise(v.line)
    ),
    boxed=lambda v: _marked(v.rest, _UPTIME, 2),
    bracket=lambda v: _groups(v.boxed, v.rest, 2),
    uptime=lambda v: to_double(strip(F.get(v.bracket, F.lit(0)))),
    body=lambda v: F.when(
        v.uptime.isNotNull(), lstrip(F.get(v.bracket, F.lit(1)))
    ).otherwise(v.rest),
    marked=lambda v: _marked(v.body, _SUBSYSTEM, 2),
    head=lambda v: _groups(v.marked, v.body, 2),
    record=lambda v: F.when(
        (strip(v.line) != "") & (v.uptime.isNotNull() | v.digit.isNotNull()),
        _kernel_record(
            F.when(v.digit.isNotNull(), level_of_digit(v.digit)).otherwise("info"), v.uptime, v
        ),
    ),
)

KMSG = Steps(
    text=lambda v: strip(v.line),
    header=lambda v: F.when(
        F.contains(v.text, F.lit(";")), F.split(F.substring_index(v.text, ";", 1), ",", -1)
    ),
    digit=lambda v: _u8(strip(F.get(v.header, F.lit(0)))),
    usec=lambda v: to_double(strip(F.get(v.header, F.lit(2)))),
    body=lambda v: lstrip(F.substr(v.text, F.locate(";", v.text) + 1)),
    marked=lambda v: _marked(v.body, _SUBSYSTEM, 2),
    head=lambda v: _groups(v.marked, v.body, 2),
    record=lambda v: F.when(
        (F.size(v.header) == 4) & v.digit.isNotNull(),
        _kernel_record(level_of_digit(v.digit), v.usec / F.lit(1_000_000.0), v),
    ),
)


def parse_dmesg(line: Column) -> Column:
    """``[<N>][ uptime] message``; without the uptime bracket the ``<N>`` is required."""
    return DMESG.column(line)


def parse_kmsg(line: Column) -> Column:
    """``level,sequence,usec,flags;message``."""
    return KMSG.column(line)


def parse_kernel(line: Column, source: Column) -> Column:
    """The native grammar of the source first, the other one second."""
    dmesg, kmsg = parse_dmesg(line), parse_kmsg(line)
    return F.when(source == "kmsg", F.coalesce(kmsg, dmesg)).otherwise(F.coalesce(dmesg, kmsg))


def parse_auto(line: Column) -> Column:
    """logcat, then dmesg; the kmsg grammar is never tried here."""
    return F.coalesce(parse_logcat(line), parse_dmesg(line))


# --- source registry --------------------------------------------------------------------

#: Grammars of each kind, tried in this order before the raw fallback.
BUILT_IN = {
    "logcat": (THREADTIME, BRIEF),
    "dmesg": (DMESG, KMSG),
    "kmsg": (KMSG, DMESG),
    "crash": (THREADTIME, BRIEF, DMESG),
    "boot": (THREADTIME, BRIEF, DMESG),
    "recovery": (THREADTIME, BRIEF, DMESG),
    "module": (THREADTIME, BRIEF, DMESG),
}
_REGISTERED: dict[str, Callable[[Column], Column]] = {}


def register_source(kind: str, parser: Callable[[Column], Column]) -> None:
    """Add (or replace) the grammar of a source kind. ``parser`` returns ``RECORD_TYPE``."""
    _REGISTERED[kind] = parser


def unregister_source(kind: str) -> None:
    _REGISTERED.pop(kind, None)


def registered_sources() -> dict[str, Callable[[Column], Column]]:
    return dict(_REGISTERED)


def source_kinds() -> tuple[str, ...]:
    return tuple(dict.fromkeys([*BUILT_IN, *_REGISTERED]))


# --- time -----------------------------------------------------------------------------


def ms_of_day(text: Column) -> Column:
    """Milliseconds of day of a leading ``MM-DD HH:MM:SS.mmm`` stamp (NULL otherwise)."""
    stamp = F.substring(lstrip(text), 1, 18)
    ok = stamp.rlike(r"^..-.. [0-9]{2}:[0-9]{2}.[0-9]{2}.[0-9]{3}$")

    def part(at: int, n: int) -> Column:
        return F.substring(stamp, at, n).try_cast("bigint")

    return F.when(
        ok, ((part(7, 2) * 60 + part(10, 2)) * 60 + part(13, 2)) * 1000 + part(16, 3)
    )


def device_time(timestamp: Column, year: Column) -> Column:
    """Device clock as TIMESTAMP_NTZ; a stamp without a year takes ``year``."""
    full = F.when(timestamp.rlike(r"^[0-9]{4}-"), timestamp).otherwise(
        F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), timestamp)
    )
    return F.when(
        full.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"),
        full.try_cast("timestamp_ntz"),
    )


def process_from_cmdline(cmdline: Column) -> Column:
    """Package of a NUL-separated command line; kernel threads and paths give NULL."""
    head = strip(F.substring_index(cmdline, "\x00", 1))
    return F.when((head != "") & ~head.startswith("["), package_of_process(head))


def package_of_process(name: Column) -> Column:
    base = F.substring_index(name, ":", 1)
    return F.when(base.rlike(r"^[A-Za-z0-9._]+$") & F.contains(base, F.lit(".")), base)


def is_valid_package(name: Column) -> Column:
    return (
        name.rlike(r"^[A-Za-z0-9._]+\z")
        & ~name.startswith(".") & ~name.endswith(".") & ~F.contains(name, F.lit(".."))
    )


def uid_from_cmd_list(line: Column) -> Column:
    """``package:<name> uid:<n>`` -> struct(package, uid)."""
    rest = F.regexp_extract(strip(line), r"(?s)^package:(.*?) uid:(.*)$", 1)
    uid = first_token(F.regexp_extract(strip(line), r"(?s)^package:(.*?) uid:(.*)$", 2))
    return F.when(
        strip(line).rlike(r"(?s)^package:.*? uid:"),
        F.struct(strip(rest).alias("package"), to_int(uid).alias("uid")),
    )
