"""Filter rules compiled to one boolean Column."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .records import passes_min

#: Addressable fields; numbers compare as text.
FIELDS = {
    "tag": lambda: F.col("tag"),
    "message": lambda: F.col("message"),
    "pid": lambda: F.col("pid").cast("string"),
    "tid": lambda: F.col("tid").cast("string"),
    "uid": lambda: F.col("uid").cast("string"),
    "package": lambda: F.col("package"),
    "level": lambda: F.col("level"),
    "received": lambda: F.col("received_at_ms").cast("string"),
    "source": lambda: F.col("source"),
}
OPS = (
    "contains", "notContains", "equals", "notEquals", "regex", "minLevel", "in", "withinLast",
)


@dataclass(frozen=True)
class FilterRule:
    id: str
    field: str
    op: str
    value: str
    enabled: bool = True
    case_sensitive: bool = False


def min_level(level: str) -> FilterRule:
    return FilterRule("min-level", "level", "minLevel", level)


def compile_rules(rules: Iterable[FilterRule], *, as_of_ms: int | Column | None = None) -> Column:
    """AND of all enabled rules; no rule accepts everything. Disabled rules are not checked.

    ``as_of_ms`` is the clock of ``withinLast`` (default: now, per query or micro-batch).
    """
    parts = [_compile(rule, as_of_ms) for rule in rules if rule.enabled]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _compile(rule: FilterRule, as_of_ms: int | Column | None) -> Column:
    if rule.field not in FIELDS:
        raise ValueError(f"rule {rule.id}: unknown field {rule.field}")
    if rule.op not in OPS:
        raise ValueError(f"rule {rule.id}: unknown op {rule.op}")
    if rule.op in ("contains", "equals", "in") and rule.value == "":
        raise ValueError(f"rule {rule.id}: empty value")
    if rule.op == "withinLast":
        return _within_last(rule, as_of_ms)
    field = FIELDS[rule.field]()
    negative = rule.op in ("notContains", "notEquals")
    if rule.op == "regex":
        test = field.rlike(_pattern(rule))
    elif rule.op == "minLevel":
        level = S.LEVEL_NAMES.get(rule.value.strip().lower())
        if level is None:
            raise ValueError(f"rule {rule.id}: unknown level {rule.value}")
        # the record's level decides whatever the field; an absent field still fails
        test = field.isNotNull() & passes_min(F.col("level"), level)
    elif rule.op == "in":
        members = [m.strip().lower() for m in rule.value.split(",")]
        members = [m for m in members if m]
        test = F.lower(field).isin(*members) if members else F.lit(False)
    else:
        have, want = field, rule.value
        if not rule.case_sensitive:
            have, want = F.lower(field), rule.value.lower()
        test = (
            F.contains(have, F.lit(want))
            if rule.op in ("contains", "notContains")
            else have == F.lit(want)
        )
        if negative:
            test = ~test
    return F.coalesce(test, F.lit(negative))


def _pattern(rule: FilterRule) -> str:
    """Unanchored and Unicode-aware; case-insensitive unless asked otherwise."""
    if re.search(r"\(\?<?[=!]|(?<!\\)(?:\\\\)*\\[1-9]", rule.value):
        raise ValueError(f"rule {rule.id}: look-around and back-references are not supported")
    pattern = ("(?U)" if rule.case_sensitive else "(?iuU)") + rule.value
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        except (Py4JJavaError, PySparkException) as err:
            raise ValueError(f"rule {rule.id}: invalid pattern {rule.value}") from err
    return pattern


def _within_last(rule: FilterRule, as_of_ms: int | Column | None) -> Column:
    text = rule.value.strip()
    if not re.fullmatch(r"\+?[0-9]+", text) or int(text) == 0:
        raise ValueError(f"rule {rule.id}: window must be a positive number of seconds")
    now = F.unix_millis(F.current_timestamp()) if as_of_ms is None else as_of_ms
    now = now if isinstance(now, Column) else F.lit(now)
    return F.col("received_at_ms") + F.lit(int(text) * 1000) >= now


def structured_filter(
    *,
    levels: Iterable[str] = (),
    tag_include: str = "",
    tag_exclude: str = "",
    keyword: str = "",
    keyword_is_regex: bool = False,
    window_seconds: int | None = None,
) -> list[FilterRule]:
    """The filter form as rules; blank parts add none."""
    rules = []
    levels = list(levels)
    if levels:
        rules.append(FilterRule("__levels", "level", "in", ",".join(levels)))
    if tag_include.strip():
        rules.append(FilterRule("__tag-include", "tag", "contains", tag_include.strip()))
    if tag_exclude.strip():
        rules.append(FilterRule("__tag-exclude", "tag", "notContains", tag_exclude.strip()))
    if keyword.strip():
        op = "regex" if keyword_is_regex else "contains"
        rules.append(FilterRule("__keyword", "message", op, keyword.strip()))
    if window_seconds is not None and window_seconds > 0:
        rules.append(FilterRule("__window", "received", "withinLast", str(window_seconds)))
    return rules


def scan_hints(
    *,
    uid: int | None = None,
    pids: Iterable[int] = (),
    tags: Iterable[str] = (),
    sources: Iterable[str] = (),
) -> Column:
    """Narrowing for the scan: plain comparisons, so Parquet gets them pushed down.

    A uid outlives an application restart and is preferred over pids.
    """
    out = F.lit(True)
    pids = [p for p in pids if p > 0]
    tags = [t.strip() for t in tags if t.strip()]
    sources = list(sources)
    if uid is not None and uid >= 0:
        out = out & (F.col("uid") == uid)
    elif pids:
        out = out & F.col("pid").isin(*pids)
    if tags:
        out = out & F.col("tag").isin(*tags)
    if sources:
        out = out & F.col("source").isin(*sources)
    return out
