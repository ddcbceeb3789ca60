"""Fields of a crash block.

``LINE`` reads everything one line can contribute. ``merge`` states once how the
contributions of a block combine (first wins, last wins, collected) and is used in two forms:
over rows (mergeable aggregates, any block length) and over an array (bounded blocks).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import family_mask_lower, family_of_mask
from .steps import Steps, let
from .text import WS_CLASS, after, before, first_token, lstrip, non_empty, number_after, strip

_STAMP = r"[0-9]{2}-[0-9]{2}[ :][0-9]{2}[ :][0-9]{2}[ :][0-9]{2}\.[0-9]{3}"
_TAG = r"^[0-9]+\s+[0-9]+\s+[\x21-\x7e]\s+(\S*):(?=\s|\z)"
# fixed values: what continues a block
_CONTINUES = (
    r"^(?:at |Caused by:|Suppressed:|#|\.\.\. |Abort message:|backtrace:|signal |pid: "
    r"|Process: |PID: |Build fingerprint:|Cmd line:|-----|DALVIK THREADS)"
)
_FRAME = r"^(?:at |#|\.\.\. )"
_EXCEPTION = r"^[A-Za-z0-9._$]*\.[A-Za-z0-9._$]*(?::|\z)"


def _rest(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{WS_CLASS}*(?:{_STAMP})?{WS_CLASS}*", "")


def stamp(line: Column) -> Column:
    return non_empty(F.regexp_extract(line, rf"^{WS_CLASS}*({_STAMP})", 1))


def _body_of_rest(rest: Column) -> Column:
    at = F.locate(": ", rest)
    return F.when(
        rest.rlike(r"^[0-9]+(?:\s|\z)") & (at > 0), lstrip(F.substr(rest, at + 2))
    ).otherwise(rest)


def message_body(line: Column) -> Column:
    """The message of a line: stamp, pid, tid, level and tag removed when they are there."""
    return let(_rest(line), _body_of_rest)


def logcat_tag(line: Column) -> Column:
    """Tag token of a threadtime line, only when the token itself ends in a colon."""
    rest = _rest(line)
    return F.when(rest.rlike(_TAG), F.regexp_extract(rest, _TAG, 1))


def starts_block(body: Column) -> Column:
    text = lstrip(body)
    return (
        F.contains(text, F.lit("FATAL EXCEPTION:"))
        | (text.startswith("signal ") & F.contains(text, F.lit("SIG")))
        | text.rlike(r"^(?:FATAL EXCEPTION|\*\*\* FATAL|\*\*\* \*\*\* \*\*\*|Abort message:|backtrace:)")
    )


def looks_like_exception(text: Column) -> Column:
    return text.rlike(_EXCEPTION)


def continues_block(line: Column) -> Column:
    text = lstrip(line)
    return (text != "") & (
        (text != line) | text.rlike(_CONTINUES) | looks_like_exception(text)
    )


#: What one line contributes; every field is NULL when the line says nothing about it.
LINE_FIELDS = (
    "stamp", "anr_at", "process_named", "process_other", "pid", "tid", "thread",
    "raised", "abort", "caused", "frame", "mask",
)


def _thread(v) -> Column:
    return F.coalesce(
        F.when(~v.body.startswith("pid: "), v.name),
        after(v.body, "FATAL EXCEPTION: "),
        F.when(v.quoted, F.regexp_extract(v.body, r'(?s)^"([^"]*)"', 1)),
    )


def _raised(v) -> Column:
    """What the line raises: a signal, an abort message, or an exception class."""

    def raised(exception: Column, message: Column) -> Column:
        return F.struct(exception.alias("exception"), message.alias("message"))

    fault = F.concat(F.lit("fault addr "), after(v.text, "fault addr "))
    return (
        F.when(v.text.startswith("signal "), raised(v.text, F.coalesce(v.abort, fault)))
        .when(v.abort.isNotNull(), raised(F.lit("Abort message"), v.abort))
        .when(
            looks_like_exception(v.text) & ~v.is_caused & ~v.is_frame,
            raised(strip(before(v.text, ":")), after(v.text, ":")),
        )
    )


LINE = Steps(
    rest=lambda v: _rest(v.line),
    body=lambda v: _body_of_rest(v.rest),
    text=lambda v: lstrip(v.body),
    lower=lambda v: F.lower(v.line),
    is_anr=lambda v: v.body.startswith("----- pid "),
    is_pid=lambda v: v.text.startswith("pid: "),
    is_caused=lambda v: v.text.startswith("Caused by:"),
    is_frame=lambda v: v.text.rlike(_FRAME),
    quoted=lambda v: v.body.rlike(r'(?s)^"[^"]*"'),
    name=lambda v: non_empty(first_token(after(v.body, "name: "))),
    abort=lambda v: F.regexp_replace(after(v.text, "Abort message: "), r"^'+|'+\z", ""),
    parts=lambda v: F.struct(
        stamp(v.line).alias("stamp"),
        F.when(
            v.is_anr, non_empty(strip(F.regexp_replace(after(v.body, " at "), r"-+\z", "")))
        ).alias("anr_at"),
        non_empty(strip(before(after(v.body, "Process: "), ","))).alias("process_named"),
        F.coalesce(F.when(v.is_pid, v.name), after(v.body, "Cmd line: ")).alias("process_other"),
        F.coalesce(
            F.when(v.is_anr, number_after(v.body, "----- pid ")),
            F.when(v.is_pid, number_after(v.body, "pid: ")),
            number_after(v.body, "PID: "),
        ).alias("pid"),
        F.coalesce(
            F.when(v.is_pid, number_after(v.body, "tid: ")),
            F.when(v.quoted, number_after(v.body, "tid=")),
        ).alias("tid"),
        _thread(v).alias("thread"),
        _raised(v).alias("raised"),
        v.abort.alias("abort"),
        F.when(v.is_caused, v.text).alias("caused"),
        F.when(~v.is_caused & v.is_frame, v.text).alias("frame"),
        family_mask_lower(v.lower).alias("mask"),
    ),
)


def with_hashes(parts: DataFrame) -> DataFrame:
    """Line parts plus the hashes of frames at ``frame_no``."""
    one, two = frame_hashes(F.col("frame"), F.col("frame_no"))
    held = F.col("frame").isNotNull()
    return parts.withColumns({"frame_h1": F.when(held, one), "frame_h2": F.when(held, two)})


def with_line_parts(df: DataFrame, line: Column) -> DataFrame:
    """``df`` plus one column per ``LINE_FIELDS``."""
    return LINE.on(df, line, "_parts").select(
        *df.columns, *[F.col("_parts").getField(n).alias(n) for n in LINE_FIELDS]
    )


@dataclass(frozen=True)
class Reducer:
    """How a block's contributions are read: by aggregate or out of an array."""

    first: Callable[[str], Column]
    last: Callable[[str], Column]
    every: Callable[[str], Column]
    count: Callable[[str], Column]
    stack: Callable[[], Column]
    mask: Callable[[], Column]


def merge(r: Reducer) -> dict[str, Column]:
    """The block rules: named process and abort message are last wins, the rest first wins."""
    raised = r.first("raised")
    exception = raised.getField("exception")
    return {
        "kind": family_of_mask(r.mask()),
        "process": F.coalesce(r.last("process_named"), r.first("process_other")),
        "pid": r.first("pid"),
        "tid": r.first("tid"),
        "thread": r.first("thread"),
        "exception": exception,
        "message": F.coalesce(r.last("abort"), raised.getField("message")),
        "frames": r.every("frame"),
        "caused_by": r.every("caused"),
        "timestamp": F.coalesce(r.last("anr_at"), r.first("stamp")),
        "n_frames": r.count("frame"),
        "stack_hash": r.stack(),
    }


def frame_hashes(frame: Column, at: Column) -> tuple[Column, Column]:
    """Two independent hashes of a frame at its place in the stack."""
    at = at.cast("bigint")
    return F.xxhash64(frame, at), F.xxhash64(F.lit("second"), frame, at)


def _stack_text(one: Column, two: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.concat_ws("-", F.hex(F.coalesce(one, zero)), F.hex(F.coalesce(two, zero)))


def row_reducer(order: str, inline: Column) -> Reducer:
    """Aggregates over rows with one column per line field (and the two frame hashes).

    ``inline`` says which rows may enter the arrays; scalars always see every row.
    """

    def ordered(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.col(order))

    def every(name: str) -> Column:
        pairs = F.array_sort(
            F.collect_list(
                F.when(
                    inline & F.col(name).isNotNull(),
                    F.struct(F.col(order).alias("at"), F.col(name).alias("text")),
                )
            )
        )
        return F.transform(pairs, lambda p: p.getField("text"))

    return Reducer(
        first=lambda name: F.min_by(name, ordered(name)),
        last=lambda name: F.max_by(name, ordered(name)),
        every=every,
        count=lambda name: F.count(name),
        stack=lambda: _stack_text(F.bit_xor("frame_h1"), F.bit_xor("frame_h2")),
        mask=lambda: F.bit_or("mask"),
    )


def array_reducer(parts: Column) -> Reducer:
    """Reads an array of line-field structs (a bounded block)."""

    def every(name: str) -> Column:
        return F.filter(F.transform(parts, lambda p: p.getField(name)), lambda v: v.isNotNull())

    def folded(which: int) -> Column:
        hashes = F.transform(every("frame"), lambda f, i: frame_hashes(f, i)[which])
        return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b))

    return Reducer(
        first=lambda name: F.get(every(name), F.lit(0)),
        last=lambda name: F.try_element_at(every(name), F.lit(-1)),
        every=every,
        count=lambda name: F.size(every(name)).cast("bigint"),
        stack=lambda: _stack_text(folded(0), folded(1)),
        mask=lambda: F.aggregate(
            parts, F.lit(0), lambda acc, p: acc.bitwiseOR(p.getField("mask"))
        ),
    )


#: Fields of which the first, or the last, line of a block that has them counts.
_FIRST = ("stamp", "process_other", "pid", "tid", "thread", "raised")
_LAST = ("process_named", "abort", "anr_at")


def partial(order: str) -> dict[str, Column]:
    """Aggregates over some lines of a block (one column per line field, the two frame hashes)
    that :func:`merge_partials` puts together with those of its other lines."""

    def placed(name: str) -> Column:
        return F.when(
            F.col(name).isNotNull(), F.struct(F.col(order).alias("at"), F.col(name).alias("value"))
        )

    return {
        **{name: F.min(placed(name)) for name in _FIRST},
        **{name: F.max(placed(name)) for name in _LAST},
        "mask": F.bit_or("mask"),
        "h1": F.bit_xor("frame_h1"),
        "h2": F.bit_xor("frame_h2"),
        "n_frames": F.count("frame"),
        "n_lines": F.count(F.lit(1)),
    }


def merge_partials() -> dict[str, Column]:
    """Aggregates over the partial rows of a block; their result is such a row again."""
    return {
        **{name: F.min(name) for name in _FIRST},
        **{name: F.max(name) for name in _LAST},
        "mask": F.bit_or("mask"),
        "h1": F.bit_xor("h1"),
        "h2": F.bit_xor("h2"),
        "n_frames": F.sum("n_frames"),
        "n_lines": F.sum("n_lines"),
    }


def partial_reducer() -> Reducer:
    """Reads a partial row; the lines themselves are not in it."""
    return Reducer(
        first=lambda name: F.col(f"{name}.value"),
        last=lambda name: F.col(f"{name}.value"),
        every=lambda name: F.lit(None).cast("array<string>"),
        count=lambda name: F.col("n_frames"),
        stack=lambda: _stack_text(F.col("h1"), F.col("h2")),
        mask=lambda: F.col("mask"),
    )


def is_frame(line: Column) -> Column:
    return is_frame_text(message_body(line))


def is_frame_text(body: Column) -> Column:
    text = lstrip(body)
    return text.rlike(_FRAME) & ~text.startswith("Caused by:")


def crash_fields(lines: Column) -> Column:
    """Struct of crash fields of a bounded block given as an array of lines."""
    parts = F.transform(lines, LINE.column)
    return let(
        parts, lambda p: F.struct(*[c.alias(n) for n, c in merge(array_reducer(p)).items()])
    )
