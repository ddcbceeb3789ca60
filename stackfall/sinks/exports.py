"""Exports, snapshots and streaming sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crash as K
from ..functions.records import level_badge
from ..operators.chunks import line_ranks
from ..operators.views import cap_events
from ..schema import SESSION, SNAPSHOT_VERSION
from ..sources.lines import number_files
from .store import BatchStore

#: Fields of the CSV and JSON exports, in order.
FIELDS = (
    "seq", "timestamp", "level", "pid", "tid", "uid", "tag", "package", "source", "message",
)
_KEYS = list(SESSION)


def to_export_line() -> Column:
    """Compact one-line rendering with ``-`` for what is absent."""

    def or_dash(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("-"))

    return F.concat(
        F.concat_ws(
            " ", or_dash("timestamp"), level_badge(F.col("level")), or_dash("pid"),
            or_dash("tid"), or_dash("tag"),
        ),
        F.lit(": "), F.col("message"),
    )


def log_text() -> Column:
    """Threadtime-shaped line; an unparsed row is its raw text."""

    def padded(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(F.length(text) >= 5, text).otherwise(F.lpad(text, 5, " "))

    shaped = F.concat(
        F.coalesce("timestamp", F.lit(" " * 18)), F.lit(" "), padded("pid"), F.lit(" "),
        padded("tid"), F.lit(" "), level_badge(F.col("level")), F.lit(" "),
        F.coalesce("tag", F.lit("")), F.lit(": "), F.col("message"),
    )
    raw = F.when(F.col("raw") != "", F.col("raw")).otherwise(F.col("message"))
    return F.when(F.col("parsed"), shaped).otherwise(raw)


def _ordered(records: DataFrame) -> DataFrame:
    """Range-partitioned by (session, seq): files follow capture order and a giant session is
    spread over many of them."""
    return records.repartitionByRange(*_KEYS, "seq").sortWithinPartitions(*_KEYS, "seq")


def write_ordered(rows: DataFrame, path: str, order: list[str | Column], line: Column) -> None:
    """One text line a row in total order: the files follow each other by name. One range exchange;
    equal rows of the order lie together."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    ranged.select(line.alias("value")).write.text(path)


def read_ordered(spark, path: str) -> DataFrame:
    """``position, line`` of the lines that :func:`write_ordered` wrote, over all files."""
    text = spark.read.option("lineSep", "\n").text(path)
    return number_files(text).select(F.col("seq").alias("position"), F.col("value").alias("line"))


def export_log(records: DataFrame, path: str) -> None:
    """Text export, one directory per session, lines in capture order."""
    rows = _ordered(records).select(*_KEYS, log_text().alias("value"))
    rows.write.partitionBy(*_KEYS).text(path)


def _export_fields() -> list[Column]:
    raw = F.when(F.col("raw") != "", F.col("raw")).otherwise(F.col("message"))
    message = F.when(F.col("parsed"), F.col("message")).otherwise(raw)
    texts = [
        F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in FIELDS if n != "message"
    ]
    return [*texts, message.alias("message")]


def export_csv(records: DataFrame, path: str, *, bom: bool = False) -> None:
    """CSV export (RFC 4180 quoting) with a header. ``bom`` marks the header of every file for
    spreadsheets."""
    rows = _ordered(records).select(*_export_fields())
    if bom:
        rows = rows.withColumnRenamed(FIELDS[0], "\ufeff" + FIELDS[0])
    (
        rows.write.option("header", True).option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def export_json(records: DataFrame, path: str) -> None:
    """JSON lines with the export fields, the receive time and the session."""
    rows = _ordered(records).select(
        *_export_fields(), F.col("received_at_ms").alias("receivedAtMs"),
        F.col("session_id").alias("sessionId"),
    )
    rows.write.json(path)


def write_records(records: DataFrame, path: str, *, mode: str = "append") -> None:
    """Records as Parquet, partitioned by device and sorted by (session, seq): narrowing by tag,
    pid, uid or level then skips row groups."""
    _ordered(records).write.mode(mode).partitionBy("device_serial").parquet(path)


def write_ranks(records: DataFrame, path: str) -> None:
    """The rank structure of stored records (``chunks.line_ranks``), to be given to ``evidence``,
    ``evidence_rows`` and ``analyse``."""
    line_ranks(records).write.mode("overwrite").partitionBy("device_serial").parquet(path)


def read_ranks(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def safe_stem(name: str) -> str:
    """File stem without path, hidden-file dots or unusual characters."""
    last = re.split(r"[/\\]", name)[-1].strip()
    stem = last.rsplit(".", 1)[0] if "." in last else last
    stem = re.sub(r"[^A-Za-z0-9._-]", "", stem.lstrip("."))[:96].strip("-_.")
    return stem or "export"


def save_snapshot(
    events: DataFrame, path: str, saved_at_ms: int, *, newest: int | None = None
) -> None:
    """All events, or the ``newest`` ones of every session, replacing the snapshot before."""
    kept = events if newest is None else cap_events(events, newest)
    kept.withColumns(
        {"version": F.lit(SNAPSHOT_VERSION), "saved_at_ms": F.lit(saved_at_ms).cast("bigint")}
    ).write.mode("overwrite").parquet(path)


def clear_snapshot(spark, path: str) -> None:
    """Forget a stored snapshot: it is replaced by one without events."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").parquet(path)


def write_live(stream: DataFrame, path: str, checkpoint: str, *, batch_ms: int | None = None):
    """Appends accepted live records; ``batch_ms=None`` drains what is there and stops."""
    writer = (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return _start(writer, batch_ms)


_EVENT_KEYS = [*SESSION, "event_id"]
_OWN = ("kind", "process", "pid", "detail")


def _partial_events(rows: DataFrame) -> DataFrame:
    """Rows of ``live_watch`` as partial states, one per event id."""
    named = rows.withColumnsRenamed({n: f"_{n}" for n in _OWN})  # line parts have these names too
    parts = K.with_hashes(K.with_line_parts(named, F.coalesce("line", F.lit(""))))
    crash = F.col("type") == "crash"
    # only lines of a block have parts
    parts = parts.withColumns({n: F.when(crash, F.col(n)) for n in (*K.LINE_FIELDS, "frame_h1", "frame_h2")})
    first = F.col("line_no") == 0
    own = ~F.col("type").isin("crash", "closed")
    fields = K.partial("line_no") | {"n_lines": F.count_if(crash)}
    return parts.groupBy(*_EVENT_KEYS).agg(
        F.max(F.when(own, F.col("type"))).alias("own_type"),
        F.min(F.when(F.col("type") != "closed", F.col("seq"))).alias("seq"),
        F.max("seq").alias("version"),
        F.bool_or(~crash).alias("complete"),
        *[F.max(F.when(own, F.col(f"_{n}"))).alias(f"own_{n}") for n in _OWN],
        *[F.max(F.when(crash & first, F.col(f"_{n}"))).alias(f"open_{n}") for n in ("process", "pid")],
        F.struct(*[c.alias(n) for n, c in fields.items()]).alias("block"),
    )


def _merge_events(states: DataFrame) -> DataFrame:
    """Partial states of equal event ids put together; the result is a partial state again."""
    flat = states.select(*[c for c in states.columns if c != "block"], "block.*")
    newest = [c for c in states.columns if c.startswith(("own_", "open_"))]
    return flat.groupBy(*_EVENT_KEYS).agg(
        F.max("own_type").alias("own_type"),
        F.min("seq").alias("seq"),
        F.max("version").alias("version"),
        F.bool_or("complete").alias("complete"),
        *[F.max(c).alias(c) for c in newest if c != "own_type"],
        F.struct(*[c.alias(n) for n, c in K.merge_partials().items()]).alias("block"),
    )


def event_store(spark, path: str, *, every: int = 16) -> BatchStore:
    """The states of live events by id: a batch adds its own lines' share, closed events are stored
    for good."""
    empty = "device_serial string, session_id string, event_id string, type string, seq bigint, kind string, process string, pid int, detail string, line_no bigint, frame_no bigint, line string"
    schema = _partial_events(spark.createDataFrame([], empty)).schema
    return BatchStore(
        spark, f"{path}/events", _merge_events, schema, final=F.col("complete"), every=every
    )


def write_events(
    stream: DataFrame, path: str, checkpoint: str, *, batch_ms: int | None = None, every: int = 16
):
    """Stores a ``live_watch``: the lines of blocks, each once, and what they add to the state of
    their event. A batch that runs again replaces what it wrote."""
    store = event_store(stream.sparkSession, path, every=every)

    def add(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/rows/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        rows = stream.sparkSession.read.schema(stream.schema).parquet(target)
        store.append(_partial_events(rows), batch_id)

    writer = (
        stream.writeStream.outputMode("append").foreachBatch(add)
        .option("checkpointLocation", checkpoint)
    )
    return _start(writer, batch_ms)


def read_events(spark, path: str) -> DataFrame:
    """Newest state of every live event written by :func:`write_events`."""
    states = event_store(spark, path).read()
    flat = states.select(*[c for c in states.columns if c != "block"], "block.*")
    crash = F.col("own_type").isNull()
    fields = K.merge(K.partial_reducer())
    of_block = lambda name: F.when(crash, fields[name])
    return flat.select(
        *_EVENT_KEYS,
        F.coalesce("own_type", F.lit("crash")).alias("type"),
        "seq", "version", "complete",
        F.coalesce("own_kind", of_block("kind")).alias("kind"),
        F.coalesce("own_process", of_block("process"), "open_process").alias("process"),
        F.coalesce("own_pid", of_block("pid"), "open_pid").alias("pid"),
        F.coalesce("own_detail", of_block("exception")).alias("detail"),
        *[of_block(n).alias(n) for n in ("tid", "thread", "exception", "message", "timestamp", "stack_hash")],
        F.when(crash, F.col("n_lines")).alias("n_lines"),
        F.when(crash, F.col("n_frames")).alias("n_frames"),
    )


def read_event_lines(spark, path: str) -> DataFrame:
    """The stored lines of live crash blocks, for ``blocks.crash_events``: ``start_seq`` and places."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/batch=*")
    return rows.where(F.col("type") == "crash").select(
        *SESSION, "seq", "line", F.substring_index("event_id", "#", -1).cast("bigint").alias("start_seq"),
        "line_no", "frame_no",
    )


def _start(writer, batch_ms: int | None):
    if batch_ms is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{batch_ms} milliseconds").start()
