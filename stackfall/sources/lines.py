"""Raw lines: batch and streaming scans, capture order, and the parse job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.text import strip
from ..schema import LOG_LINE, SESSION
from ..sinks.store import BatchStore

RECORD_COLUMNS = (
    "device_serial", "session_id", "seq", "source", "level", "level_rank", "timestamp",
    "uptime_seconds", "pid", "tid", "uid", "tag", "package", "message", "raw",
    "received_at_ms", "parsed",
)


def clean_line(value: Column) -> Column:
    """Lossy UTF-8 and no trailing carriage return."""
    return F.regexp_replace(F.make_valid_utf8(value), r"\r\z", "")


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    source: str,
    device: str | Column,
    session: str | Column,
    received_at_ms: int | None = None,
) -> DataFrame:
    """Text files as ordered log lines; ``device`` and ``session`` may be Columns over
    ``file_path``. Files stay splittable; see :func:`with_file_seq` for the order."""
    text = spark.read.option("lineSep", "\n").text(path)
    lines = with_file_seq(text)

    def key(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return lines.select(
        key(device).alias("device_serial"),
        key(session).alias("session_id"),
        "seq",
        F.lit(source).alias("source"),
        F.lit(received_at_ms).cast("bigint").alias("received_at_ms"),
        clean_line(F.col("value")).alias("line"),
    )


def with_file_seq(text: DataFrame) -> DataFrame:
    """Line number of every line in its file, without reading a file as a whole.

    Lines of one file split come in order, and a split knows its byte offset, so the number is
    the count of lines in earlier splits plus the place within the split. Should the second read
    of the files split them otherwise, the query fails instead of numbering wrongly.
    """
    placed = text.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_start"),
    )
    numbered = _number(placed, ["file_path"], ["_start"])
    return numbered.select("file_path", F.col("_seq").alias("seq"), "value")


def after_head(head: str, value: str = "value") -> Column:
    """What follows ``head`` (a column the value begins with) and one separator, byte by byte, so
    that broken text comes through."""
    rest = F.expr(f"substring(cast({value} AS binary), octet_length({head}) + 2)")
    return rest.cast("string")


def with_bundle_seq(text: DataFrame) -> DataFrame:
    """Lines ``<path><tab><line>`` of bundles, files that hold many texts each: the line and its
    number in the text of that path. The lines of a text stand together in one bundle."""
    placed = text.select(
        F.substring_index("value", "\t", 1).alias("file_path"), "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    ).withColumn("value", after_head("file_path"))
    numbered = _number(placed, ["file_path"], ["_file", "_start"])
    return numbered.select("file_path", F.col("_seq").alias("seq"), "value")


def number_files(text: DataFrame) -> DataFrame:
    """``seq, value``: the lines of all files numbered through, files by name."""
    placed = text.select(
        "value", F.lit(0).alias("_all"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )
    numbered = _number(placed, ["_all"], ["_file", "_start"])
    return numbered.select(F.col("_seq").alias("seq"), "value")


def _number(
    placed: DataFrame, keys: list[str], split: list[str], carried: DataFrame | None = None
) -> DataFrame:
    """``placed`` plus ``_seq``, the number of a line within ``keys``: splits follow each other by
    the ``split`` columns, the lines of a split as they are read. ``carried`` has ``_next``, the first
    number, of some keys."""
    rows = placed.withColumn("_id", F.monotonically_increasing_id())
    splits = rows.groupBy(*keys, *split).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("bigint")
    base = zero
    if carried is not None:
        splits, base = splits.join(carried, keys, "left"), F.coalesce("_next", zero)
    offsets = splits.select(
        *keys, *split, "_first", "_n",
        (base + F.coalesce(F.sum("_n").over(earlier), zero)).alias("_offset"),
    )
    place = F.col("_id") - F.col("_first")
    sound = F.when(place.between(F.lit(0), F.col("_n") - 1), place).otherwise(
        F.raise_error(F.lit("the files were split otherwise when read again")).cast("bigint")
    )
    return (
        rows.join(offsets, [*keys, *split])
        .withColumn("_seq", F.col("_offset") + sound)
        .drop("_id", "_first", "_n", "_offset")
    )


def explode_lines(df: DataFrame, text: str = "text", *, line_no: str = "line_no") -> DataFrame:
    """One row per line of a text column; a trailing newline adds no line."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n\z", "")
    others = [c for c in df.columns if c != text]
    return (
        df.where(F.col(text) != "")
        .select(*others, F.posexplode(F.split(body, "\n", -1)).alias(line_no, "line"))
        .withColumn("line", F.regexp_replace("line", r"\r\z", ""))
    )


def stream_lines(spark: SparkSession, path: str, *, max_files: int = 100) -> DataFrame:
    """Log lines arriving as Parquet files of the ``log_line`` schema."""
    return (
        spark.readStream.schema(LOG_LINE)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )


def follow_text(
    spark: SparkSession,
    path: str,
    source: str,
    device: str | Column,
    session: str | Column,
    out: str,
    *,
    line: Column | None = None,
    max_files: int = 100,
    every: int = 16,
):
    """Starts a stream that numbers the lines of arriving text files and stores them as log lines in
    ``out``, for :func:`stream_lines` and batch reads alike; drains what is there and stops.

    ``device`` and ``session`` may be Columns over ``file_path`` or, for files that hold many captures,
    over ``value``, with ``line`` for what of it is the line; the lines of a capture stand together in
    such a file. A capture may come as any number of files over
    any number of micro-batches of ``max_files``: what follows its last line so far is kept per
    session, files of one batch follow each other by modification time and name, and large files
    are read in splits. A batch that runs again gives the same numbers and replaces its rows.
    """
    raw = (
        spark.readStream.format("text").option("lineSep", "\n")
        .option("maxFilesPerTrigger", max_files).load(path)
    )

    def key(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    placed = raw.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("_at"),
        F.col("_metadata.file_block_start").alias("_start"),
    ).withColumns({"device_serial": key(device), "session_id": key(session)})
    if line is not None:
        placed = placed.withColumn("value", line)
    kinds = "device_serial string, session_id string, _next bigint"
    empty = spark.createDataFrame([], kinds)
    numbers = BatchStore(
        spark, f"{out}/_numbers",
        lambda rows: rows.groupBy(*SESSION).agg(F.max("_next").alias("_next")),
        empty.schema, every=every,
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        target = f"{out}/batch={batch_id}"
        numbered = _number(
            batch, list(SESSION), ["_at", "file_path", "_start"], numbers.read(before=batch_id)
        )
        numbered.select(
            *SESSION, F.col("_seq").alias("seq"), F.lit(source).alias("source"),
            F.unix_millis("_at").alias("received_at_ms"), clean_line(F.col("value")).alias("line"),
        ).write.mode("overwrite").parquet(target)
        stored = spark.read.schema(LOG_LINE).parquet(target)
        numbers.append(stored.groupBy(*SESSION).agg((F.max("seq") + 1).alias("_next")), batch_id)

    return (
        placed.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{out}/_state")
        .trigger(availableNow=True)
        .start()
    )


def stream_kafka(
    spark: SparkSession, servers: str, topic: str, source: str, *, max_offsets: int = 1_000_000
) -> DataFrame:
    """Log lines from Kafka: key ``device/session``, offset as capture order.

    Needs the Kafka package on the cluster; one session must stay in one topic partition.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )
    key = F.split(F.col("key").cast("string"), "/", 2)
    return raw.select(
        F.get(key, F.lit(0)).alias("device_serial"),
        F.get(key, F.lit(1)).alias("session_id"),
        F.col("offset").alias("seq"),
        F.lit(source).alias("source"),
        F.unix_millis("timestamp").alias("received_at_ms"),
        clean_line(F.col("value").cast("string")).alias("line"),
    )


def parse_records(lines: DataFrame, year: int | None = None) -> DataFrame:
    """Lines to records by source grammar: rows in = rows out, nothing is dropped.

    A chain of projections (no shuffle); each grammar only sees the lines still unparsed.
    ``year`` adds ``device_ts``.
    """
    line, source = F.col("line"), F.col("source")
    custom = R.registered_sources()
    open_ = ~source.isin(*custom) if custom else F.lit(True)
    orders = {k: v for k, v in R.BUILT_IN.items() if k not in custom}
    kernel = [k for k, v in orders.items() if v[0] in (R.DMESG, R.KMSG)]
    text_like = open_ & source.isin(*[k for k in orders if k not in kernel])
    out = R.THREADTIME.on(lines, F.when(text_like, line), "_tt")
    out = R.BRIEF.on(out, F.when(text_like & F.col("_tt").isNull(), line), "_br")
    first_kmsg = source == "kmsg"
    out = R.KMSG.on(out, F.when(open_ & first_kmsg, line), "_k1")
    missed = F.coalesce("_tt", "_br", "_k1").isNull()
    out = R.DMESG.on(
        out, F.when(open_ & missed & (source != "logcat") & source.isin(*orders), line), "_dm"
    )
    out = R.KMSG.on(
        out, F.when(open_ & (source == "dmesg") & F.col("_dm").isNull(), line), "_k2"
    )
    own = F.lit(None).cast(R.RECORD_TYPE)
    for kind, parser in custom.items():
        own = F.when(source == kind, parser(line).cast(R.RECORD_TYPE)).otherwise(own)
    out = out.withColumn("_r", F.coalesce(own, "_tt", "_br", "_k1", "_dm", "_k2"))
    parsed = F.col("_r").isNotNull()
    level = F.coalesce(F.col("_r.level"), F.lit("unknown"))
    known = set(RECORD_COLUMNS) | {"line"}
    extra = [c for c in lines.columns if c not in known]
    records = out.select(
        *SESSION, "seq", "source",
        level.alias("level"),
        "_r.timestamp", "_r.uptime_seconds", "_r.pid", "_r.tid", "_r.uid", "_r.tag",
        F.lit(None).cast("string").alias("package"),
        F.when(parsed, F.col("_r.message")).otherwise(line).alias("message"),
        line.alias("raw"),
        "received_at_ms",
        parsed.alias("parsed"),
        *extra,
    ).withColumn("level_rank", R.level_rank(F.col("level")))
    records = records.select(*RECORD_COLUMNS, *extra)
    if year is not None:
        records = records.withColumn(
            "device_ts", R.device_time(F.col("timestamp"), F.lit(year))
        )
    return records


def union_sessions(*records: DataFrame) -> DataFrame:
    """Records of several captures as one frame."""
    out = records[0]
    for more in records[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def non_blank(df: DataFrame, line: str = "line") -> DataFrame:
    return df.where(strip(F.col(line)) != "")
