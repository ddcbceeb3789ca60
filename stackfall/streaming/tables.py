"""Streams whose state is a table: micro-batches as joins and aggregates over what is stored.

No Python sees a row and no state is held in memory: a batch reads the little that earlier batches
left behind in a ``BatchStore``, and a hot device is as many tasks as its rows make.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import classify as C
from ..schema import SESSION
from ..sinks.store import BatchStore
from ..sources.lines import parse_records

_POLL = "device_serial string, poll_no bigint, line_no bigint, line string"


def _run(stream: DataFrame, store, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


# --- polls ------------------------------------------------------------------------------


def _last_polls(rows: DataFrame) -> DataFrame:
    """Distinct lines of the last poll of each device and of the one before; all other rows are left
    out before any is shuffled, by one row a device."""
    newest = rows.groupBy("device_serial").agg(F.max("poll_no").alias("_newest"))
    return (
        rows.select("device_serial", "poll_no", "line")
        .join(F.broadcast(newest), "device_serial")
        .where(F.col("poll_no") >= F.col("_newest") - 1)
        .drop("_newest")
        .distinct()
    )


def _poll_store(spark: SparkSession, path: str, every: int) -> BatchStore:
    schema = spark.createDataFrame([], "device_serial string, poll_no bigint, line string").schema
    return BatchStore(spark, f"{path}/tail", _last_polls, schema, every=every)


def follow_polls(
    polls: DataFrame, path: str, checkpoint: str, *, every: int = 16
) -> StreamingQuery:
    """Stores in ``path/rows`` the lines of a stream of polls that the poll before did not show.

    A repeated line of one poll stays repeated, a null line is always new. A poll may be spread over
    micro-batches; a row of a poll behind the last one seen comes out whole, with ``late``.
    """
    spark = polls.sparkSession
    tail = _poll_store(spark, path, every)
    batch_columns = ("device_serial", "poll_no", "line_no", "line")

    def store(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/rows/batch={batch_id}"
        before = tail.read(before=batch_id)
        seen = before.groupBy("device_serial").agg(F.max("poll_no").alias("_seen"))
        rows = batch.select(*batch_columns)
        rows = rows.join(F.broadcast(seen), "device_serial", "left").withColumn(
            "late", F.coalesce(F.col("poll_no") < F.col("_seen"), F.lit(False))
        ).drop("_seen")
        on_time = rows.where(~F.col("late")).select("device_serial", "poll_no", "line")
        shown = on_time.unionByName(before).select(
            "device_serial", (F.col("poll_no") + 1).alias("_poll"), "line"
        )
        # a late row has no poll that could have shown it
        fresh = rows.withColumn("_poll", F.when(~F.col("late"), F.col("poll_no"))).join(
            shown, ["device_serial", "_poll", "line"], "left_anti"
        ).select(*batch_columns, "late")
        fresh.write.mode("overwrite").parquet(target)
        tail.append(on_time.unionByName(before), batch_id)

    return _run(polls, store, checkpoint)


def read_polls(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"{_POLL}, late boolean").option("recursiveFileLookup", "true")
    return rows.parquet(f"{path}/rows")


# --- counters -----------------------------------------------------------------------------

_COUNTS = ("records", "unparsed", "binary", "late")


def _sum_counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SESSION).agg(
        *[F.sum(c).alias(c) for c in _COUNTS], F.max("last_seq").alias("last_seq")
    )


def _counter_store(spark: SparkSession, path: str, every: int = 16) -> BatchStore:
    kinds = ", ".join(f"{c} bigint" for c in (*_COUNTS, "last_seq"))
    schema = spark.createDataFrame([], f"device_serial string, session_id string, {kinds}").schema
    return BatchStore(spark, f"{path}/counters", _sum_counters, schema, every=every)


def follow_counters(
    lines: DataFrame, path: str, checkpoint: str, *, every: int = 16
) -> StreamingQuery:
    """Running counts per session of a stream of log lines: records, unparsed and binary ones, and
    those that came behind a line of an earlier micro-batch (``late``). Sessions that have ended cost
    a row in a table, nothing else."""
    spark = lines.sparkSession
    counters = _counter_store(spark, path, every)

    def store(batch: DataFrame, batch_id: int) -> None:
        before = counters.read(before=batch_id).select(*SESSION, F.col("last_seq").alias("_seen"))
        rows = parse_records(batch).select(*SESSION, "seq", "parsed", "raw")
        rows = rows.join(before, list(SESSION), "left")
        counters.append(
            rows.select(
                *SESSION, F.lit(1).cast("bigint").alias("records"),
                (~F.col("parsed")).cast("bigint").alias("unparsed"),
                C.is_binary_line(F.col("raw")).cast("bigint").alias("binary"),
                F.coalesce((F.col("seq") <= F.col("_seen")).cast("bigint"), F.lit(0)).alias("late"),
                F.col("seq").alias("last_seq"),
            ),
            batch_id,
        )

    return _run(lines, store, checkpoint)


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    return _counter_store(spark, path).read()
