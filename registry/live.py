"""Queries that run the streaming operators over the driver tables until they are drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackfall.functions import rules as FR
from stackfall.operators import views as V
from stackfall.session import cut, folders, scratch_path
from stackfall.sinks import exports as X
from stackfall.sources import lines as LN
from stackfall.streaming import live as S
from stackfall.streaming import tables as ST

from .common import KEYS, lines, of, scene_sql, sql
from .scenes import duck_sql
from .devices import _STATE, states
from .records import _KINDS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: The input is replayed in this many files, three per micro-batch.
FILES = 6


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


#: Most rows of a slice for a query whose tasks look at what a micro-batch brings for a device.
SLICE_ROWS = 1_000_000


#: Rows that a task writes at least, where more than two write a slice.
TASK_ROWS = 100_000


def replay(
    df, order: str, *keys: str, slices: int = FILES, files: int = 3, most: int | None = None, spread: bool = False
):
    """``df`` as a stream that arrives in slices of ``order``, ``files`` files per micro-batch.

    Slices are written one after the other, so that file times follow them; within a slice the
    rows of a key share one file, so that a key's rows arrive in order wherever a batch ends. With ``most``
    there are as many slices as keep one to about that many rows. With ``spread`` every slice is one
    micro-batch of as many files as it takes tasks to write it, if all slices are large enough for that;
    a key's rows then lie in many files of it.
    """
    spark = df.sparkSession
    S.use_state_store(spark)
    stored = cut(df, "replay")
    low, high, n = stored.agg(F.min(order), F.max(order), F.count(order)).first()
    if most is not None:
        slices = max(slices, -(-n // most))
    step = (high - low) // slices + 1
    if most is not None:  # many slices are dealt once, not read again for each
        dealt = scratch_path(spark, "dealt")
        number = F.expr(f"({order} - {low}L) div {step}L")
        stored.where(F.col(order).isNotNull()).withColumn("_slice", number).repartition(
            "_slice", *keys
        ).write.partitionBy("_slice").parquet(dealt)
    path = scratch_path(spark, "slices")
    tasks = 2
    if spread:
        number = F.expr(f"({order} - {low}L) div {step}L")
        sizes = [r["count"] for r in stored.where(F.col(order).isNotNull()).groupBy(number).count().collect()]
        if len(sizes) == slices and min(sizes) >= 3 * TASK_ROWS:
            tasks = files = min(spark.sparkContext.defaultParallelism, min(sizes) // TASK_ROWS)
    for i in range(slices):
        lo = low + i * step
        if most is None:
            part = stored.where((F.col(order) >= lo) & (F.col(order) < lo + step))
        elif f"_slice={i}" in folders(spark, dealt):
            part = spark.read.schema(df.schema).parquet(f"{dealt}/_slice={i}")
        else:
            continue
        # dealt in turn, each of so many rows lands in every file; else a key's rows share one
        part = part.repartition(tasks) if tasks > 2 else part.repartition(2, *keys)
        part.write.parquet(f"{path}/{i}")
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files)
        .option("latestFirst", False).parquet(f"{path}/*")
    )


@query("live_records", sql("rec", f"SELECT device_serial, session_id, seq, level, kind FROM ({_KINDS}) WHERE level_rank >= 3"))
def _(spark, sf):
    stream = replay(lines(spark, sf), "seq", *KEYS)
    out = S.drain(S.live_records(stream, [FR.min_level("warn")]), "live")
    return out.select(*KEYS, "seq", "level", "kind")


@query("live_counters", sql("rec", "SELECT device_serial, session_id, count(*) AS records, count(*) FILTER (NOT parsed) AS unparsed, max(seq) AS last_seq FROM rec GROUP BY ALL"))
def _(spark, sf):
    updates = S.drain(S.live_counters(replay(lines(spark, sf), "seq", *KEYS)), "counters", mode="update")
    newest = updates.groupBy(*KEYS).agg(F.max_by(F.struct("records", "unparsed", "last_seq"), "batch_id").alias("c"))
    return newest.select(*KEYS, "c.*")


_EVENT = "device_serial, session_id, event_id, true AS complete, n_lines, n_frames, process, pid, thread, kind, exception, message"


def _crashes(spark, path):
    out = X.read_events(spark, path).where(F.col("type") == "crash")
    return out.select(
        *KEYS, "event_id", "complete", "n_lines", "n_frames", "process", "pid", "thread", "kind", "exception", "message"
    )


@query("live_watch", sql("live_events", f"SELECT {_EVENT} FROM evt"))
def _(spark, sf):
    """Growing blocks over a replay settle to what the batch operator finds."""
    base = scratch_path(spark, "watch")
    stream = S.live_watch(replay(lines(spark, sf), "seq", *KEYS))
    X.write_events(stream, base, base + "/state", every=2).awaitTermination()
    return _crashes(spark, base)


@query("live_lines", sql("live", "SELECT device_serial, session_id, seq, start_seq, message AS line FROM lrow WHERE start_seq IS NOT NULL"))
def _(spark, sf):
    """The stored lines of live blocks: each once, however many batches a block grows in."""
    base = scratch_path(spark, "watch")
    stream = S.live_watch(replay(lines(spark, sf), "seq", *KEYS, slices=4, files=2))
    X.write_events(stream, base, base + "/state", every=2).awaitTermination()
    return X.read_event_lines(spark, base).select(*KEYS, "seq", "start_seq", "line")


#: Sessions whose capture ends inside the block of their last scene.
_BROKEN_OFF = "seq % 250 <= 228"


@query("idle_flush", sql("live_events", f"SELECT {_EVENT} FROM evt").replace(duck_sql("lines"), f"SELECT * FROM ({duck_sql('lines')}) WHERE {_BROKEN_OFF}"))
def _(spark, sf):
    """Blocks that nothing follows are closed by the idle timer."""
    base = scratch_path(spark, "idle")
    broken = lines(spark, sf).where(_BROKEN_OFF)
    stream = S.live_watch(replay(broken, "seq", *KEYS, slices=2, files=2), idle_ms=2000)
    S.run_until_idle(stream, base, base + "/state", idle_ms=2000)
    return _crashes(spark, base)


def late_arrivals(spark, sf):
    """All lines in three slices of one file and micro-batch each, every 89th line one slice late."""
    all_lines = cut(lines(spark, sf), "late")
    step = all_lines.agg(F.max("seq")).first()[0] // 3 + 1
    arrival = F.expr(f"seq div {step}") + F.when(F.col("seq") % 89 == 0, 1).otherwise(0)
    path = scratch_path(spark, "arrivals")
    for i in range(4):
        all_lines.where(arrival == i).repartition(1).write.parquet(f"{path}/{i}")
    S.use_state_store(spark)
    return spark.readStream.schema(all_lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


#: The slice in which a line arrives.
_ARRIVES = "seq // w.step + CASE WHEN seq % 89 = 0 THEN 1 ELSE 0 END"


@query("late_lines", sql("live", f"""SELECT r.device_serial, r.session_id, count(*) AS n, min(r.seq) AS first_seq, max(r.seq) AS last_seq FROM (SELECT v0.*, {_ARRIVES} AS slice FROM v0, w) r
SEMI JOIN (SELECT v0.*, {_ARRIVES} AS slice FROM v0, w) o ON o.device_serial = r.device_serial AND o.session_id = r.session_id AND o.slice < r.slice AND o.seq > r.seq GROUP BY ALL""").replace("\nSELECT r.device", ",\nw AS (SELECT max(seq) // 3 + 1 AS step FROM lines)\nSELECT r.device"))
def _(spark, sf):
    """Lines behind lines already read, counted per session."""
    stream = late_arrivals(spark, sf)
    base = scratch_path(spark, "late")
    X.write_events(S.live_watch(stream), base, base + "/state").awaitTermination()
    late = X.read_events(spark, base).where(F.col("type") == "late")
    return late.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


@query("stream_text", sql("lines", """SELECT device_serial, session_id, row_number() OVER (PARTITION BY device_serial, session_id ORDER BY seq) - 1 AS seq,
  line || CASE WHEN seq % 5 = 0 THEN chr(65533) ELSE '' END AS line FROM lines"""))
def _(spark, sf):
    """Captures that arrive as text files, several a session, with carriage returns and broken bytes."""
    path = scratch_path(spark, "texts")
    broken = F.when(F.col("seq") % 5 == 0, F.unhex(F.lit("FF")).cast("string")).otherwise("")
    ending = F.when(F.col("seq") % 3 == 0, "\r").otherwise("")
    # files of many sessions: every line names its own; a text file holds a null as an empty line
    text = F.coalesce(F.concat("line", broken, ending), F.lit(""))
    texts = lines(spark, sf).select(
        *KEYS, "seq", F.concat(*[F.concat(F.col(k), F.lit("\t")) for k in KEYS], text).alias("value")
    )
    stored = cut(texts, "texts")
    for i in range(3):
        part = stored.where(F.expr("seq % 250 div 90") == i)
        ordered = part.repartition(8, *KEYS).sortWithinPartitions(*KEYS, "seq")
        ordered.select("value").write.text(f"{path}/{i}")
    head = F.substring_index("value", "\t", 2)
    device, session = F.substring_index("value", "\t", 1), F.substring_index(head, "\t", -1)
    out = scratch_path(spark, "numbered")
    LN.follow_text(
        spark, f"{path}/*", "logcat", device, session, out,
        line=LN.after_head("substring_index(value, '\t', 2)"), max_files=8,
    ).awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").select(*KEYS, "seq", "line")


@query("live_polls", scene_sql("polls", "SELECT p.device_serial, p.poll_no, p.line_no, p.line FROM polls p WHERE NOT EXISTS (SELECT 1 FROM polls q WHERE q.device_serial = p.device_serial AND q.poll_no = p.poll_no - 1 AND q.line = p.line)"))
def _(spark, sf):
    out = S.drain(S.live_polls(replay(of(spark, sf, "polls"), "poll_no", "device_serial", most=SLICE_ROWS)), "polls")
    return out.where("not late").drop("batch_id", "late")


@query("followed_polls", scene_sql("polls", "SELECT p.device_serial, p.poll_no, p.line_no, p.line FROM polls p WHERE NOT EXISTS (SELECT 1 FROM polls q WHERE q.device_serial = p.device_serial AND q.poll_no = p.poll_no - 1 AND q.line = p.line)"))
def _(spark, sf):
    """The same lines by joins with the polls stored before."""
    base = scratch_path(spark, "polls")
    stream = replay(of(spark, sf, "polls"), "poll_no", "device_serial", files=2, spread=True)
    ST.follow_polls(stream, base, base + "/state", every=3).awaitTermination()
    return ST.read_polls(spark, base).where("not late").drop("late")


#: Every 89th line arrives one slice of three late; a slice is a micro-batch.
@query("followed_counters", sql("rec", f"""SELECT r.device_serial, r.session_id, count(*) AS records, count(*) FILTER (NOT r.parsed) AS unparsed, max(r.seq) AS last_seq,
  count(*) FILTER (EXISTS (SELECT 1 FROM (SELECT rec.*, {_ARRIVES} AS slice FROM rec, w) o WHERE o.device_serial = r.device_serial AND o.session_id = r.session_id AND o.slice < r.slice AND o.seq > r.seq)) AS late
  FROM (SELECT rec.*, {_ARRIVES} AS slice FROM rec, w) r GROUP BY ALL""").replace("\nSELECT r.device", ",\nw AS (SELECT max(seq) // 3 + 1 AS step FROM lines)\nSELECT r.device"))
def _(spark, sf):
    """Counts per session, late lines included, as sums of what each micro-batch adds."""
    base = scratch_path(spark, "counters")
    stream = late_arrivals(spark, sf)
    ST.follow_counters(stream, base, base + "/state", every=2).awaitTermination()
    return ST.read_counters(spark, base).drop("binary")


@query("live_launches", scene_sql("states", "SELECT 1").replace("\nSELECT 1", ",\n" + _STATE + "\nSELECT device_serial, package, polled_at_ms, CASE WHEN was = '' THEN 'start' WHEN now = '' THEN 'stop' ELSE 'restart' END AS edge FROM sl WHERE now <> was"))
def _(spark, sf):
    stream = replay(states(spark, sf), "polled_at_ms", "device_serial", "package")
    return S.drain(S.live_launches(stream), "launches").select("device_serial", "package", "polled_at_ms", "edge")


@query("crash_rate", sql("rec", f"SELECT device_serial, kind, date_trunc('minute', make_timestamp(received_at_ms * 1000)) AS window_start, count(*) AS n FROM ({_KINDS}) WHERE kind IS NOT NULL GROUP BY ALL").replace("SELECT device_serial, kind, date_trunc('minute', make_timestamp(received_at_ms * 1000)) AS window_start", "SELECT device_serial, kind, (received_at_ms // 60000) * 60000 AS window_ms"))
def _(spark, sf):
    updates = S.drain(S.crash_rate(replay(lines(spark, sf), "seq", *KEYS)), "rate", mode="update")
    newest = updates.groupBy("device_serial", "kind", "window_start").agg(F.max_by("n", "batch_id").alias("n"))
    return newest.select("device_serial", "kind", F.unix_millis("window_start").alias("window_ms"), "n")


@query("activity_sessions", sql("rec", """SELECT device_serial, min(received_at_ms) AS from_ms, max(received_at_ms) + 30000 AS to_ms, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY device_serial ORDER BY received_at_ms, seq ROWS UNBOUNDED PRECEDING) AS burst FROM (
  SELECT *, CASE WHEN received_at_ms - lag(received_at_ms) OVER (PARTITION BY device_serial ORDER BY received_at_ms, seq) < 30000 THEN 0 ELSE 1 END AS fresh FROM rec)) GROUP BY device_serial, burst"""))
def _(spark, sf):
    """Bursts of activity: slices summed up as a stream, merged over their pauses afterwards."""
    updates = S.drain(S.activity_slices(replay(lines(spark, sf), "seq", *KEYS)), "bursts", mode="update")
    newest = updates.groupBy("device_serial", "slice").agg(
        F.max_by(F.struct("from_ms", "to_ms", "n"), "batch_id").alias("s")
    )
    return S.merge_slices(newest.select("device_serial", "slice", "s.*"))


@query("stored_stream", sql("rec", "SELECT device_serial, session_id, seq FROM rec"))
def _(spark, sf):
    """Records appended by the live sink."""
    base = scratch_path(spark, "sink")
    started = X.write_live(S.live_records(replay(lines(spark, sf), "seq", *KEYS)), base + "/rows", base + "/state")
    started.awaitTermination()
    return spark.read.parquet(base + "/rows").select(*KEYS, "seq")


@query("stream_lines", sql("lines", "SELECT device_serial, session_id, seq, source, received_at_ms, line FROM lines"))
def _(spark, sf):
    S.use_state_store(spark)
    path = scratch_path(spark, "lines")
    lines(spark, sf).write.parquet(path)
    return S.drain(LN.stream_lines(spark, path, max_files=2), "lines").drop("batch_id")


@query("live_settled", sql(("live", "sig", "anomaly"), """SELECT r.device_serial, r.session_id, s.kind AS kind, s.seq, s.process, s.pid FROM lrow r JOIN (SELECT seq, kind, process, pid FROM sig UNION ALL SELECT seq, kind, process, pid FROM anomaly) s ON s.seq = r.seq WHERE r.start_seq IS NULL"""))
def _(spark, sf):
    """Signals and anomalies of the live watch, newest state per id."""
    updates = S.drain(S.live_watch(replay(lines(spark, sf), "seq", *KEYS)), "watch")
    settled = V.settle(updates, version="batch_id")
    return settled.where(F.col("type").isin("ams", "anomaly")).select(*KEYS, "kind", "seq", "process", "pid")
