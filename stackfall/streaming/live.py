"""Live captures as Structured Streaming: the batch operators over unbounded input.

Only what must remember rows keeps Python state, and only for rows that passed the tag gate; all
parsing stays in JVM expressions before and after it. ``seq`` orders rows, never arrival time:
rows of one batch are sorted by it and a row behind the last one seen comes out as a late row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import classify as C
from ..functions import crash as K
from ..functions import rules as FR
from ..functions.signals import parse_ams, parse_anomaly
from ..operators.views import with_crash_kind
from ..schema import SESSION
from ..session import scratch_path
from ..sinks.exports import read_events, write_events
from ..sources.lines import parse_records

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = "10 minutes"


def use_state_store(spark: SparkSession) -> None:
    """The stateful operators need a store with several state variables per key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def live_records(lines: DataFrame, rules: Iterable[FR.FilterRule] = ()) -> DataFrame:
    """Parse, filter and classify row by row: stateless, append mode. ``withinLast`` rules use
    the clock of each micro-batch."""
    records = parse_records(lines)
    return with_crash_kind(records.where(FR.compile_rules(rules)))


def live_counters(lines: DataFrame) -> DataFrame:
    """Running records, unparsed and binary counts per session (update mode)."""
    records = parse_records(lines)
    return records.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~F.col("parsed")).alias("unparsed"),
        F.count_if(C.is_binary_line(F.col("raw"))).alias("binary"),
        F.max("seq").alias("last_seq"),
    )


def crash_rate(lines: DataFrame, *, window: str = "1 minute") -> DataFrame:
    """Classified crash rows per device, family and tumbling window of receive time."""
    rows = with_crash_kind(parse_records(lines)).where(F.col("kind").isNotNull())
    stamped = rows.withColumn("received_ts", F.timestamp_millis("received_at_ms"))
    return (
        stamped.withWatermark("received_ts", WATERMARK)
        .groupBy(F.window("received_ts", window), "device_serial", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "device_serial", "kind", F.col("window.start").alias("window_start"), "n"
        )
    )


def activity_slices(lines: DataFrame, *, gap_ms: int = 30_000) -> DataFrame:
    """First and last receive time and number of lines per device and slice of ``gap_ms``.

    Two lines of one slice are never a pause apart, so a slice lies in one burst: what a device
    sends in it is summed up before the shuffle, and no task holds a device's lines.
    """
    stamped = lines.withColumn("received_ts", F.timestamp_millis("received_at_ms"))
    return (
        stamped.withWatermark("received_ts", WATERMARK)
        .groupBy("device_serial", F.window("received_ts", f"{int(gap_ms)} milliseconds"))
        .agg(
            F.min("received_at_ms").alias("from_ms"),
            F.max("received_at_ms").alias("to_ms"),
            F.count(F.lit(1)).alias("n"),
        )
        .select("device_serial", F.col("window.start").alias("slice"), "from_ms", "to_ms", "n")
    )


def merge_slices(slices: DataFrame, *, gap_ms: int = 30_000) -> DataFrame:
    """Bursts of log activity per device, closed by a pause of ``gap_ms``, out of stored slices
    (one row per device and slice)."""
    along = Window.partitionBy("device_serial").orderBy("slice")
    pause = F.col("from_ms") - F.lag("to_ms").over(along)
    bursts = slices.withColumn("_new", F.when(pause < gap_ms, 0).otherwise(1))
    bursts = bursts.withColumn("_burst", F.sum("_new").over(along))
    return bursts.groupBy("device_serial", "_burst").agg(
        F.min("from_ms").alias("from_ms"), (F.max("to_ms") + gap_ms).alias("to_ms"), F.sum("n").alias("n")
    ).drop("_burst")


# --- growing crash blocks ---------------------------------------------------------------

_WATCH_OUT = (
    "device_serial string, session_id string, seq bigint, role string, start_seq bigint, "
    "line_no bigint, frame_no bigint, tag string, message string, package string, pid int"
)


class _BlockWatch(StatefulProcessor):
    """Keeps where the open block of one session began and how long it is; every line comes out once.

    Roles of the rows: ``line`` of a block, ``loose`` line outside, ``late`` line behind lines already
    read, ``closed`` for a block that has ended.
    """

    def __init__(self, idle_ms: int | None):
        self._idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "start bigint, lines bigint, frames bigint")
        self._seen = handle.getValueState("seen", "last_seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(list(rows), "seq")
        seq = batch["seq"]
        (last,) = self._seen.get() or (-1,)
        carried = self._open.get()
        late = seq <= last
        late[1:] |= seq[1:] == seq[:-1]
        out = []
        if late.any():
            out.append(self._rows({n: v[late] for n, v in batch.items()}, "late"))
            batch = {n: v[~late] for n, v in batch.items()}
        open_ = carried
        if not late.all():
            open_, placed = self._place(batch, carried)
            out += placed
            self._seen.update((int(batch["seq"][-1]),))
            if open_ is not None:
                self._open.update(open_)
            elif carried is not None:
                self._open.clear()
        if self._idle_ms is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            if open_ is not None:
                now = timerValues.getCurrentProcessingTimeInMs()
                self._handle.registerTimer(now + self._idle_ms)
        yield self._frame(key, out)

    def _place(self, batch: dict[str, np.ndarray], carried):
        """The state afterwards, and the rows of a batch that follows the carried block."""
        seq = batch["seq"]
        starts = batch["starts"].astype(bool)
        breaks = ~starts & ~batch["extends"].astype(bool)
        is_frame = batch["is_frame"].astype(bool)
        frames = is_frame.cumsum()
        place = np.arange(len(seq))
        opened = np.maximum.accumulate(np.where(starts, place, -1))
        broken = np.maximum.accumulate(np.where(breaks, place, -1))
        begin, lines, n_frames = carried or (-1, 0, 0)
        here = np.maximum(opened, 0)
        start_seq = np.where(opened >= 0, seq[here], begin)
        line_no = np.where(opened >= 0, place - here, place + lines)
        before = frames - is_frame  # frames ahead of each row
        frame_no = np.where(opened >= 0, before - before[here], before + n_frames)
        inside = (opened > broken) | ((opened < 0) & (broken < 0) & (carried is not None))
        out = [self._rows(batch, np.where(inside, "line", "loose"), start_seq, line_no, frame_no, ~inside)]
        began = set(seq[starts].tolist()) | ({begin} if carried is not None else set())
        open_ = None
        if inside[-1]:
            open_ = (int(start_seq[-1]), int(line_no[-1]) + 1, int(frame_no[-1]) + int(is_frame[-1]))
            began.discard(open_[0])
        if began:
            out.append(self._closed(sorted(began)))
        return open_, out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """An idle session ends its open block."""
        if self._open.exists():
            start, _, _ = self._open.get()
            self._open.clear()
            yield self._frame(key, [self._closed([start])])

    def close(self) -> None:
        pass

    @classmethod
    def _closed(cls, starts: list[int]) -> dict[str, np.ndarray]:
        at = np.array(starts, np.int64)
        nothing = np.full(len(at), None, object)
        rows = {"seq": at, **dict.fromkeys(("tag", "message", "package", "pid"), nothing)}
        return cls._rows(rows, "closed", at)

    @staticmethod
    def _rows(batch, role, start=None, line=None, frame=None, unset=None) -> dict[str, np.ndarray]:
        """Columns of the result; a number that is not given or ``unset`` is null."""
        n = len(batch["seq"])
        out = {c: batch[c] for c in ("seq", "tag", "message", "package", "pid")}
        out["role"] = np.full(n, role, object) if isinstance(role, str) else role.astype(object)
        for name, value in (("start_seq", start), ("line_no", line), ("frame_no", frame)):
            out[name] = np.zeros(n, np.int64) if value is None else value
            out[name + "_null"] = np.full(n, value is None) if value is None or unset is None else unset
        return out

    @staticmethod
    def _frame(key, parts: list[dict[str, np.ndarray]]) -> pd.DataFrame:
        """One frame a call: every frame that is handed over costs more than its rows."""
        col = lambda name: np.concatenate([p[name] for p in parts])
        number = lambda name: pd.arrays.IntegerArray(col(name).astype(np.int64), col(name + "_null"))
        return pd.DataFrame(
            {
                "device_serial": key[0], "session_id": key[1],
                "seq": col("seq").astype(np.int64), "role": col("role"),
                "start_seq": number("start_seq"), "line_no": number("line_no"), "frame_no": number("frame_no"),
                "tag": col("tag"), "message": col("message"), "package": col("package"),
                "pid": pd.array(np.concatenate([p["pid"].astype(object) for p in parts]), "Int32"),
            }
        )


def _in_order(frames: list[pd.DataFrame], order: str) -> dict[str, np.ndarray]:
    """The columns of some frames, rows sorted by one of them."""
    batch = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    rows = np.argsort(batch[order].to_numpy(), kind="stable")
    return {name: batch[name].to_numpy()[rows] for name in batch.columns}


def live_watch(lines: DataFrame, *, idle_ms: int | None = None) -> DataFrame:
    """Live crash lines, signals and anomalies as they come; ``exports.write_events`` stores them and
    ``exports.read_events`` gives the events.

    Rows of type ``crash`` are the lines of a block, each once however long it grows, under
    the block's one ``event_id``; a row of type ``closed`` ends a block that another line followed or,
    with ``idle_ms``, that was left alone for that long. A line behind lines already read cannot
    change a block any more: it comes out as type ``late`` with its text in ``detail``.
    """
    records = parse_records(lines)
    body = F.col("message")
    gated = records.where(C.is_interesting_tag(F.col("tag"))).select(
        *SESSION, "seq", "tag", "message", "package", "pid",
        K.starts_block(body).alias("starts"),
        K.continues_block(body).alias("extends"),
        K.is_frame(body).alias("is_frame"),
    )
    placed = gated.groupBy(*SESSION).transformWithStateInPandas(
        statefulProcessor=_BlockWatch(idle_ms),
        outputStructType=_WATCH_OUT,
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
    role = F.col("role")
    text = F.concat_ws(": ", "tag", "message")
    loose = F.when(role == "loose", text)
    parsed = placed.withColumns({"ams": parse_ams(loose), "anomaly": parse_anomaly(loose)})
    own = {"process": F.col("package"), "pid": F.col("pid")}
    types = {"kind": "string", "process": "string", "pid": "int", "detail": "string"}

    def event(type_: str, when: Column, event_id: Column, fields: dict[str, Column]) -> Column:
        values = [fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]
        return F.when(when, F.struct(F.lit(type_).alias("type"), event_id.alias("event_id"), *values))

    def signal(type_: str) -> Column:
        held = F.col(type_)
        by_kind = F.concat(held.getField("kind"), F.lit("#"), F.col("seq"))
        return event(type_, held.isNotNull(), by_kind, {n: held.getField(n) for n in types})

    of_block = F.concat(F.lit("crashBuffer#"), F.col("start_seq"))
    each = F.filter(
        F.array(
            event("crash", role == "line", of_block, own),
            event("closed", role == "closed", of_block, {}),
            event("late", role == "late", F.concat(F.lit("late#"), F.col("seq")), own | {"detail": text}),
            signal("ams"),
            signal("anomaly"),
        ),
        lambda e: e.isNotNull(),
    )
    return parsed.withColumn("_e", F.explode(each)).select(
        *SESSION, "_e.event_id", "_e.type", "seq", "_e.kind", "_e.process", "_e.pid", "_e.detail",
        "line_no", "frame_no", F.when(role == "line", F.col("message")).alias("line"),
    )


# --- polls -----------------------------------------------------------------------------


#: Rows of polls handed over at once.
_POLL_ROWS = 20_000


class _PollTail(StatefulProcessor):
    """Distinct lines of the poll before and of the poll being read, per device."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._tail = handle.getValueState(
            "tail", "poll bigint, before array<string>, current array<string>"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # lines as Arrow text, about the bytes they have, and no copy sorted by poll
        numbers, texts = [], []
        for part in rows:
            numbers.append(part[["poll_no", "line_no"]])
            texts.append(pa.array(part["line"], pa.large_string(), from_pandas=True))
        batch = pd.concat(numbers, ignore_index=True)
        del numbers
        # rows without a number belong to no poll
        order = batch.sort_values(["poll_no", "line_no"])[["poll_no"]].dropna()
        polls, order = order["poll_no"].to_numpy().astype(np.int64), order.index.to_numpy()
        poll, before, current = self._tail.get() or (-1, [], [])
        late = polls < poll
        # all lines as numbers: those of the rows, then those of the two polls that are kept
        texts += [pa.array(lines, pa.large_string()) for lines in (before, current)]
        texts = pa.concat_arrays(texts)
        coded = texts.dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        own, old = code[order], code[len(batch) :]
        taken = ~late & (own >= 0)
        # what each poll shows, a null line never
        number = np.concatenate((polls[taken], np.repeat([poll - 1, poll], [len(before), len(current)])))
        line = np.concatenate((own[taken], old))
        known = np.unique(number)
        place = lambda n: np.minimum(np.searchsorted(known, n), max(len(known) - 1, 0))
        width = len(coded.dictionary) + 1
        keep = late | (own < 0)
        if len(known):
            at = place(polls - 1)
            seen = np.isin(at * width + own, place(number) * width + line) & (known[at] == polls - 1)
            keep |= ~seen
        else:
            keep[:] = True
        if len(polls):
            poll = max(poll, int(polls[-1]))
        self._tail.update(
            (
                int(poll),
                *(
                    coded.dictionary.take(pa.array(np.unique(line[number == n]))).to_pylist()
                    for n in (poll - 1, poll)
                ),
            )
        )
        order, late = order[keep], late[keep]
        for lo in range(0, len(order), _POLL_ROWS):
            at = order[lo : lo + _POLL_ROWS]
            yield pd.DataFrame(
                {
                    "device_serial": key[0],
                    "poll_no": batch["poll_no"].to_numpy()[at].astype(np.int64),
                    "line_no": pd.array(batch["line_no"].to_numpy()[at], "Int64"),
                    "line": texts.take(pa.array(at)).to_pandas().to_numpy(),
                    "late": late[lo : lo + _POLL_ROWS],
                }
            )

    def close(self) -> None:
        pass


def live_polls(polls: DataFrame) -> DataFrame:
    """Unseen lines of a stream of polls (device_serial, poll_no, line_no, line).

    A poll that arrives after a later one comes out whole, with ``late``.
    """
    rows = polls.select("device_serial", "poll_no", "line_no", "line")
    return rows.groupBy("device_serial").transformWithStateInPandas(
        statefulProcessor=_PollTail(),
        outputStructType=(
            "device_serial string, poll_no bigint, line_no bigint, line string, late boolean"
        ),
        outputMode="Append",
        timeMode="None",
    )


# --- launches ---------------------------------------------------------------------------


class _Launches(StatefulProcessor):
    """Pids of one followed application at its last poll."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "at bigint, pids array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("polled_at_ms")
        at, pids = self._last.get() if self._last.exists() else (-1, [])
        pids = list(pids)
        out = []
        for row in batch.itertuples(index=False):
            now = [int(p) for p in row.pids]
            if row.polled_at_ms <= at:
                out.append((*key, int(row.polled_at_ms), now, "late"))
                continue
            edge = None
            if now and not pids:
                edge = "start"
            elif pids and not now:
                edge = "stop"
            elif now != pids:
                edge = "restart"
            at, pids = int(row.polled_at_ms), now
            if edge is not None:
                out.append((*key, at, now, edge))
        self._last.update((int(at), pids))
        if out:
            yield pd.DataFrame(
                out, columns=["device_serial", "package", "polled_at_ms", "pids", "edge"]
            )

    def close(self) -> None:
        pass


def live_launches(states: DataFrame) -> DataFrame:
    """Start, stop and restart edges out of a stream of (device, package) process states; a state
    behind the last one seen comes out with the edge ``late``."""
    return states.groupBy("device_serial", "package").transformWithStateInPandas(
        statefulProcessor=_Launches(),
        outputStructType=(
            "device_serial string, package string, polled_at_ms bigint, pids array<int>, "
            "edge string"
        ),
        outputMode="Append",
        timeMode="None",
    )


def run_until_idle(stream: DataFrame, path: str, checkpoint: str, *, idle_ms: int) -> None:
    """Store a ``live_watch`` with an idle time until all that is there is read and every block has
    ended: timers only run out while batches go on, so this polls for as long as they may need."""
    query = write_events(stream, path, checkpoint, batch_ms=max(250, idle_ms // 2))
    try:
        while not _quiet(query):
            query.awaitTermination(1)
        settled = read_events(stream.sparkSession, path).where(~F.col("complete"))
        while query.isActive and not settled.isEmpty():
            query.awaitTermination(idle_ms / 1000)
            settled = read_events(stream.sparkSession, path).where(~F.col("complete"))
        for _ in range(100):  # better stopped between two batches
            if not (query.isActive and query.status["isTriggerActive"]):
                break
            query.awaitTermination(0.05)
    finally:
        query.stop()


def _quiet(query) -> bool:
    """All files seen so far are read: the last batch found nothing new."""
    if not query.isActive:
        raise RuntimeError(f"the stream ended: {query.exception()}")
    progress = query.recentProgress
    return len(progress) > 1 and progress[-1].numInputRows == 0 and any(p.numInputRows for p in progress)


def drain(stream: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there and return the written rows.

    Rows land in the shared folder, in one directory per batch, with ``batch_id``.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode(
            "overwrite"
        ).parquet(f"{base}/rows/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(store)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/rows")
