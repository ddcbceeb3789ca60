"""Streams whose state grows: stores of partial states, numbered text, growing blocks."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stackfall.operators import blocks as B
from stackfall.session import folders
from stackfall.sinks import exports as X
from stackfall.sinks.store import BatchStore
from stackfall.sources import lines as LN
from stackfall.streaming import live as S
from stackfall.streaming import tables as ST

LINE = "device_serial string, session_id string, seq bigint, source string, received_at_ms bigint, line string"
STAMP = "09-30 12:00:00.123  7  7 E "


@pytest.mark.parametrize("every", [1, 3, 100])
def test_store_equals_one_merge(spark, tmp_path, every):
    schema = spark.createDataFrame([], "k int, n bigint, done boolean").schema

    def merge(rows):
        return rows.groupBy("k").agg(F.sum("n").alias("n"), F.bool_or("done").alias("done"))

    def store():
        return BatchStore(spark, str(tmp_path / "s"), merge, schema, final=F.col("done"), every=every)

    r, wanted = random.Random(3), {}
    closed = set()
    for batch in range(8):
        rows = [(k, r.randint(1, 9), r.random() < 0.2) for k in r.sample(range(40), 12) if k not in closed]
        df = spark.createDataFrame(rows, schema)
        store().append(df, batch)
        if batch in (2, 5):
            store().append(df, batch)  # the same batch again
        for k, n, done in rows:
            had = wanted.get(k, (0, False))
            wanted[k] = (had[0] + n, had[1] or done)
            if done:
                closed.add(k)
        assert {x.k: (x.n, x.done) for x in store().read().collect()} == wanted
    if every == 3:  # the deltas behind the last but one table are gone
        assert folders(spark, str(tmp_path / "s/delta"))[0] == f"{3:012d}"
    before = {x.k: x.n for x in store().read(before=7).collect()}
    assert sum(before.values()) < sum(n for n, _ in wanted.values())


def write(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_bytes(text)
    time.sleep(0.02)


def test_text_stream_numbers_over_files_and_batches(spark, tmp_path):
    source, wanted = tmp_path / "in", {"a": [], "b": []}
    for part in range(5):
        for name in "ab":
            lines = [f"{name}{part} {i}" for i in range(300 if name == "a" else 3)]
            data = "".join(x + "\r\n" for x in lines).encode()
            if part == 2:
                data, lines = data + b"br\xffken", [*lines, "br�ken"]
            write(source, f"{name}.{part}.txt", data)
            wanted[name] += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    session = F.regexp_extract("file_path", r"([ab])\.\d+\.txt$", 1)
    out = str(tmp_path / "out")
    try:
        LN.follow_text(spark, str(source), "logcat", "d", session, out, max_files=3, every=2).awaitTermination()
        write(source, "a.9.txt", b"more\n\nlast")
        LN.follow_text(spark, str(source), "logcat", "d", session, out, max_files=3, every=2).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted["a"] += ["more", "", "last"]
    stored = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    assert stored.select("batch").distinct().count() == 5
    for name, lines in wanted.items():
        rows = stored.where(F.col("session_id") == name).orderBy("seq").collect()
        assert [x.seq for x in rows] == list(range(len(lines)))
        assert [x.line for x in rows] == lines


def test_text_stream_of_files_with_many_captures(spark, tmp_path):
    source, wanted = tmp_path / "in", {}
    for part in range(3):
        data = b""
        for name in "abc":
            lines = [f"{name}{part}\t{i}" for i in range({"a": 200, "b": 3, "c": part}[name])]
            data += "".join(f"d\t{name}\t{x}\r\n" for x in lines).encode()
            wanted.setdefault(name, []).extend(lines)
        write(source, f"{part}.txt", data + b"d\tz\tbr\xffken \xe9\n")
    wanted["z"] = ["br\ufffdken \ufffd"] * 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    session = F.substring_index(F.substring_index("value", "\t", 2), "\t", -1)
    line = LN.after_head("substring_index(value, '\t', 2)")
    out = str(tmp_path / "out")
    try:
        LN.follow_text(
            spark, str(source), "logcat", F.substring_index("value", "\t", 1), session, out, line=line, max_files=2
        ).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    stored = spark.read.option("basePath", out).parquet(f"{out}/batch=*").where("device_serial = 'd'")
    for name, lines in wanted.items():
        rows = stored.where(F.col("session_id") == name).orderBy("seq").collect()
        assert [(x.seq, x.line) for x in rows] == list(enumerate(lines))


def slices(spark, path, lines, size):
    for lo in range(0, lines.count(), size):
        part = lines.where((F.col("seq") >= lo) & (F.col("seq") < lo + size))
        part.repartition(2).write.mode("append").parquet(f"{path}/{lo:06d}")
        time.sleep(0.02)


def test_growing_block_writes_each_line_once(spark, tmp_path):
    S.use_state_store(spark)
    body = ["AndroidRuntime: FATAL EXCEPTION: main", "AndroidRuntime: Process: com.a, PID: 7", "AndroidRuntime: java.lang.X: y"]
    body += [f"AndroidRuntime: \tat a.b{i}(C.java:1)" for i in range(400)]
    body += ["AndroidRuntime: Caused by: java.lang.Y: z", "Chat: hi", "ActivityManager: Killing 9:com.v/u0a1 (adj 0): crash", "AndroidRuntime: \tat late.b(C.java:1)"]
    body += ["AndroidRuntime: FATAL EXCEPTION: other", "AndroidRuntime: \tat c.d(E.java:2)"]
    lines = spark.createDataFrame([("d", "s", i, "logcat", 0, STAMP + b) for i, b in enumerate(body)], LINE)
    source = str(tmp_path / "in")
    slices(spark, source, lines, 40)
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 2).parquet(source + "/*")
    out = str(tmp_path / "rows")
    X.write_events(S.live_watch(stream), out, str(tmp_path / "state"), every=3).awaitTermination()
    stored = X.read_event_lines(spark, out)
    assert stored.count() == 406 and stored.select("seq").distinct().count() == 406
    whole = B.live_crash_events(B.live_blocks(LN.parse_records(lines)), finish=False)
    fields = ("event_id", "kind", "process", "pid", "exception", "message", "n_lines", "n_frames", "stack_hash", "complete")
    got = X.read_events(spark, out).where("type = 'crash'").select(*fields)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(*fields).collect()))
    again = B.crash_events(stored).select("event_id", "frames")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.select("event_id", "frames").collect()))
    kinds = {r.type for r in X.read_events(spark, out).collect()}
    assert kinds == {"crash", "ams"}


def test_late_lines_and_repeats_come_out_as_late(spark, tmp_path):
    S.use_state_store(spark)
    source = str(tmp_path / "in")
    for lo, seqs in enumerate(([5, 6, 6], [2, 7])):
        rows = [("d", "s", i, "logcat", 0, f"{STAMP}AndroidRuntime: " + ("FATAL EXCEPTION: m" if i == 5 else f"\tat x{i}")) for i in seqs]
        spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{source}/{lo}")
        time.sleep(0.02)
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(source + "/*")
    out = str(tmp_path / "rows")
    X.write_events(S.live_watch(stream), out, str(tmp_path / "state")).awaitTermination()
    events = {r.event_id: r for r in X.read_events(spark, out).collect()}
    assert set(events) == {"crashBuffer#5", "late#2", "late#6"}
    assert events["crashBuffer#5"].n_lines == 3 and not events["crashBuffer#5"].complete
    assert "x2" in events["late#2"].detail


def test_idle_timer_ends_the_open_block(spark, tmp_path):
    S.use_state_store(spark)
    rows = [("d", "s", i, "logcat", 0, f"{STAMP}AndroidRuntime: {b}") for i, b in enumerate(["FATAL EXCEPTION: m", "\tat x"])]
    spark.createDataFrame(rows, LINE).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LINE).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "rows")
    S.run_until_idle(S.live_watch(stream, idle_ms=300), out, str(tmp_path / "state"), idle_ms=300)
    (event,) = X.read_events(spark, out).collect()
    assert event.complete and event.n_lines == 2


def test_slices_merge_to_bursts(spark):
    r = random.Random(1)
    times = sorted(r.randrange(0, 4_000_000) for _ in range(300))
    bursts, last = [], None
    for t in times:
        if last is None or t - last >= 30_000:
            bursts.append([t, t + 30_000, 0])
        last, bursts[-1][1] = t, t + 30_000
        bursts[-1][2] += 1
    lines = spark.createDataFrame([("d", t) for t in times], "device_serial string, received_at_ms bigint")
    found = S.merge_slices(S.activity_slices(lines)).orderBy("from_ms").collect()
    assert [[x.from_ms, x.to_ms, x.n] for x in found] == bursts


def test_followed_polls_equal_a_loop(spark, tmp_path):
    r = random.Random(6)
    words = ["a", "b", "c", "d", "e", None]
    polls = {(d, p): [r.choice(words) for _ in range(r.randint(0, 6))] for d in "xy" for p in range(9) if r.random() < 0.8}
    rows = [(d, p, i, line) for (d, p), lines in polls.items() for i, line in enumerate(lines)]
    kinds = "device_serial string, poll_no bigint, line_no bigint, line string"
    # polls are cut over micro-batches; the very last file is one that comes late
    rows.sort(key=lambda x: (x[1], x[2]))
    late = [x for x in rows if x[0] == "x" and x[1] == 2][:2]
    rows = [x for x in rows if x not in late]
    for i in range(0, len(rows), 7):
        spark.createDataFrame(rows[i : i + 7], kinds).coalesce(1).write.parquet(str(tmp_path / f"in/{i:04d}"))
        time.sleep(0.02)
    spark.createDataFrame(late, kinds).coalesce(1).write.parquet(str(tmp_path / "in/9999"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = str(tmp_path / "out")
    ST.follow_polls(stream, out, str(tmp_path / "state"), every=2).awaitTermination()
    want = []
    for d, p, i, line in rows:
        before = {x[3] for x in rows if x[:2] == (d, p - 1)}
        if line is None or line not in before:
            want.append((d, p, i, line, False))
    want += [(*x, True) for x in late]
    got = [(x.device_serial, x.poll_no, x.line_no, x.line, x.late) for x in ST.read_polls(spark, out).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_wide_slices_are_written_by_many_tasks_and_read_as_one_batch(spark, tmp_path, monkeypatch):
    from registry import live

    monkeypatch.setattr(live, "TASK_ROWS", 40)
    kinds = "device_serial string, poll_no bigint, line_no bigint, line string"
    rows = [(f"d{i % 2}", p, i, None if i == 9 else f"{(p + i) % 37} {i % 5}") for p in range(18) for i in range(60)]
    frame = spark.createDataFrame(rows, kinds).repartition(3)
    stream = live.replay(frame, "poll_no", "device_serial", slices=3, files=2, spread=True)
    ST.follow_polls(stream, str(tmp_path / "out"), str(tmp_path / "state"), every=2).awaitTermination()
    shown = {(d, p, line) for d, p, _, line in rows if line is not None}
    want = [(*x, False) for x in rows if (x[0], x[1] - 1, x[3]) not in shown]
    got = [(x.device_serial, x.poll_no, x.line_no, x.line, x.late) for x in ST.read_polls(spark, str(tmp_path / "out")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len(list((tmp_path / "out/rows").glob("batch=*"))) == 3
    # every task wrote a part of each slice, though there are two devices only
    read = spark.read.parquet(str(tmp_path / "out/rows"))
    assert read.count() == len(want)
    paths = [f for i in range(3) for f in stream_files(spark, i)]
    assert len(paths) == 24 and len(set(paths)) == 24


def stream_files(spark, i):
    """Files of the ``i``-th slice written last."""
    import glob
    import os

    newest = max(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/slices-*"), key=os.path.getmtime)
    return glob.glob(f"{newest}/{i}/part-*.parquet")


def test_an_empty_store_is_known_to_be_empty(spark, tmp_path):
    store = ST._poll_store(spark, str(tmp_path), 3)
    some = spark.range(5).select(F.lit("d").alias("device_serial"))
    joined = some.join(store.read(), "device_serial", "left_anti")
    assert "Join" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_followed_counters_add_up(spark, tmp_path):
    r = random.Random(1)
    rows = [("d", "st"[i % 2], i, "logcat", 0, r.choice([STAMP + "T: x", "raw", "\x01\x02\x03"])) for i in range(60)]
    order = sorted(rows, key=lambda x: x[2] + (25 if x[2] % 13 == 0 else 0))
    batches = [order[i : i + 12] for i in range(0, 60, 12)]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, LINE).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        time.sleep(0.02)
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = str(tmp_path / "out")
    ST.follow_counters(stream, out, str(tmp_path / "state"), every=2).awaitTermination()
    got = {x.session_id: x for x in ST.read_counters(spark, out).collect()}
    for session in "st":
        mine = [[x for x in batch if x[1] == session] for batch in batches]
        late, last = 0, -1
        for batch in mine:
            late += sum(x[2] <= last for x in batch)
            last = max([last, *(x[2] for x in batch)])
        of = got[session]
        assert (of.records, of.unparsed, of.late, of.last_seq) == (30, sum(x[5] != STAMP + "T: x" for b in mine for x in b), late, last)
        assert of.binary == sum(x[5][0] == "\x01" for b in mine for x in b) and late


class Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None


class Handle:
    def __init__(self):
        self.values = {}

    def getValueState(self, name, schema):
        return self.values.setdefault(name, Value())


def test_a_session_costs_one_frame_and_few_state_calls():
    watch, handle = S._BlockWatch(None), Handle()
    watch.init(handle)
    columns = ["seq", "tag", "message", "package", "pid", "starts", "extends", "is_frame"]
    rows = [(5, "x"), (1, "FATAL"), (2, "\tat b"), (2, "\tat b"), (3, "other"), (4, "FATAL")]
    frame = pd.DataFrame([(s, "T", m, None, None, m == "FATAL", m[0] == "\t", m[0] == "\t") for s, m in rows], columns=columns)
    (out,) = watch.handleInputRows(("d", "s"), iter([frame]), None)
    got = sorted((r.seq, r.role, r.start_seq, r.line_no, r.frame_no) for r in out.astype(object).where(out.notna(), -1).itertuples())
    assert got == [
        (1, "closed", 1, -1, -1), (1, "line", 1, 0, 0), (2, "late", -1, -1, -1), (2, "line", 1, 1, 0),
        (3, "loose", -1, -1, -1), (4, "closed", 4, -1, -1), (4, "line", 4, 0, 0), (5, "loose", -1, -1, -1),
    ]
    assert sum(v.calls for v in handle.values.values()) <= 4


def test_polls_come_out_in_bounded_frames(monkeypatch):
    monkeypatch.setattr(S, "_POLL_ROWS", 7)
    tail, handle = S._PollTail(), Handle()
    tail.init(handle)
    kinds = ["device_serial", "poll_no", "line_no", "line"]
    first = [("d", p, i, f"l{p + i}") for p in range(5) for i in range(6)] + [("d", 4, 9, None), ("d", 4, 10, "l9")]
    second = [("d", 5, 0, "l9"), ("d", 5, 1, None), ("d", 5, 2, "new"), ("d", 3, 0, "l3"), ("d", 7, 0, "new")]
    got = []
    for part in (first, second):
        shuffled = random.Random(2).sample(part, len(part))
        frames = [pd.DataFrame(shuffled[i : i + 9], columns=kinds) for i in range(0, len(part), 9)]
        for out in tail.handleInputRows(("d",), iter(frames), None):
            assert 0 < len(out) <= 7
            got += [(int(r.poll_no), int(r.line_no), r.line, bool(r.late)) for r in out.itertuples(index=False)]
    want = [(0, i, f"l{i}", False) for i in range(6)] + [(p, 5, f"l{p + 5}", False) for p in range(1, 5)]
    want += [(4, 9, None, False), (4, 10, "l9", False), (5, 1, None, False), (5, 2, "new", False), (3, 0, "l3", True), (7, 0, "new", False)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_replay_keeps_a_slice_small(spark):
    from registry.live import replay

    rows = [("d", p, i, f"{p} {i}") for p in range(40) for i in range(10)]
    df = spark.createDataFrame(rows, "device_serial string, poll_no bigint, line_no bigint, line string")
    got = S.drain(replay(df, "poll_no", "device_serial", most=20), "replayed")
    assert sorted(map(tuple, got.drop("batch_id").collect())) == sorted(rows)
    sizes = [r["count"] for r in got.groupBy("batch_id").count().collect()]
    assert len(sizes) > 6 and max(sizes) <= 60


class _Held:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def _unseen(batches):
    """Rows that the poll state lets through, batch by batch, and the seconds it takes."""
    tail = S._PollTail()
    tail._tail = _Held()
    out, began = [], time.thread_time()
    for frames in batches:
        out += [f for f in tail.handleInputRows(("d",), frames, None)]
    took = time.thread_time() - began
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(), took


def test_polls_of_few_lines_cost_what_polls_of_many_do():
    n = 200_000
    def batch(per_poll):
        at = np.arange(n)
        lines = [f"line {i % 97}" for i in at]
        frame = pd.DataFrame({"poll_no": at // per_poll, "line_no": at, "line": lines})
        return [[frame[i : i + 10_000] for i in range(0, n, 10_000)]]
    few, many = _unseen(batch(10_000))[1], _unseen(batch(2))[1]
    assert many < 4 * few + 0.5, (few, many)


def test_polls_spread_over_batches_equal_a_loop():
    r = random.Random(4)
    for _ in range(40):
        batches, last, before, current, want = [], -1, set(), set(), []
        for b in range(4):
            rows = [
                (r.choice([None, *range(-3, 12)]) if b else r.randrange(4), i, r.choice(["a", "b", "", None, "c"]))
                for i in range(r.randrange(12))
            ]
            if not rows:
                continue
            batches.append([pd.DataFrame(rows, columns=["poll_no", "line_no", "line"])])
            seen = last
            for number, i, line in sorted((x for x in rows if x[0] is not None), key=lambda x: x[:2]):
                if number < seen:
                    want.append((number, i, line, True))
                    continue
                if number != last:
                    before, last, current = current if number == last + 1 else set(), number, set()
                if line is None or line not in before:
                    want.append((number, i, line, False))
                if line is not None:
                    current = current | {line}
        got, _ = _unseen(batches)
        found = [tuple(None if pd.isna(v) else getattr(v, "item", lambda v=v: v)() for v in x) for x in got[["poll_no", "line_no", "line", "late"]].itertuples(index=False)] if len(got) else []
        assert sorted(map(repr, found)) == sorted(map(repr, want))
