import time

from pyspark.sql import functions as F

from stackfall.functions import rules as FR
from stackfall.operators import blocks as B
from stackfall.operators import identity as I
from stackfall.sinks import exports as X
from stackfall.sources import artifacts as A
from stackfall.sources import devices as D
from stackfall.sources import lines as LN
from stackfall.streaming import live as S


def test_artifact_files(spark, tmp_path):
    for name, data in {
        "tombstones/tombstone_00": b"*** *** ***\npid: 7, tid: 8, name: x\nsignal 6 (SIGABRT)\n#00 pc 1\n",
        "dropbox/data_app_crash@170.txt": "Process: com.a\n\njava.lang.X: é\n\tat a.b(C.java:1)\n".encode(),
        "dropbox/bad name!.txt": b"java.lang.Y: z\n", "dropbox/system_app_anr@1.txt": b"  \n",
        "anr/anr_1": b"Subject\n----- pid 5 at 2024-01-01 00:00:00 -----\nCmd line: com.b\n----- pid 6 at T -----\n",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    files = A.read_artifacts(spark, str(tmp_path), "d", "s", max_bytes=40)
    got = {r.name: r for r in files.collect()}
    assert got["tombstone_00"].truncated and len(got["tombstone_00"].text) == 40
    events = A.artifact_events(A.read_artifacts(spark, str(tmp_path), "d", "s")).collect()
    by = {(r.name, r.event_no): r for r in events}
    assert len(events) == 5 and by[("anr_1", 0)].pid == 5 and by[("anr_1", 1)].pid == 6
    assert by[("tombstone_00", 0)].origin == "tombstone" and by[("tombstone_00", 0)].n_frames == 1
    crash = by[("data_app_crash@170.txt", 0)]
    assert (crash.process, crash.exception, crash.message, crash.timestamp) == ("com.a", "java.lang.X", "é", "170")
    assert crash.raw[0] == "[data_app_crash] data_app_crash@170.txt"
    dropbox = A.parse_dropbox_files(A.read_artifacts(spark, str(tmp_path / "dropbox"), "d", "s"))
    assert dropbox.where("skipped").count() == 2


def test_scanned_artifacts_equal_whole_texts(spark, tmp_path):
    frames = "".join(f"#{i:02d} pc {i:x}  /lib/a.so\n" for i in range(300))
    for name, data in {
        "tombstones/tombstone_00": b"*** *** ***\npid: 7, tid: 8, name: x\nsignal 6 (SIGABRT)\r\n" + frames.encode() + b"Abort message: 'br\xffken'",
        "dropbox/data app@170.txt": b"Process: com.a\n\njava.lang.X: y\n\tat a.b(C.java:1)\n", "dropbox/system_app_anr@1.txt": b"  \n",
        "dropbox/data_app_crash@171+2.txt": "Process: com.b\njava.lang.Y: é\nCaused by: java.lang.Z: w\n".encode(), "dropbox/empty": b"",
        "anr/anr_1": b"Subject\n----- pid 5 at 2024-01-01 00:00:00 -----\nCmd line: com.b\n" + b"  at x.y(Z.java)\n" * 200 + b"----- pid 6 at T -----\n\"main\" tid=1\n",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    whole = A.artifact_events(A.read_artifacts(spark, str(tmp_path), "d", "s"))
    fields = ["dir", "name", "event_no", "event_id", "origin", "kind", "process", "pid", "tid", "thread", "exception", "message",
              "timestamp", "n_lines", "n_frames", "stack_hash"]
    want = sorted(map(str, whole.select(*fields).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        for chunk in (7, 1 << 18):
            lines = A.scan_artifacts(spark, str(tmp_path), "d", "s")
            got = A.scanned_events(lines, chunk_rows=chunk).select(*fields).collect()
            assert sorted(map(str, got)) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_text_files_keep_order_over_splits(spark, tmp_path):
    text = "".join(f"line {i}\r\n" for i in range(4000)) + "last\udcff".encode("utf-8", "replace").decode()
    (tmp_path / "a.txt").write_text(text, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = LN.read_lines(spark, str(tmp_path), "logcat", "d", "s").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.seq for r in rows] == list(range(4001))
    assert [r.line for r in rows[:4000]] == [f"line {i}" for i in range(4000)]


def test_follow_predicate_and_unresolved(spark):
    df = spark.createDataFrame([(1, 5, None), (2, None, 7), (3, None, None)], "id int, pid int, uid int").withColumn(
        "package", F.lit(None).cast("string"))
    keep = lambda c: {r.id for r in df.where(c).collect()}
    assert keep(I.follow_predicate(pids=[5], uid=7)) == {1, 2}
    assert keep(I.follow_predicate(pids=[5], found=False)) == set()


def test_missing_snapshot_and_safe_names(spark, tmp_path):
    assert D.load_snapshot(spark, str(tmp_path / "none")) is None
    assert X.safe_stem("../evil.log") == "evil" and X.safe_stem("///") == "export" and X.safe_stem(".hid den.csv") == "hidden"


def test_live_watch_equals_batch(spark, tmp_path):
    S.use_state_store(spark)
    schema = "device_serial string, session_id string, seq bigint, source string, received_at_ms bigint, line string"
    stamp = "09-30 12:00:00.123  7  7 E "
    body = ["AndroidRuntime: FATAL EXCEPTION: main", "AndroidRuntime: java.lang.X: y", "Chat: hi", "AndroidRuntime: \tat a.b(C.java:1)",
            "ActivityManager: Killing 9:com.v/u0a1 (adj 0): crash", "AndroidRuntime: FATAL EXCEPTION: other", "AndroidRuntime: Process: com.a, PID: 7"]
    lines = spark.createDataFrame([("d", "s", i, "logcat", 0, stamp + b) for i, b in enumerate(body * 3)], schema)
    src = str(tmp_path / "in")
    for lo in range(0, 21, 3):  # blocks are split over micro-batches
        lines.where((F.col("seq") >= lo) & (F.col("seq") < lo + 3)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    stream = LN.stream_lines(spark, src, max_files=1)
    out = str(tmp_path / "rows")
    X.write_events(S.live_watch(stream), out, str(tmp_path / "state")).awaitTermination()
    live = X.read_events(spark, out)
    got = sorted((r.seq, r.n_lines, r.n_frames, r.complete) for r in live.where("type = 'crash'").collect())
    batch = B.live_crash_events(B.live_blocks(LN.parse_records(lines)), finish=False)
    want = sorted((r.start_seq, r.n_lines, r.n_frames, r.complete) for r in batch.collect())
    assert got == want and [w[3] for w in want].count(False) == 1
    assert live.where("type = 'ams'").count() == 3


def test_rules_in_a_stream_and_restart_edges(spark):
    states = spark.createDataFrame([("d", "p", t, pids) for t, pids in ((1, []), (2, [5]), (3, [5]), (4, [6]), (5, []), (6, [7]))],
                                   "device_serial string, package string, polled_at_ms bigint, pids array<int>")
    assert [(r.polled_at_ms, r.edge) for r in I.app_launches(states).orderBy("polled_at_ms").collect()] == [
        (2, "start"), (4, "restart"), (5, "stop"), (6, "start")]
    assert FR.structured_filter(levels=["error"], tag_include=" ", keyword="a", window_seconds=0) == [
        FR.FilterRule("__levels", "level", "in", "error"), FR.FilterRule("__keyword", "message", "contains", "a")]


def test_bundled_artifacts_equal_single_files(spark, tmp_path):
    texts = {
        "tombstones/t 1/part-0": "*** *** ***\npid: 7, tid: 8, name: x\nsignal 6 (SIGABRT)\r\n" + "#00 pc 1\tx\n" * 90,
        "anr/a/part-1": "Subject\n----- pid 5 at T -----\nCmd line: com.b\n  at x.y(Z.java)\n----- pid 6 at T -----\n\"main\" tid=1",
        "dropbox/d@1.txt/part-2": "Process: com.b\njava.lang.Y: é\n\nCaused by: java.lang.Z: w\n", "dropbox/none/part-3": "",
    }
    for name, text in texts.items():
        path = tmp_path / "single" / name
        path.parent.mkdir(parents=True)
        path.write_bytes(text.encode().replace(b"Abort", b"\xff"))
    (tmp_path / "bundled").mkdir()
    rows = [f"/{name}\t{line}\n" for name, text in texts.items() for line in text.removesuffix("\n").split("\n")]
    (tmp_path / "bundled/1.txt").write_bytes("".join(rows[:95]).encode())
    (tmp_path / "bundled/2.txt").write_bytes("".join(rows[95:]).encode().replace(b"\tSubject", b"\tSub\xff"))
    part = lambda k: F.element_at(F.split("file_path", "/"), k)
    fields = ["dir", "name", "event_no", "event_id", "kind", "process", "pid", "tid", "exception", "message", "n_lines", "n_frames"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        lines, events = {}, {}
        for kind in ("single", "bundled"):
            scanned = A.scan_artifacts(spark, str(tmp_path / kind), "d", "s", directory=part(-3), name=part(-2), bundled=kind == "bundled")
            lines[kind] = sorted((r.dir, r.name, r.seq, r.line.replace("Sub�", "Subject")) for r in scanned.collect() if r.name != "none")
            events[kind] = sorted(map(str, A.scanned_events(scanned).select(*fields).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert lines["single"] == lines["bundled"] and len(lines["single"]) == 93 + 6 + 4
    assert events["single"] == events["bundled"] and len(events["single"]) == 4


def test_scanned_artifacts_query_writes_few_files(spark, tmp_path, monkeypatch):
    from registry import devices

    rows = [(p, f"name {p}", f"type {p % 7}", f"Brand#{p % 5}", p % 50) for p in range(1, 401)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_type string, p_brand string, p_size int").write.parquet(
        str(tmp_path / "part.parquet"))
    monkeypatch.setattr("stackfall.session.shared_dir", lambda spark: str(tmp_path / "shared"))
    assert devices.QUERIES["scanned_artifacts"](spark, str(tmp_path)).count() == 475
    assert 0 < len(list(tmp_path.glob("shared/artifacts-*/**/part-*"))) < 100
