import pytest
from pyspark.sql import functions as F

from stackfall.functions import classify as C
from stackfall.functions import crash as K
from stackfall.functions import records as R
from stackfall.functions import rules as FR
from stackfall.functions import signals as SG
from stackfall.functions import text as T
from stackfall.operators import signals as G
from stackfall.sources.lines import parse_records


def one(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", build(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_threadtime_forms(spark):
    out = one(spark, [
        "09-30 12:00:00.123  1234  5678 E AndroidRuntime: FATAL EXCEPTION: main",
        "2024-09-30 12:00:00.123 u10_a25  1234  5678 W Java   :   x: y",
        "09-30 12:00:00.123 root  1  2 I init: up",
        "09-30 99:00:00.123  1234  5678 E A: x",
        "09-30 12:00:00.123  12x4  5678 E A: x",
        "09-30 12:00:00.123  99999999999  5678 E A: x",
        "09-30 12:00:00.123  1234  5678 E two words: x",
        "not a log line",
    ], R.parse_threadtime)
    assert (out[0].level, out[0].pid, out[0].tid, out[0].tag) == ("error", 1234, 5678, "AndroidRuntime")
    assert out[1].uid == 1010025 and out[1].message == "  x: y" and out[1].tag == "Java"
    assert out[2].uid == 0
    assert out[3:6] == [None, None, None] and out[6:] == [None, None]


def test_needles_are_looked_for_in_one_pass(spark):
    texts = ["", None, "x am_crash: y", "am_crash", "ANR in", "ANR in a", "\n a\n*** [b^c]", "*** b^c", "a-b&&c", "é (x) é", "a\\b"]
    for needles in (["am_crash:", "ANR in ", "*** [b"], ["b^c", "-b&&", "(x)", "\\b"], ["a", "b"], ["a", "b", ""], ["é", "(", "*"]):
        found = one(spark, texts, lambda v: T.contains_any(v, needles))  # noqa: B023
        assert found == [None if t is None else any(n in t for n in needles) for t in texts]
    frame = spark.createDataFrame([], "device_serial string, session_id string, seq bigint, raw string, tag string")
    plan = G.parsed_rows(frame, "seq", raw="raw", also=F.col("tag") == "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("am_crash:|am_anr:") == 1 and plan.count("lmkd|OutOfMemoryError") == 1


def test_kernel_grammars(spark):
    dm = one(spark, ["<6>[    1.234567] usb 1-1: new device", "[ 1.5] Kernel panic - not syncing: x",
                     "<12>healthd: battery", "plain", "<300>[1.0] a: b", "  "], R.parse_dmesg)
    assert (dm[0].tag, dm[0].message, dm[0].level, dm[0].uptime_seconds) == ("usb 1-1", "new device", "info", 1.234567)
    assert dm[1].tag is None and dm[1].level == "info"
    assert dm[2].level == "warn" and dm[2].uptime_seconds is None
    assert dm[3:] == [None, None, None]
    km = one(spark, ["6,1234,567890,-;usb 1-1: nd", "6,1,2;no", "x,1,2,-;no"], R.parse_kmsg)
    assert km[0].uptime_seconds == 0.56789 and km[1:] == [None, None]


def test_record_count_is_kept_and_raw_lines_stay(spark):
    lines = spark.createDataFrame(
        [("d", "s", i, src, 0, line) for i, (src, line) in enumerate([
            ("logcat", "garbage"), ("crash", "6,1,2,-;x"), ("dmesg", "6,1,2,-;x"), ("boot", "<3>a: b"),
            ("logcat", "<3>a: b"), ("unheard", "<3>a: b")])],
        "device_serial string, session_id string, seq bigint, source string, received_at_ms bigint, line string")
    out = {r.seq: r for r in parse_records(lines).collect()}
    assert [out[i].parsed for i in range(6)] == [False, False, True, True, False, False]
    assert out[0].message == "garbage" and out[0].level == "unknown"


def test_registered_source(spark):
    R.register_source("plain", lambda line: F.struct(
        F.lit("warn").alias("level"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("double").alias("uptime_seconds"),
        F.lit(None).cast("int").alias("pid"), F.lit(None).cast("int").alias("tid"), F.lit(None).cast("int").alias("uid"),
        F.lit("plain").alias("tag"), line.alias("message")))
    try:
        lines = spark.createDataFrame([("d", "s", 1, "plain", 0, "hi")],
                                      "device_serial string, session_id string, seq bigint, source string, received_at_ms bigint, line string")
        row = parse_records(lines).first()
        assert (row.tag, row.level, row.parsed) == ("plain", "warn", True)
    finally:
        R.unregister_source("plain")


def test_families(spark):
    kinds = one(spark, ["Kernel panic - not syncing", "no kernel panic recorded", "system_server: Fatal signal 11", "lowmemorykiller: Killing 'x'",
                        "BUG: soft lockup", "kernel BUG at mm.c", "Internal error: Oops: 5", "ANR in com.x", "FATAL EXCEPTION: main", "chatter"], C.classify)
    assert kinds == ["kernelPanic", None, "systemServer", "lowMemory", "watchdog", "kernelBug", "oops", "anr", "nativeCrash", None]


def test_ams_shapes(spark):
    out = one(spark, [
        "am_crash: [0,4321,com.a.b,8948294,java.lang.X,boom,F.java,10]", "am_kill: [0,66,com.bg,10123,excessive cpu]",
        "ProcessRecord{ab 4321:com.a.b/u0a12} isCrashing=false", "Force finishing activity com.x.y/.Main",
        "Force stopping com.q appid=10 user=0: reason=foo", "Killing 123:com.v.r/u0a9 (adj 0): crash", "Killing time on the couch",
        "Process com.a.b (pid 12) has died", "ProcessRecord{nothing here}"], SG.parse_ams)
    assert out[0].detail == "java.lang.X: boom" and out[0].crashing is True and out[0].pid == 4321
    assert out[1].reason == "excessive cpu" and out[1].uid == 10123
    assert out[2].kind == "isCrashing" and out[2].crashing is False and out[2].pid == 4321
    assert out[3].process == "com.x.y" and out[4].reason == "foo" and out[4].pid == 10
    assert (out[5].process, out[5].pid, out[5].reason) == ("com.v.r", 123, "crash")
    assert out[6] is None and out[7].pid == 12 and out[8] is None


def test_anomalies(spark):
    out = one(spark, ["I lmkd: Kill 'com.a.b' (2000), uid=1", "x OutOfMemoryError " + "é" * 200, "Too many open files",
                      "binder transaction failed", "(99999999999) EMFILE", "Killing time on the couch"], SG.parse_anomaly)
    assert (out[0].kind, out[0].process, out[0].pid) == ("lowMemoryKill", "com.a.b", 2000)
    assert len(out[1].detail) == 17 + 200
    assert [o.kind if o else None for o in out[2:]] == ["fdExhaustion", "binderFailure", "fdExhaustion", None]
    assert out[4].pid is None


def test_tombstone_fields(spark):
    lines = ["*** *** ***", "pid: 4321, tid: 4322, name: Thread-1  >>> com.a <<<", "signal 11 (SIGSEGV), code 1, fault addr 0x8",
             "Abort message: 'bad free'", "backtrace:", "    #00 pc 1 libc.so", "    #01 pc 2 libx.so"]
    row = spark.createDataFrame([(lines,)], "l array<string>").select(K.crash_fields(F.col("l")).alias("c")).first().c
    assert (row.pid, row.tid, row.process, row.message, row.n_frames, row.kind) == (4321, 4322, "Thread-1", "bad free", 2, "nativeCrash")
    assert row.exception.startswith("signal 11")


@pytest.fixture(scope="module")
def rule_rows(spark):
    return spark.createDataFrame(
        [(1, "Chat", "Hello ÉCOLE", 12, "info", 1000), (2, None, "x", None, "unknown", 5000), (3, "libc", "École 7", 7, "verbose", 9000)],
        "id int, tag string, message string, pid int, level string, received_at_ms bigint")


@pytest.mark.parametrize("rule,kept", [
    (("tag", "notContains", "chat"), {2, 3}), (("tag", "contains", "CHAT"), {1}), (("tag", "notEquals", "libc"), {1, 2}),
    (("tag", "notContains", ""), {2}), (("pid", "equals", "12"), {1}), (("message", "regex", r"école"), {1, 3}),
    (("level", "minLevel", "warn"), {2}), (("tag", "minLevel", "verbose"), {1, 3}), (("tag", "in", " CHAT , LIBC"), {1, 3}), (("tag", "in", ","), set()),
    (("received", "withinLast", "5"), {2, 3})])
def test_rules(rule_rows, rule, kept):
    predicate = FR.compile_rules([FR.FilterRule("r", *rule)], as_of_ms=10_000)
    assert {r.id for r in rule_rows.where(predicate).collect()} == kept


@pytest.mark.parametrize("rule", [
    ("tag", "contains", ""), ("tag", "in", ""), ("message", "regex", "(unclosed"), ("message", "regex", "(?=x)"), ("level", "minLevel", "loud"),
    ("received", "withinLast", "0"), ("received", "withinLast", "abc"), ("received", "withinLast", "-5"), ("nothing", "equals", "x")])
def test_bad_rules(spark, rule):
    with pytest.raises(ValueError):
        FR.compile_rules([FR.FilterRule("r", *rule)])
    FR.compile_rules([FR.FilterRule("r", *rule, enabled=False)])


def test_requested_buffers(spark):
    out = one(spark, ["logcat -b main,system -b crash,main", "logcat -bkernel", "logcat"], C.requested_buffers)
    assert out == [["main", "system", "crash"], ["kernel"], []]
