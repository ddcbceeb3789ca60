"""Queries over records: grammars, filters, classification, views, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackfall.functions import classify as C
from stackfall.functions import records as R
from stackfall.functions import rules as FR
from stackfall.functions import text as TX
from stackfall.operators import chunks as H
from stackfall.operators import integrity as Q
from stackfall.operators import views as V
from stackfall.session import scratch_path
from stackfall.sinks import exports as X
from stackfall.sources import lines as LN

from .common import KEYS, family, lines, of, records, scene_sql, sql, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


def _grammar(name: str, steps, fields: str, relation: str) -> None:
    columns = [f.strip() for f in fields.split(",")]

    def run(spark, sf):
        out = steps.on(lines(spark, sf), F.col("line"), "r").where(F.col("r").isNotNull())
        return out.select(*KEYS, "seq", *[F.col("r").getField(c).alias(c) for c in columns])

    quoted = ", ".join('"timestamp"' if c == "timestamp" else c for c in columns)
    query(
        name, sql("grammars", f"SELECT device_serial, session_id, seq, {quoted} FROM {relation} WHERE ok")
    )(run)


_grammar("parse_threadtime", R.THREADTIME, "level, timestamp, pid, tid, uid, tag, message", "threadtime")
_grammar("parse_brief", R.BRIEF, "level, pid, tag, message", "brief")
_grammar("parse_dmesg", R.DMESG, "level, uptime_seconds, tag, message", "dmesg")
_grammar("parse_kmsg", R.KMSG, "level, uptime_seconds, tag, message", "kmsg")

_REC = 'device_serial, session_id, seq, source, level, level_rank, "timestamp", uptime_seconds, pid, tid, uid, tag, message, raw, received_at_ms, parsed'
_REC_COLS = [c.strip().strip('"') for c in _REC.split(",")]


@query("parse_records", sql("rec", f"SELECT {_REC} FROM rec"))
def _(spark, sf):
    return records(spark, sf).select(*_REC_COLS)


@query(
    "parse_logcat",
    sql("grammars", "SELECT seq, coalesce(t.tag, b.tag) AS tag, coalesce(t.message, b.message) AS message, coalesce(t.pid, b.pid) AS pid "
        "FROM (SELECT * FROM threadtime WHERE ok) t FULL JOIN (SELECT * FROM brief WHERE ok) b USING (seq)"),
)
def _(spark, sf):
    r = R.parse_logcat(F.col("line"))
    out = lines(spark, sf).select("seq", r.alias("r")).where(F.col("r").isNotNull())
    return out.select("seq", "r.tag", "r.message", "r.pid")


@query(
    "parse_kernel",
    sql("grammars", "SELECT l.seq, l.source, coalesce(CASE WHEN l.source = 'kmsg' THEN k.message ELSE d.message END, d.message, k.message) AS message "
        "FROM lines l LEFT JOIN (SELECT * FROM dmesg WHERE ok) d USING (seq) LEFT JOIN (SELECT * FROM kmsg WHERE ok) k USING (seq) WHERE d.seq IS NOT NULL OR k.seq IS NOT NULL"),
)
def _(spark, sf):
    r = R.parse_kernel(F.col("line"), F.col("source"))
    out = lines(spark, sf).select("seq", "source", r.alias("r")).where(F.col("r").isNotNull())
    return out.select("seq", "source", "r.message")


@query(
    "parse_auto",
    sql("grammars", """SELECT l.seq, CASE WHEN t.ok THEN 'threadtime' WHEN b.ok THEN 'brief' WHEN d.ok THEN 'dmesg' ELSE 'raw' END AS grammar,
      CASE WHEN t.ok THEN t.message WHEN b.ok THEN b.message WHEN d.ok THEN d.message ELSE l.line END AS message, t.ok OR b.ok OR d.ok AS parsed
      FROM lines l JOIN threadtime t USING (seq) JOIN brief b USING (seq) JOIN dmesg d USING (seq)"""),
)
def _(spark, sf):
    # every line as if it came from a boot collection
    out = LN.parse_records(lines(spark, sf).withColumn("source", F.lit("boot")))
    grammar = (
        F.when(F.col("tid").isNotNull(), "threadtime").when(~F.col("parsed"), "raw")
        .when(F.col("raw").rlike("^[VDIWEFSA]/"), "brief").otherwise("dmesg")
    )
    return out.select("seq", grammar.alias("grammar"), "message", "parsed")


@query(
    "split_subsystem",
    r"""SELECT event_id, CASE WHEN ok THEN trim(m.h) END AS tag, CASE WHEN ok THEN ltrim(m.t) ELSE body END AS message FROM (
      SELECT *, regexp_extract(body, '^\s*([A-Za-z0-9_./-]+(?: [A-Za-z0-9_./-]+)?)\s*:(.*)$', ['h', 't']) AS m,
        regexp_matches(body, '^\s*([A-Za-z0-9_./-]+(?: [A-Za-z0-9_./-]+)?)\s*:') AND strlen(regexp_extract(body, '^\s*([A-Za-z0-9_./-]+(?: [A-Za-z0-9_./-]+)?)\s*:', 1)) <= 24 AS ok
      FROM (SELECT event_id, repeat(event_type || ' ', CAST(1 + user_id % 3 AS INTEGER)) || CASE WHEN user_id % 4 = 0 THEN '' ELSE ': ' END || props AS body FROM events))""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    sep = F.when(F.col("user_id") % 4 == 0, "").otherwise(": ")
    body = F.concat(
        F.repeat(F.concat("event_type", F.lit(" ")), (1 + F.col("user_id") % 3).cast("int")), sep, "props"
    )
    out = R.SUBSYSTEM.on(e.select("event_id", body.alias("body")), F.col("body"), "s")
    return out.select("event_id", "s.tag", "s.message")


@query("device_time", sql("rec", 'SELECT device_serial, session_id, seq, epoch_ms(device_ts) AS device_ms FROM rec WHERE "timestamp" IS NOT NULL'))
def _(spark, sf):
    r = records(spark, sf, timed=True).where(F.col("timestamp").isNotNull())
    return r.select(*KEYS, "seq", F.unix_millis(F.col("device_ts").cast("timestamp")).alias("device_ms"))


@query("line_index", sql("rec", "SELECT device_serial, session_id, seq, line_index FROM rec"))
def _(spark, sf):
    return H.with_line_index(lines(spark, sf).select(*KEYS, "seq"))


@query("uid_token", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 10000 + c_nationkey + c_custkey WHEN 1 THEN 1000 WHEN 2 THEN CAST(c_nationkey * 100000 + 10000 + c_custkey AS BIGINT) WHEN 3 THEN NULL ELSE 0 END AS uid FROM customer""")
def _(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    token = (
        F.when(k % 5 == 0, F.concat(F.lit("uid="), (10000 + n + k).cast("string")))
        .when(k % 5 == 1, F.lit("system"))
        .when(k % 5 == 2, F.concat(F.lit("u"), n.cast("string"), F.lit("_a"), k.cast("string")))
        .when(k % 5 == 3, F.col("c_name")).otherwise("root")
    )
    return table(spark, sf, "customer").select(
        "c_custkey", R.uid_token(token).cast("bigint").alias("uid")
    )


@query(
    "file_seq",
    "SELECT device_serial, session_id, row_number() OVER (PARTITION BY device_serial, session_id ORDER BY seq) - 1 AS seq, line FROM ("
    + sql("lines", "SELECT * FROM lines") + ")",
)
def _(spark, sf):
    """Round trip through splittable text files: the line numbers come back."""
    path = scratch_path(spark, "text")
    src = lines(spark, sf).repartition(*KEYS).sortWithinPartitions(*KEYS, "seq")
    src.select(*KEYS, F.col("line").alias("value")).write.partitionBy(*KEYS).text(path)
    parts = F.regexp_extract("file_path", "device_serial=([^/]+)", 1)
    session = F.regexp_extract("file_path", "session_id=([^/]+)", 1)
    text = LN.read_lines(spark, path, "logcat", parts, session)
    return text.select(*KEYS, "seq", "line")


@query("explode_lines", """SELECT doc_id, CAST(g - 1 AS BIGINT) AS line_no, l[g] AS line FROM (SELECT doc_id, string_split(regexp_replace("text", '\\n$', ''), chr(10)) AS l FROM documents WHERE "text" <> ''), LATERAL (SELECT unnest(generate_series(1, len(l))) AS g)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return LN.explode_lines(d).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("union_sessions", sql("rec", "SELECT source, level, count(*) AS n FROM rec GROUP BY ALL"))
def _(spark, sf):
    r = records(spark, sf)
    both = LN.union_sessions(
        r.where(F.col("source") == "logcat"), r.where(F.col("source") != "logcat")
    )
    return both.groupBy("source", "level").agg(F.count(F.lit(1)).alias("n"))


# --- filters --------------------------------------------------------------------------

_FILTERS = {
    "filter_contains": ([FR.FilterRule("a", "message", "contains", "SLOW op")], "contains(lower(message), 'slow op')"),
    "filter_not_contains": ([FR.FilterRule("a", "tag", "notContains", "chat")], "tag IS NULL OR NOT contains(lower(tag), 'chat')"),
    "filter_equals": ([FR.FilterRule("a", "pid", "equals", "1000")], "pid = 1000"),
    "filter_not_equals": ([FR.FilterRule("a", "pid", "notEquals", "1000")], "pid IS NULL OR pid <> 1000"),
    "filter_case_sensitive": ([FR.FilterRule("a", "message", "contains", "FATAL", case_sensitive=True)], "contains(message, 'FATAL')"),
    "filter_regex": ([FR.FilterRule("a", "message", "regex", r"exception|killing \d+")], r"regexp_matches(message, '(?i)exception|killing \d+')"),
    "filter_min_level": ([FR.min_level("warn")], "level_rank >= 3"),
    "filter_in": ([FR.FilterRule("a", "level", "in", " ERROR , warn,")], "level IN ('error', 'warn')"),
    "filter_uid": ([FR.FilterRule("a", "uid", "equals", "10270")], "uid = 10270"),
    "filter_source": ([FR.FilterRule("a", "source", "in", "dmesg,kmsg")], "source IN ('dmesg', 'kmsg')"),
    "filter_rule_set": (
        [FR.min_level("info"), FR.FilterRule("b", "tag", "notEquals", "Chat"), FR.FilterRule("c", "message", "contains", "a"),
         FR.FilterRule("d", "tag", "contains", "", enabled=False)],
        "level_rank >= 2 AND (tag IS NULL OR lower(tag) <> 'chat') AND contains(lower(message), 'a')",
    ),
    "structured_filter": (
        FR.structured_filter(levels=["error", "warn"], tag_include="a", tag_exclude="libc", keyword="process|fatal", keyword_is_regex=True),
        "level IN ('error', 'warn') AND contains(lower(tag), 'a') AND NOT contains(lower(tag), 'libc') AND regexp_matches(message, '(?i)process|fatal')",
    ),
}


def _filter(name: str, rules, condition: str) -> None:
    def run(spark, sf):
        return records(spark, sf).where(FR.compile_rules(rules)).select(*KEYS, "seq")

    query(name, sql("rec", f"SELECT device_serial, session_id, seq FROM rec WHERE {condition}"))(run)


for _name, (_rules, _condition) in _FILTERS.items():
    _filter(_name, _rules, _condition)


@query("filter_within_last", sql("rec", "SELECT device_serial, session_id, seq FROM rec WHERE received_at_ms + 600000 >= (SELECT max(received_at_ms) FROM rec)"))
def _(spark, sf):
    r = records(spark, sf)
    now = r.agg(F.max("received_at_ms")).first()[0]
    rule = FR.FilterRule("w", "received", "withinLast", "600")
    return r.where(FR.compile_rules([rule], as_of_ms=now)).select(*KEYS, "seq")


@query("scan_hints", sql("rec", "SELECT device_serial, session_id, seq FROM rec WHERE pid IN (1000, 2001) AND tag IN ('lmkd', 'ActivityManager', 'libc')"))
def _(spark, sf):
    hint = FR.scan_hints(pids=[1000, 2001, -1], tags=["lmkd", " ActivityManager", "libc", ""])
    return records(spark, sf).where(hint).select(*KEYS, "seq")


@query("is_scannable", sql("rec", "SELECT device_serial, session_id, seq FROM rec WHERE level NOT IN ('verbose', 'debug')"))
def _(spark, sf):
    return records(spark, sf).where(C.is_scannable(F.col("level"))).select(*KEYS, "seq")


@query("interesting_tags", sql("live", "SELECT device_serial, session_id, seq, tag FROM v0"))
def _(spark, sf):
    return records(spark, sf).where(C.is_interesting_tag(F.col("tag"))).select(*KEYS, "seq", "tag")


@query(
    "binary_lines",
    scene_sql("artifacts", r"""SELECT device_serial, session_id, name, l AS line FROM (SELECT *, unnest(string_split("text", chr(10))) AS l FROM artifacts) WHERE l <> ''
      AND floor((strlen(l) - strlen(regexp_replace(l, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'))) * 100 / strlen(l)) >= 30"""),
)
def _(spark, sf):
    t = LN.explode_lines(of(spark, sf, "artifacts").select(*KEYS, "name", "text"))
    return t.where(C.is_binary_line(F.col("line"))).select(*KEYS, "name", "line")


@query("mentions_target", scene_sql("artifacts", """SELECT device_serial, session_id, name, count(*) AS n FROM (SELECT *, unnest(string_split("text", chr(10))) AS l FROM artifacts) WHERE contains(l, 'com.app1.main') OR contains(l, 'FORTIFY') GROUP BY ALL"""))
def _(spark, sf):
    t = LN.explode_lines(of(spark, sf, "artifacts").select(*KEYS, "name", "text"))
    hit = t.where(V.mentions_target(F.col("line"), "com.app1.main", "FORTIFY"))
    return hit.groupBy(*KEYS, "name").agg(F.count(F.lit(1)).alias("n"))


# --- classification ---------------------------------------------------------------------

_KIND = family("concat_ws(' ', tag, message, CASE WHEN NOT parsed THEN raw END)")
_KINDS = f"SELECT *, CASE WHEN level NOT IN ('verbose', 'debug') THEN {_KIND} END AS kind FROM rec"


@query("classify_records", sql("rec", f"SELECT device_serial, session_id, seq, kind FROM ({_KINDS}) WHERE kind IS NOT NULL"))
def _(spark, sf):
    return V.crash_rows(records(spark, sf))


@query("classify_text", f"""SELECT doc_id, {family('"text"')} AS kind FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.classify(F.col("text")).alias("kind"))


@query("crash_family_counts", sql("rec", f"SELECT device_serial, session_id, kind, count(*) AS n FROM ({_KINDS}) GROUP BY ALL"))
def _(spark, sf):
    return V.count_by_kind(V.with_crash_kind(records(spark, sf)))


@query("crash_kind_labels", sql("rec", f"""SELECT kind, CASE kind WHEN 'kernelPanic' THEN 'P' WHEN 'lowMemory' THEN 'M' WHEN 'anr' THEN 'A' WHEN 'nativeCrash' THEN 'N' END AS badge,
  CASE kind WHEN 'kernelPanic' THEN 'Kernel panic' WHEN 'lowMemory' THEN 'Low-memory kill' WHEN 'anr' THEN 'Not responding' WHEN 'nativeCrash' THEN 'Native crash' END AS label, count(*) AS n FROM ({_KINDS}) WHERE kind IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    rows = V.crash_rows(records(spark, sf))
    return rows.groupBy(
        C.kind_of_name(F.col("kind")).alias("kind"), C.kind_badge(F.col("kind")).alias("badge"),
        C.kind_label(F.col("kind")).alias("label"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("crash_kind_by_seq", sql("rec", f"SELECT device_serial, session_id, seq, kind FROM ({_KINDS})"))
def _(spark, sf):
    r = records(spark, sf)
    return V.join_crash_kind(r, V.crash_rows(r)).select(*KEYS, "seq", "kind")


@query("crash_only", sql("rec", f"SELECT device_serial, session_id, seq, message FROM ({_KINDS}) WHERE kind IS NOT NULL"))
def _(spark, sf):
    r = records(spark, sf)
    return V.crash_only(r, V.crash_rows(r)).select(*KEYS, "seq", "message")


@query("record_notes", """SELECT doc_id, contains(lower("text"), 'permission denied') OR contains(lower("text"), 'not permitted') OR contains(lower("text"), 'access denied') OR contains(lower("text"), 'dmesg_restrict') AS denied,
  contains(lower("text"), 'no kernel panic') OR contains(lower("text"), 'no crash') OR contains(lower("text"), 'no valid data') OR contains(lower("text"), 'record is empty') AS clean FROM documents""")
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", C.is_permission_denied(t).alias("denied"), C.is_clean_boot_note(t).alias("clean")
    )


@query("levels", sql("rec", """SELECT level, level_rank, CASE level WHEN 'unknown' THEN '?' ELSE upper(level[1]) END AS badge, count(*) AS n FROM rec GROUP BY ALL"""))
def _(spark, sf):
    r = records(spark, sf)
    level = R.level_of_name(F.upper("level"))
    return r.groupBy(
        level.alias("level"), R.level_rank(level).alias("level_rank"), R.level_badge(level).alias("badge")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- counters and views -------------------------------------------------------------------


@query("ring_stats", sql("rec", "SELECT device_serial, session_id, least(count(*), 100) AS len, 100 AS capacity, count(*) AS total_pushed, greatest(count(*) - 100, 0) AS total_dropped FROM rec GROUP BY ALL"))
def _(spark, sf):
    return Q.ring_stats(lines(spark, sf), 100)


@query("capture_counters", sql("rec", r"""SELECT device_serial, session_id, count(*) AS records, count(*) FILTER (NOT parsed) AS unparsed, count(*) FILTER (floor((strlen(raw) - strlen(regexp_replace(raw, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'))) * 100 / strlen(raw)) >= 30) AS "binary" FROM rec GROUP BY ALL"""))
def _(spark, sf):
    return Q.capture_counters(records(spark, sf))


@query("gaps", sql("checks", "SELECT device_serial, session_id, seq, gap_ms FROM gap"))
def _(spark, sf):
    return Q.gaps(records(spark, sf, timed=True))


@query("gap_summary", sql("checks", "SELECT device_serial, session_id, max(gap_ms) AS largest_gap_ms, count(*) AS n_gaps, count(*) FILTER (gap_ms >= 5000) AS n_long_gaps FROM gap GROUP BY ALL"))
def _(spark, sf):
    return Q.gap_summary(Q.gaps(records(spark, sf, timed=True)))


@query("mixed_dates", sql("rec", """SELECT *, count(*) OVER (PARTITION BY device_serial, session_id) AS n_dates, CAST(sum(n) OVER (PARTITION BY device_serial, session_id) AS BIGINT) AS n_total FROM (
  SELECT device_serial, session_id, "timestamp"[1:5] AS date, count(*) AS n FROM rec WHERE "timestamp" IS NOT NULL GROUP BY ALL) QUALIFY count(*) OVER (PARTITION BY device_serial, session_id) >= 2"""))
def _(spark, sf):
    return Q.mixed_dates(records(spark, sf))


@query("tail", sql("rec", "SELECT device_serial, session_id, seq, message FROM rec QUALIFY row_number() OVER (PARTITION BY device_serial, session_id ORDER BY seq DESC) <= 40"))
def _(spark, sf):
    return V.tail(records(spark, sf), 40).select(*KEYS, "seq", "message")


@query("tail_lines", """SELECT doc_id, line_no, line, trimmed FROM (SELECT doc_id, CAST(g - 1 AS BIGINT) AS line_no, l[g] AS line, len(l) > 5 AS trimmed, len(l) AS n FROM (SELECT doc_id, string_split(regexp_replace("text", '\\n$', ''), chr(10)) AS l FROM documents WHERE "text" <> ''), LATERAL (SELECT unnest(generate_series(1, len(l))) AS g)) WHERE line_no >= n - 5""")
def _(spark, sf):
    t = LN.explode_lines(table(spark, sf, "documents").select("doc_id", "text"))
    out = V.tail_lines(t, 5, keys=["doc_id"])
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line", "trimmed")


@query("incremental_lines", scene_sql("polls", """SELECT p.device_serial, p.poll_no, p.line_no, p.line FROM polls p WHERE NOT EXISTS (SELECT 1 FROM polls q WHERE q.device_serial = p.device_serial AND q.poll_no = p.poll_no - 1 AND q.line = p.line)"""))
def _(spark, sf):
    return V.incremental_lines(of(spark, sf, "polls")).select("device_serial", "poll_no", "line_no", "line")


@query("line_fingerprint", "SELECT count(*) AS n, count(DISTINCT line) AS n_distinct FROM (" + sql("lines", "SELECT line FROM lines") + ")")
def _(spark, sf):
    return lines(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.xxhash64("line")).alias("n_distinct")
    )


# --- exports ----------------------------------------------------------------------------

_LINE = """coalesce("timestamp", '-') || ' ' || CASE level WHEN 'unknown' THEN '?' ELSE upper(level[1]) END || ' ' || coalesce(CAST(pid AS VARCHAR), '-') || ' ' || coalesce(CAST(tid AS VARCHAR), '-') || ' ' || coalesce(tag, '-') || ': ' || message"""


@query("export_line", sql("rec", f"SELECT device_serial, session_id, seq, {_LINE} AS line FROM rec"))
def _(spark, sf):
    return records(spark, sf).select(*KEYS, "seq", X.to_export_line().alias("line"))


@query("export_log", sql("rec", """SELECT device_serial, session_id, CASE WHEN parsed THEN coalesce("timestamp", repeat(' ', 18)) || ' ' || lpad(coalesce(CAST(pid AS VARCHAR), ''), 5, ' ') || ' ' || lpad(coalesce(CAST(tid AS VARCHAR), ''), 5, ' ') || ' ' ||
  CASE level WHEN 'unknown' THEN '?' ELSE upper(level[1]) END || ' ' || coalesce(tag, '') || ': ' || message ELSE raw END AS line FROM rec"""))
def _(spark, sf):
    path = scratch_path(spark, "log")
    X.export_log(records(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("export_csv", sql("rec", """SELECT seq, "timestamp", level, pid, tid, uid, tag, source, message FROM rec"""))
def _(spark, sf):
    path = scratch_path(spark, "csv")
    X.export_csv(records(spark, sf), path)
    schema = ("seq bigint, timestamp string, level string, pid int, tid int, uid int, tag string, "
              "package string, source string, message string")
    back = spark.read.schema(schema).csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return back.drop("package")


@query("export_json", sql("rec", """SELECT CAST(seq AS VARCHAR) AS seq, coalesce("timestamp", '') AS "timestamp", level, coalesce(CAST(pid AS VARCHAR), '') AS pid, coalesce(tag, '') AS tag, source, message, received_at_ms AS "receivedAtMs", session_id AS "sessionId" FROM rec"""))
def _(spark, sf):
    path = scratch_path(spark, "json")
    X.export_json(records(spark, sf), path)
    schema = "seq string, timestamp string, level string, pid string, tag string, source string, message string, receivedAtMs bigint, sessionId string"
    return spark.read.schema(schema).json(path)


@query("stored_records", sql("rec", "SELECT device_serial, session_id, seq, tag FROM rec WHERE tag = 'lmkd' AND device_serial = 'dev1'"))
def _(spark, sf):
    path = scratch_path(spark, "records")
    X.write_records(records(spark, sf), path)
    stored = spark.read.parquet(path)
    return stored.where((F.col("device_serial") == "dev1") & FR.scan_hints(tags=["lmkd"])).select(*KEYS, "seq", "tag")


@query("text_helpers", """SELECT event_id, nullif(trim(split_part(props, ': ', 2)), '') AS after_colon, try_cast(regexp_extract(props, ': (\\d+)', 1) AS INTEGER) AS number FROM events""")
def _(spark, sf):
    p = F.col("props")
    return table(spark, sf, "events").select(
        "event_id", TX.after(p, ": ").alias("after_colon"), TX.number_after(p, ": ").alias("number")
    )
