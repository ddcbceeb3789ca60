"""Shared inputs and oracle building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackfall.session import configure
from stackfall.sources.lines import parse_records

from .scenes import YEAR, duck_sql, scene

KEYS = ("device_serial", "session_id")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    return scene(spark, sf, "lines")


def records(spark: SparkSession, sf: str, *, timed: bool = False) -> DataFrame:
    return parse_records(lines(spark, sf), YEAR if timed else None)


def of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return scene(spark, sf, name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def joined(name: str, sep: str = "|") -> Column:
    """An array column as text, for comparison."""
    return F.array_join(F.col(name).cast("array<string>"), sep).alias(name)


# --- oracle building blocks (DuckDB) -----------------------------------------------------


def _level(letter: str) -> str:
    return (
        f"CASE {letter} WHEN 'V' THEN 'verbose' WHEN 'D' THEN 'debug' WHEN 'I' THEN 'info' "
        f"WHEN 'W' THEN 'warn' WHEN 'E' THEN 'error' WHEN 'F' THEN 'fatal' WHEN 'A' THEN 'fatal' "
        f"ELSE 'unknown' END"
    )


def _digit(n: str) -> str:
    return (
        f"CASE WHEN {n} % 8 <= 3 THEN 'error' WHEN {n} % 8 = 4 THEN 'warn' "
        f"WHEN {n} % 8 <= 6 THEN 'info' ELSE 'debug' END"
    )


RANK = (
    "CASE {l} WHEN 'verbose' THEN 0 WHEN 'debug' THEN 1 WHEN 'info' THEN 2 WHEN 'warn' THEN 3 "
    "WHEN 'error' THEN 4 WHEN 'fatal' THEN 5 ELSE 6 END"
)
_SUB = r"'^\s*([A-Za-z0-9_./-]+(?: [A-Za-z0-9_./-]+)?)\s*:\s*(.*)$'"

LINES = f"lines AS ({duck_sql('lines')})"

#: tt / br / dm / km: the four grammars over every line (NULL ``ok`` when they do not match)
GRAMMARS = rf"""tt AS (SELECT *, regexp_matches(line, '^\d\d-\d\d +\d\d:\d\d:\d\d\.\d+ +(?:\S+ +)?\d+ +\d+ [VDIWEFSA] [^ :]+ *:') AS ok,
  regexp_extract(line, '^(\d\d-\d\d) +(\d\d:\d\d:\d\d\.\d+) +(?:(\S+) +)?(\d+) +(\d+) ([VDIWEFSA]) ([^ :]+) *: ?(.*)$',
    ['dt', 'tm', 'uid', 'pid', 'tid', 'lv', 'tag', 'msg']) AS m FROM lines),
threadtime AS (SELECT device_serial, session_id, seq, ok, {_level("m.lv")} AS level, m.dt || ' ' || m.tm AS "timestamp",
  try_cast(m.pid AS INTEGER) AS pid, try_cast(m.tid AS INTEGER) AS tid, try_cast(m.uid AS INTEGER) AS uid, m.tag AS tag, m.msg AS message FROM tt),
br AS (SELECT *, regexp_extract(line, '^([VDIWEFSA])/([^(:]+)(?:\( *(\d+)\))?: ?(.*)$', ['lv', 'tag', 'pid', 'msg']) AS m,
  regexp_matches(line, '^[VDIWEFSA]/[^(:]+(?:\( *\d+\))?:') AS ok FROM lines),
brief AS (SELECT device_serial, session_id, seq, ok, {_level("m.lv")} AS level, try_cast(m.pid AS INTEGER) AS pid, trim(m.tag) AS tag, m.msg AS message FROM br),
dm AS (SELECT *, regexp_extract(line, '^(?:<(\d+)>)?\s*(?:\[ *([0-9.]+)\])?\s*(.*)$', ['n', 'up', 'body']) AS m,
  regexp_matches(line, '^(?:<\d+>|\[ *[0-9.]+\])') AS ok FROM lines),
dm2 AS (SELECT *, regexp_extract(m.body, {_SUB}, ['tag', 'msg']) AS b FROM dm),
dmesg AS (SELECT device_serial, session_id, seq, ok,
  CASE WHEN m.n = '' THEN 'info' ELSE {_digit("try_cast(m.n AS INTEGER)")} END AS level, try_cast(m.up AS DOUBLE) AS uptime_seconds,
  CASE WHEN b.tag <> '' AND strlen(b.tag) <= 24 THEN b.tag END AS tag,
  CASE WHEN b.tag <> '' AND strlen(b.tag) <= 24 THEN b.msg ELSE m.body END AS message FROM dm2),
km AS (SELECT *, regexp_extract(line, '^(\d+),(\d+),(\d+),([^,;]*);\s*(.*)$', ['n', 'sq', 'us', 'fl', 'body']) AS m,
  regexp_matches(line, '^\d+,\d+,\d+,[^,;]*;') AS ok FROM lines),
km2 AS (SELECT *, regexp_extract(m.body, {_SUB}, ['tag', 'msg']) AS b FROM km),
kmsg AS (SELECT device_serial, session_id, seq, ok, {_digit("try_cast(m.n AS INTEGER)")} AS level, try_cast(m.us AS DOUBLE) / 1000000 AS uptime_seconds,
  CASE WHEN b.tag <> '' AND strlen(b.tag) <= 24 THEN b.tag END AS tag,
  CASE WHEN b.tag <> '' AND strlen(b.tag) <= 24 THEN b.msg ELSE m.body END AS message FROM km2)"""

#: rec: parsed records of every source
RECORDS = rf"""pick AS (SELECT l.*, CASE
    WHEN source = 'logcat' AND t.ok THEN 'tt' WHEN source = 'logcat' AND b.ok THEN 'br'
    WHEN source = 'dmesg' AND d.ok THEN 'dm' WHEN source = 'dmesg' AND k.ok THEN 'km'
    WHEN source = 'kmsg' AND k.ok THEN 'km' WHEN source = 'kmsg' AND d.ok THEN 'dm' END AS g,
  t AS tr, b AS brr, d AS dr, k AS kr
  FROM lines l JOIN threadtime t USING (seq) JOIN brief b USING (seq) JOIN dmesg d USING (seq) JOIN kmsg k USING (seq)),
rec0 AS (SELECT device_serial, session_id, seq, source, received_at_ms, line AS raw, g IS NOT NULL AS parsed,
  CASE g WHEN 'tt' THEN tr.level WHEN 'br' THEN brr.level WHEN 'dm' THEN dr.level WHEN 'km' THEN kr.level ELSE 'unknown' END AS level,
  CASE g WHEN 'tt' THEN tr."timestamp" END AS "timestamp",
  CASE g WHEN 'dm' THEN dr.uptime_seconds WHEN 'km' THEN kr.uptime_seconds END AS uptime_seconds,
  CASE g WHEN 'tt' THEN tr.pid WHEN 'br' THEN brr.pid END AS pid, CASE g WHEN 'tt' THEN tr.tid END AS tid, CASE g WHEN 'tt' THEN tr.uid END AS uid,
  CASE g WHEN 'tt' THEN tr.tag WHEN 'br' THEN brr.tag WHEN 'dm' THEN dr.tag WHEN 'km' THEN kr.tag END AS tag,
  CASE g WHEN 'tt' THEN tr.message WHEN 'br' THEN brr.message WHEN 'dm' THEN dr.message WHEN 'km' THEN kr.message ELSE line END AS message
  FROM pick),
rec AS (SELECT *, {RANK.replace("{l}", "level")} AS level_rank,
  row_number() OVER (PARTITION BY device_serial, session_id ORDER BY seq) - 1 AS line_index,
  try_strptime('{YEAR}-' || "timestamp", '%Y-%m-%d %H:%M:%S.%g') AS device_ts FROM rec0)"""

_FAMILY_RULES = (
    ("kernelPanic", "(t LIKE '%kernel panic%' OR t LIKE '%panic - not syncing%' OR t LIKE '%panic\\_on\\_oops%' ESCAPE '\\') AND t NOT LIKE '%no kernel panic%'"),
    ("systemServer", "t LIKE '%watchdog killing system process%' OR contains(t, 'system_server died') OR contains(t, 'system_server crash') OR t LIKE '%crash of system server%' OR t LIKE '%system server crash%'"),
    ("systemServer", "contains(t, 'system_server') AND (t LIKE '%fatal signal%' OR t LIKE '%fatal exception%' OR t LIKE '%died%' OR t LIKE '%sigsegv%' OR t LIKE '%abort%')"),
    ("lowMemory", "(t LIKE '%lowmemorykiller%' OR t LIKE '%lmkd%' OR t LIKE '%low memory killer%' OR contains(t, 'killing ''') OR t LIKE '%to free %') AND (t LIKE '%kill%' OR t LIKE '%free%' OR t LIKE '%reclaim%' OR t LIKE '%oom%' OR t LIKE '%adj:%' OR t LIKE '%lmkd%')"),
    ("watchdog", "t LIKE '%watchdog bite%' OR t LIKE '%hard lockup%' OR t LIKE '%soft lockup%' OR t LIKE '%watchdog:%' OR t LIKE '%watchdog reset%' OR contains(t, '*** watchdog')"),
    ("kernelBug", "t LIKE '%kernel bug at%' OR contains(t, 'bug_on') OR t LIKE '%bug: unable to handle%'"),
    ("oops", "t LIKE '%unable to handle kernel%' OR t LIKE '%internal error: oops%' OR t LIKE '%oops: %' OR t LIKE '%kernel oops%'"),
    ("anr", "t LIKE '%anr in %' OR contains(t, 'am_anr:') OR t LIKE '%anr: %' OR t LIKE '%application not responding%' OR t LIKE '%input dispatching timed out%'"),
    ("nativeCrash", "t LIKE '%fatal signal%' OR t LIKE '%fatal exception%' OR t LIKE '%tombstone%' OR t LIKE '%backtrace:%' OR contains(t, 'signal 11 (sigsegv)') OR contains(t, 'signal 6 (sigabrt)') OR contains(t, 'signal 7 (sigbus)') OR t LIKE '%beginning of crash%'"),
)


def family(text: str) -> str:
    """CASE for the crash family of a text expression."""
    whens = " ".join(f"WHEN {rule} THEN '{kind}'" for kind, rule in _FAMILY_RULES)
    return f"CASE {whens} END".replace("t LIKE", f"lower({text}) LIKE").replace(
        "t NOT LIKE", f"lower({text}) NOT LIKE"
    ).replace("contains(t,", f"contains(lower({text}),")


_PKG = r"(?:^|[\s,{}/:])([A-Za-z][A-Za-z0-9._]*\.[A-Za-z0-9._]*)(?:$|[\s,{}/:])"

#: sig: activity-manager signals; ``ms`` is the millisecond of the day
SIGNALS = rf"""s0 AS (SELECT device_serial, session_id, seq, line_index, raw, CASE
    WHEN raw LIKE '%[%' AND contains(raw, 'am_crash:') THEN 'amCrash' WHEN raw LIKE '%[%' AND contains(raw, 'am_anr:') THEN 'amAnr'
    WHEN raw LIKE '%[%' AND contains(raw, 'am_proc_died:') THEN 'amProcDied' WHEN raw LIKE '%[%' AND contains(raw, 'am_kill:') THEN 'amKill'
    WHEN raw LIKE '%[%' AND contains(raw, 'am_proc_start:') THEN 'amProcStart'
    WHEN contains(raw, 'isCrashing=') THEN 'isCrashing' WHEN contains(raw, 'ProcessRecord{{') THEN 'processRecord'
    WHEN contains(raw, 'Force finishing activity') THEN 'forceFinish' WHEN contains(raw, 'Force stopping ') THEN 'forceStop'
    WHEN regexp_matches(raw, 'Killing \d+:') THEN 'killing' WHEN contains(raw, 'has died') THEN 'processDied'
    WHEN contains(raw, 'ANR in ') THEN 'anrIn' WHEN contains(raw, 'Scheduling restart of crashed service') THEN 'restart' END AS kind,
  string_split(regexp_extract(raw, '\[([^\]]*)', 1), ',') AS f,
  nullif(regexp_extract(raw, '{_PKG}', 1), '') AS pkg FROM rec),
sig AS (SELECT device_serial, session_id, seq, line_index, kind,
  CASE WHEN kind LIKE 'am%' THEN coalesce(nullif(trim(f[3]), ''), pkg) WHEN kind IN ('isCrashing', 'processRecord', 'restart') THEN pkg
    WHEN kind = 'forceFinish' THEN split_part(regexp_extract(raw, 'Force finishing activity (.*)$', 1), '/', 1)
    WHEN kind = 'killing' THEN split_part(regexp_extract(raw, 'Killing \d+:(.*)$', 1), '/', 1)
    WHEN kind = 'anrIn' THEN regexp_extract(raw, 'ANR in (\S+)', 1) END AS process,
  CASE WHEN kind LIKE 'am%' THEN try_cast(trim(f[2]) AS INTEGER) WHEN kind IN ('isCrashing', 'processRecord') THEN try_cast(regexp_extract(raw, 'ProcessRecord\{{\S+ (\d+):', 1) AS INTEGER)
    WHEN kind = 'killing' THEN try_cast(regexp_extract(raw, 'Killing (\d+):', 1) AS INTEGER) END AS pid,
  CASE WHEN kind LIKE 'am%' AND try_cast(trim(f[4]) AS INTEGER) > 0 THEN try_cast(trim(f[4]) AS INTEGER) END AS uid,
  CASE WHEN kind = 'amKill' THEN list_last(list_filter(list_transform(f, lambda x: trim(x)), lambda x: contains(x, ' '))) WHEN kind = 'killing' THEN regexp_extract(raw, '.*\): (.*)$', 1) END AS reason,
  CASE WHEN kind = 'isCrashing' THEN contains(raw, 'isCrashing=true') END AS crashing,
  CASE WHEN regexp_matches(raw, '^\d\d-\d\d \d\d:\d\d:\d\d\.\d\d\d') THEN
    ((CAST(raw[7:8] AS BIGINT) * 60 + CAST(raw[10:11] AS BIGINT)) * 60 + CAST(raw[13:14] AS BIGINT)) * 1000 + CAST(raw[16:18] AS BIGINT) END AS ms
  FROM s0 WHERE kind IS NOT NULL AND NOT (kind = 'processRecord' AND pkg IS NULL))"""

_PKG_Q = r"(?:^|[\s,{}/:''])([A-Za-z][A-Za-z0-9._]*\.[A-Za-z0-9._]*)(?:$|[\s,{}/:''])"

#: anomaly: resource anomalies
ANOMALIES = rf"""a0 AS (SELECT device_serial, session_id, seq, line_index, raw, CASE
    WHEN (contains(raw, 'lowmemorykiller') OR contains(raw, 'lmkd')) AND (contains(raw, 'Killing') OR contains(raw, 'Kill ')) THEN 'lowMemoryKill'
    WHEN contains(raw, 'OutOfMemoryError') OR contains(raw, 'Failed to allocate') THEN 'outOfMemory'
    WHEN contains(raw, 'EMFILE') OR contains(raw, 'Too many open files') OR contains(raw, 'fdsan') OR contains(raw, 'FileDescriptorLimit') THEN 'fdExhaustion'
    WHEN contains(raw, 'pthread_create') OR contains(raw, 'unable to create thread') OR contains(raw, 'Thread creation failed') OR contains(raw, 'OutOfResources: thread') THEN 'threadExhaustion'
    WHEN contains(raw, 'TransactionTooLargeException') OR contains(raw, 'Binder transaction failed') OR contains(raw, 'binder transaction failed') OR contains(raw, 'DeadSystemException')
      OR contains(raw, 'Failed to find prepared transaction') THEN 'binderFailure' END AS kind FROM rec),
anomaly AS (SELECT device_serial, session_id, seq, line_index, kind, CASE kind WHEN 'binderFailure' THEN 'warning' ELSE 'critical' END AS severity,
  coalesce(nullif(trim(regexp_extract(raw, '^[^'']*''([^'']*)''', 1)), ''), nullif(regexp_extract(raw, '{_PKG_Q}', 1), '')) AS process,
  try_cast(regexp_extract(raw, '^[^(]*\((\d+)', 1) AS INTEGER) AS pid,
  trim(CASE kind WHEN 'lowMemoryKill' THEN raw[strpos(raw, 'Kill '):] WHEN 'outOfMemory' THEN raw[strpos(raw, 'OutOfMemoryError'):]
    WHEN 'threadExhaustion' THEN raw[strpos(raw, 'pthread_create'):] ELSE raw[strpos(raw, 'TransactionTooLargeException'):] END) AS detail
  FROM a0 WHERE kind IS NOT NULL)"""

_W = "PARTITION BY device_serial, session_id ORDER BY seq"

#: vlink: one row per linked victim; clink: links merged per (source, victim)
LINKS = rf"""g0 AS (SELECT *, row_number() OVER ({_W}) - 1 AS pos, kind IN ('amCrash', 'amAnr', 'isCrashing', 'anrIn') AND coalesce(crashing, true) AS src,
  lag(ms) OVER ({_W}) AS prev FROM sig),
g1 AS (SELECT *, ms + 86400000 * sum(CASE WHEN ms + 60000 < prev THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS at_ms,
  last_value(CASE WHEN NOT src AND process IS NOT NULL THEN {{'p': process, 'i': pid}} END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ctx FROM g0),
src AS (SELECT *, coalesce(process, ctx.p) AS name, coalesce(pid, ctx.i) AS name_pid FROM g1 WHERE src AND coalesce(process, ctx.p) IS NOT NULL),
firsts AS (SELECT device_serial, session_id, name, min(pos) AS at FROM src GROUP BY ALL),
vic AS (SELECT g1.* FROM g1 LEFT JOIN firsts f ON f.device_serial = g1.device_serial AND f.session_id = g1.session_id AND f.name = g1.process
  WHERE g1.kind IN ('forceFinish', 'forceStop', 'killing', 'processDied', 'amProcDied') AND g1.process IS NOT NULL AND (f.at IS NULL OR f.at > g1.pos)),
pairs AS (SELECT v.device_serial, v.session_id, v.pos, v.seq, s.name AS source, s.name_pid AS source_pid, v.process AS victim, v.pid AS victim_pid, v.kind AS victim_kind,
  v.at_ms - s.at_ms AS gap_ms, s.line_index AS source_line, v.line_index AS victim_line, s.pos AS spos,
  (lower(coalesce(v.reason, '')) LIKE '%crash%' OR lower(coalesce(v.reason, '')) LIKE '%anr%' OR lower(coalesce(v.reason, '')) LIKE '%error%') AND abs(v.at_ms - s.at_ms) <= 2000 AS confirmed
  FROM vic v JOIN src s ON s.device_serial = v.device_serial AND s.session_id = v.session_id AND s.pos < v.pos AND s.name <> v.process
    AND greatest(v.pos - s.line_index, 0) <= 60 AND (v.at_ms IS NULL OR s.at_ms IS NULL OR abs(v.at_ms - s.at_ms) <= 5000)),
vlink AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY device_serial, session_id, pos ORDER BY spos DESC) = 1),
clink AS (SELECT device_serial, session_id, source, victim, arg_min({{'s': source_pid, 'v': victim_pid}}, pos).s AS source_pid, arg_min({{'s': source_pid, 'v': victim_pid}}, pos).v AS victim_pid,
  CASE WHEN bool_or(confirmed) THEN 'confirmed' ELSE 'likely' END AS confidence,
  coalesce(arg_max(gap_ms, pos) FILTER (confirmed), arg_min(gap_ms, pos)) AS gap_ms,
  coalesce(arg_max(source_line, pos) FILTER (confirmed), arg_min(source_line, pos)) AS source_line,
  coalesce(arg_max(victim_line, pos) FILTER (confirmed), arg_min(victim_line, pos)) AS victim_line FROM vlink GROUP BY ALL)"""

#: blk: rows of crash blocks (start_seq); evt: the events of the live rule
BLOCKS = rf"""k0 AS (SELECT *, regexp_extract(raw, '^\d\d-\d\d \S+ +\d+ +\d+ \S (\S*):(?:\s|$)', 1) AS btag,
  CASE WHEN regexp_matches(raw, '^\d\d-\d\d \d\d:\d\d:\d\d\.\d+ +\d+\s') AND contains(raw[19:], ': ') THEN ltrim(regexp_extract(raw[19:], '^.*?: (.*)$', 1), chr(9) || ' ')
    ELSE ltrim(raw) END AS body FROM rec),
k1 AS (SELECT *, contains(body, 'FATAL EXCEPTION:') OR body LIKE 'FATAL EXCEPTION%' OR body LIKE '*** FATAL%' OR body LIKE '*** *** ***%' OR (body LIKE 'signal %' AND contains(body, 'SIG'))
    OR body LIKE 'Abort message:%' OR body LIKE 'backtrace:%' AS starts,
  regexp_matches(body, '^(at |Caused by:|Suppressed:|#|\.\.\. |Abort message:|backtrace:|signal |pid: |Process: |PID: |Build fingerprint:|Cmd line:|-----|DALVIK THREADS)')
    OR regexp_matches(body, '^[A-Za-z0-9._$]*\.[A-Za-z0-9._$]*(:|$)') OR regexp_matches(raw, '^\s+\S') OR raw LIKE '-----%' AS goes FROM k0),
k2 AS (SELECT *, last_value(CASE WHEN starts THEN {{'s': seq, 't': btag}} END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS o FROM k1),
k3 AS (SELECT *, last_value(CASE WHEN NOT starts AND NOT goes AND NOT (btag <> '' AND btag = o.t) THEN seq END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS cut FROM k2),
blk AS (SELECT *, o.s AS start_seq, row_number() OVER (PARTITION BY device_serial, session_id, o.s ORDER BY seq) - 1 AS line_no
  FROM k3 WHERE o IS NOT NULL AND (cut IS NULL OR cut < o.s))"""

LIVE = rf"""v0 AS (SELECT *, message AS body, contains(message, 'FATAL EXCEPTION') AS starts,
  regexp_matches(message, '^(at |Caused by:|Process: |PID: |#|\.\.\. )') OR regexp_matches(message, '^\s+\S') OR regexp_matches(message, '^[A-Za-z0-9._$]*\.[A-Za-z0-9._$]*(:|$)') AS goes
  FROM rec WHERE tag IN ('ActivityManager', 'AndroidRuntime', 'DEBUG', 'libc', 'art', 'fdsan', 'lowmemorykiller', 'lmkd', 'JavaBinder', 'Binder', 'Watchdog', 'system_server') OR tag LIKE 'am\_%' ESCAPE '\'),
v1 AS (SELECT *, last_value(CASE WHEN starts THEN seq END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS o FROM v0),
v2 AS (SELECT *, last_value(CASE WHEN NOT starts AND NOT goes THEN seq END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS cut FROM v1),
lrow AS (SELECT *, CASE WHEN o IS NOT NULL AND (cut IS NULL OR cut < o) THEN o END AS start_seq FROM v2),
lblk AS (SELECT *, ltrim(message, chr(9) || ' ') AS body2, row_number() OVER (PARTITION BY device_serial, session_id, start_seq ORDER BY seq) - 1 AS line_no FROM lrow WHERE start_seq IS NOT NULL)"""


def events_of(block: str, body: str, text: str) -> str:
    """evt: events of a block relation with a body column (first/last wins)."""
    return rf"""e0 AS (SELECT *, CASE WHEN {body} LIKE 'Process: %' THEN trim(split_part({body}[10:], ',', 1)) END AS p_named,
  CASE WHEN contains({body}, 'PID: ') THEN try_cast(regexp_extract({body}, 'PID: (\d+)', 1) AS INTEGER) END AS p_pid,
  CASE WHEN contains({body}, 'FATAL EXCEPTION: ') THEN trim(split_part({body}, 'FATAL EXCEPTION: ', 2)) END AS p_thread,
  CASE WHEN {body} LIKE 'at %' OR {body} LIKE '#%' OR {body} LIKE '... %' THEN {body} END AS p_frame,
  CASE WHEN {body} LIKE 'Caused by:%' THEN {body} END AS p_cause,
  CASE WHEN regexp_matches({body}, '^[A-Za-z0-9._$]*\.[A-Za-z0-9._$]*(:|$)') THEN trim(split_part({body}, ':', 1)) END AS p_exc,
  CASE WHEN regexp_matches({body}, '^[A-Za-z0-9._$]*\.[A-Za-z0-9._$]*(:|$)') THEN nullif(trim({body}[strpos({body}, ':') + 1:]), '') END AS p_msg FROM {block}),
e1 AS (SELECT device_serial, session_id, start_seq, arg_max(p_named, line_no) FILTER (p_named IS NOT NULL) AS process,
  arg_min(p_pid, line_no) FILTER (p_pid IS NOT NULL) AS pid, arg_min(p_thread, line_no) FILTER (p_thread IS NOT NULL) AS thread,
  arg_min(p_exc, line_no) FILTER (p_exc IS NOT NULL) AS exception, arg_min_null(p_msg, line_no) FILTER (p_exc IS NOT NULL) AS message,
  coalesce(string_agg(p_frame, '|' ORDER BY line_no), '') AS frames, coalesce(string_agg(p_cause, '|' ORDER BY line_no), '') AS caused_by,
  string_agg({text}, chr(10) ORDER BY line_no) AS all_text, count(*) AS n_lines, count(p_frame) AS n_frames FROM e0 GROUP BY ALL),
evt AS (SELECT *, 'crashBuffer#' || start_seq AS event_id, {family("all_text")} AS kind FROM e1)"""


#: story: stories of the live events, with episodes, victims and counts
STORIES = r"""pidmap AS (SELECT device_serial, session_id, pid, arg_max(process, line_index) AS identity, arg_max(uid, line_index) FILTER (uid IS NOT NULL) AS pid_uid,
  min(line_index) AS first_line, max(line_index) AS last_line, bool_or(kind IN ('amProcStart', 'processRecord')) AS started
  FROM sig WHERE process IS NOT NULL AND pid IS NOT NULL GROUP BY ALL),
namemap AS (SELECT device_serial, session_id, process AS identity, min(line_index) AS first_line, arg_max(uid, line_index) FILTER (uid IS NOT NULL) AS uid
  FROM sig WHERE process IS NOT NULL GROUP BY ALL),
ident AS (SELECT e.*, coalesce(e.process, p.identity) AS identity, p.pid_uid, p.first_line AS pid_first FROM evt e LEFT JOIN pidmap p USING (device_serial, session_id, pid)),
placed AS (SELECT i.*, coalesce(i.pid_first, n.first_line) AS position FROM ident i LEFT JOIN namemap n USING (device_serial, session_id, identity)),
owned AS (SELECT device_serial, session_id, identity, count(*) AS n_crashes, min(position) AS f, max(position) AS l, arg_min(pid_uid, start_seq) FILTER (pid_uid IS NOT NULL) AS pid_uid
  FROM placed WHERE identity IS NOT NULL GROUP BY ALL),
episode AS (SELECT p.* FROM pidmap p SEMI JOIN owned o USING (device_serial, session_id, identity)),
espan AS (SELECT device_serial, session_id, identity, count(*) AS n_episodes, min(first_line) AS f, max(last_line) AS l FROM episode GROUP BY ALL),
taken AS (SELECT c.device_serial, c.session_id, c.source AS identity, count(*) AS n_victims, min(source_line) AS f, max(victim_line) AS l
  FROM clink c SEMI JOIN owned o ON c.device_serial = o.device_serial AND c.session_id = o.session_id AND c.source = o.identity GROUP BY ALL),
story AS (SELECT o.device_serial, o.session_id, o.identity, coalesce(n.uid, o.pid_uid) AS uid, o.n_crashes, coalesce(e.n_episodes, 0) AS n_episodes,
  greatest(coalesce(e.n_episodes, 0) - 1, 0) AS restarts, coalesce(t.n_victims, 0) AS n_victims, least(o.f, e.f, t.f) AS first_line, greatest(o.l, e.l, t.l) AS last_line
  FROM owned o LEFT JOIN espan e USING (device_serial, session_id, identity) LEFT JOIN taken t USING (device_serial, session_id, identity) LEFT JOIN namemap n USING (device_serial, session_id, identity))"""

#: gap: positive gaps; checks: the six checks of every session
INTEGRITY = rf"""sess AS ({duck_sql("sessions")}),
profile AS ({duck_sql("profile")}),
gap0 AS (SELECT device_serial, session_id, seq, epoch_ms(device_ts) - epoch_ms(lag(device_ts) OVER ({_W})) AS gap_ms FROM rec WHERE device_ts IS NOT NULL),
gap AS (SELECT * FROM gap0 WHERE gap_ms > 0),
req AS (SELECT device_serial, session_id, list_distinct(list_filter(flatten(list_transform(regexp_extract_all(command, '(?:^|\s)-b ?(\S+)', 1), lambda x: string_split(x, ','))), lambda x: x <> '')) AS r FROM sess),
hav AS (SELECT device_serial, list(DISTINCT split_part(line, ':', 1)) FILTER (contains(line, 'ring buffer')) AS a FROM profile GROUP BY ALL),
buf AS (SELECT q.*, a, CASE WHEN a IS NOT NULL AND len(a) > 0 THEN list_filter(r, lambda x: NOT list_contains(a, x)) END AS missing FROM req q LEFT JOIN hav h USING (device_serial)),
c0 AS (SELECT device_serial, session_id, count(*) AS n, count(*) FILTER (NOT parsed) AS u FROM rec GROUP BY ALL),
c1 AS (SELECT device_serial, session_id, max(gap_ms) AS g, count(*) FILTER (gap_ms >= 5000) AS ng FROM gap GROUP BY ALL),
c2 AS (SELECT device_serial, session_id, count(*) AS nc, count(*) FILTER (n_frames = 0) AS ns FROM evt GROUP BY ALL),
c3 AS (SELECT s.device_serial, s.session_id, coalesce(n, 0) AS n, coalesce(u, 0) AS u, coalesce(g, 0) AS g, coalesce(ng, 0) AS ng, coalesce(nc, 0) AS nc, coalesce(ns, 0) AS ns, missing,
    CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE coalesce(u, 0) / n END AS share
  FROM sess s LEFT JOIN c0 USING (device_serial, session_id) LEFT JOIN c1 USING (device_serial, session_id) LEFT JOIN c2 USING (device_serial, session_id) LEFT JOIN buf USING (device_serial, session_id)),
checks AS (
  SELECT device_serial, session_id, 'records' AS id, CASE WHEN n = 0 THEN 'notice' ELSE 'ok' END AS status, CAST(n AS DOUBLE) AS value FROM c3
  UNION ALL SELECT device_serial, session_id, 'dropped', 'ok', 0.0 FROM c3
  UNION ALL SELECT device_serial, session_id, 'unparsed', CASE WHEN share >= 0.1 THEN 'warning' WHEN share >= 0.01 THEN 'notice' ELSE 'ok' END, share FROM c3
  UNION ALL SELECT device_serial, session_id, 'buffers', CASE WHEN missing IS NULL THEN 'notice' WHEN len(missing) > 0 THEN 'warning' ELSE 'ok' END, CAST(len(missing) AS DOUBLE) FROM c3
  UNION ALL SELECT device_serial, session_id, 'gaps', CASE WHEN g >= 30000 THEN 'warning' WHEN g >= 5000 THEN 'notice' ELSE 'ok' END, CAST(g AS DOUBLE) FROM c3
  UNION ALL SELECT device_serial, session_id, 'stacks', CASE WHEN ns > 0 THEN 'warning' ELSE 'ok' END, CAST(ns AS DOUBLE) FROM c3)"""

#: Relations by name: SQL of common table expressions and what they need.
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "lines": (LINES, ()),
    "grammars": (GRAMMARS, ("lines",)),
    "rec": (RECORDS, ("grammars",)),
    "sig": (SIGNALS, ("rec",)),
    "anomaly": (ANOMALIES, ("rec",)),
    "links": (LINKS, ("sig",)),
    "blk": (BLOCKS, ("rec",)),
    "batch_events": (events_of("blk", "body", "raw"), ("blk",)),
    "live": (LIVE, ("rec",)),
    "live_events": (events_of("lblk", "body2", "message"), ("live",)),
    "stories": (STORIES, ("links", "live_events")),
    "checks": (INTEGRITY, ("live_events",)),
}


def sql(parts: tuple[str, ...] | str, select: str) -> str:
    """``WITH`` the named relations and everything they need, then ``select``."""
    parts = (parts,) if isinstance(parts, str) else parts
    done: list[str] = []

    def need(name: str) -> None:
        if name in done:
            return
        for other in PARTS[name][1]:
            need(other)
        done.append(name)

    for name in parts:
        need(name)
    return "WITH " + ",\n".join(PARTS[n][0] for n in done) + "\n" + select


def scene_sql(names: tuple[str, ...] | str, select: str) -> str:
    """``WITH`` scenes as relations of their own name, then ``select``."""
    names = (names,) if isinstance(names, str) else names
    return "WITH " + ",\n".join(f"{n} AS ({duck_sql(n)})" for n in names) + "\n" + select
