"""Log-shaped inputs derived from the driver tables.

Each scene is one SQL text for both engines; ``{us}``, ``{d}`` and ``{s}`` are replaced by the
engine's microsecond function, integer division and string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackfall.functions.steps import pinned

YEAR = 2024

#: 25-line scenes of an application crash, ten scenes per session, four devices.
LINES = """
WITH b AS (
  SELECT event_id AS seq, event_id {d} 250 AS sess, event_id {d} 25 AS g, event_id % 25 AS t, user_id AS u, event_type AS et,
         84600000 + ({us} - 1704067200000000) {d} 100000 AS ms FROM events),
c AS (
  SELECT *, 'com.app' || CAST(g % 5 AS {s}) || '.main' AS pkg, 'com.app' || CAST((g + 2) % 5 AS {s}) || '.reader' AS vic,
         CAST(2000 + g % 150 AS {s}) AS pid, CAST(7000 + g % 150 AS {s}) AS vpid,
         CASE WHEN ms < 86400000 THEN '09-30' ELSE '10-01' END || ' ' ||
         lpad(CAST((ms {d} 3600000) % 24 AS {s}), 2, '0') || ':' || lpad(CAST((ms {d} 60000) % 60 AS {s}), 2, '0') || ':' ||
         lpad(CAST((ms {d} 1000) % 60 AS {s}), 2, '0') || '.' || lpad(CAST(ms % 1000 AS {s}), 3, '0') AS stamp FROM b),
e AS (
  SELECT *, stamp || '  ' || pid || '  ' || pid || ' ' AS app, stamp || '  1000  1000 ' AS sys FROM c)
SELECT 'dev' || CAST(sess % 4 AS {s}) AS device_serial, 's' || CAST(sess AS {s}) AS session_id, seq,
  CASE WHEN t IN (19, 20) THEN 'dmesg' WHEN t = 21 THEN 'kmsg' ELSE 'logcat' END AS source,
  1704067200000 + ms AS received_at_ms,
  CASE t
    WHEN 0 THEN app || 'E AndroidRuntime: FATAL EXCEPTION: main'
    WHEN 1 THEN app || 'E AndroidRuntime: Process: ' || pkg || ', PID: ' || pid
    WHEN 2 THEN app || 'E AndroidRuntime: ' || CASE u % 4
      WHEN 0 THEN 'java.lang.OutOfMemoryError: Failed to allocate'
      WHEN 1 THEN 'java.lang.IllegalStateException: bad state'
      WHEN 2 THEN 'android.os.TransactionTooLargeException: data parcel size 1234567 bytes'
      ELSE 'java.lang.RuntimeException: Cannot initialize effect engine for type: x' END
    WHEN 3 THEN app || 'E AndroidRuntime: ' || chr(9) || 'at ' || pkg || '.Main.onCreate(Main.java:42)'
    WHEN 4 THEN app || 'E AndroidRuntime: ' || chr(9) || 'at android.app.Activity.performCreate(Activity.java:8000)'
    WHEN 5 THEN app || 'E AndroidRuntime: Caused by: java.lang.IllegalStateException: root'
    WHEN 6 THEN sys || 'I ActivityManager: ProcessRecord{ab ' || pid || ':' || pkg || '/u0a12}'
    WHEN 7 THEN sys || 'I ActivityManager: isCrashing=true'
    WHEN 8 THEN sys || 'I ActivityManager: Force finishing activity ' || vic || '/.MainActivity'
    WHEN 9 THEN sys || 'I ActivityManager: Killing ' || vpid || ':' || vic || '/u0a9 (adj 0): crash'
    WHEN 10 THEN sys || 'I am_proc_died: [0,' || pid || ',' || pkg || ',1000,13]'
    WHEN 11 THEN sys || 'I lmkd: Kill ''' || pkg || ''' (' || pid || '), uid=10012, oom_score_adj=900'
    WHEN 12 THEN app || 'E libc: pthread_create failed: EAGAIN'
    WHEN 13 THEN sys || 'I am_proc_start: [0,' || pid || ',' || pkg || ',10012,activity,' || pkg || '/.S]'
    WHEN 14 THEN sys || 'I am_kill: [0,6666,com.bg.idle,10123,excessive cpu]'
    WHEN 15 THEN app || 'W Chat: hello ' || et
    WHEN 16 THEN app || 'D SurfaceFlinger: frame ' || CAST(u AS {s})
    WHEN 17 THEN '--------- beginning of main'
    WHEN 18 THEN 'W/Chat( ' || pid || '): slow operation'
    WHEN 19 THEN '<3>[   12.345678] binder: transaction failed'
    WHEN 20 THEN CASE WHEN u % 7 = 0 THEN '[    1.000000] Kernel panic - not syncing: Fatal exception' ELSE '<12>healthd: battery l=64' END
    WHEN 21 THEN '6,1234,567890,-;usb 1-1: new device'
    WHEN 22 THEN stamp || ' 10270  ' || pid || ' ' || pid || ' D JavaheapMonitor: Java heap used=3M'
    WHEN 23 THEN app || 'V Chat: noise'
    ELSE CASE WHEN u % 5 = 0 THEN sys || 'E ActivityManager: ANR in ' || pkg ELSE app || 'E Chat: ' || et || ' failed' END
  END AS line
FROM e
"""

#: One row per session of LINES, and one session per device that received nothing.
SESSIONS = """
SELECT DISTINCT 'dev' || CAST(x % 4 AS {s}) AS device_serial, 's' || CAST(x AS {s}) AS session_id, 'logcat' AS source,
  CASE x % 5 WHEN 0 THEN 'logcat -v threadtime -b main,system,crash' WHEN 1 THEN 'logcat -b main -b events,main -v threadtime'
    WHEN 2 THEN 'logcat -v threadtime' WHEN 3 THEN 'logcat -bkernel -b crash' ELSE 'logcat -b events' END AS command,
  1704067200000 + x * 250 AS started_at_ms
FROM (SELECT event_id {d} 250 AS x FROM events UNION ALL SELECT (event_id {d} 2500 + 100000) AS x FROM events) q
"""

#: ``ps -A`` text: polls of each device.
PS = """
WITH p AS (
  SELECT 'dev' || CAST(c_custkey % 4 AS {s}) AS device_serial, c_custkey {d} 200 AS poll, (c_custkey {d} 4) % 50 AS i, c_nationkey AS n FROM customer)
SELECT device_serial, 1704151800000 + poll * 3000000 AS polled_at_ms, i + 1 AS line_no,
  CASE WHEN i % 10 = 9 THEN 'root' WHEN i % 10 = 8 THEN 'system' ELSE 'u0_a' || CAST(10 + i % 7 AS {s}) END || '     ' ||
  CAST(2000 + i * 3 AS {s}) || '   1 ' || CAST(100000 + n AS {s}) || ' 5000 0 0 ' || CASE WHEN i % 4 = 0 THEN 'R' ELSE 'S' END || ' ' ||
  CASE WHEN i % 10 = 9 THEN '[kworker/u16:' || CAST(i AS {s}) || ']' WHEN i % 10 = 8 THEN '/system/bin/service ' || CAST(n AS {s})
       WHEN i % 10 = 7 THEN 'com.app' || CAST(i % 5 AS {s}) || '.main:remote'
       ELSE 'com.app' || CAST(CASE WHEN poll % 3 = 2 THEN i ELSE i * 3 END % 5 AS {s}) || '.main' END AS line
FROM p
UNION ALL
SELECT DISTINCT device_serial, 1704151800000 + poll * 3000000, 0, 'USER       PID  PPID     VSZ    RSS WCHAN ADDR S NAME' FROM p
"""

#: Label listing of every device but dev3.
LABELS = """
SELECT 'dev' || CAST(c_custkey % 4 AS {s}) AS device_serial, c_custkey AS line_no,
  CASE WHEN c_custkey % 17 = 16 OR c_custkey % 4 = 3 THEN c_name
       ELSE 'com.app' || CAST(c_custkey {d} 4 AS {s}) || '.main' || chr(9) ||
            CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment || ' ' || CAST(c_custkey AS {s}) END || chr(9) ||
            CASE WHEN c_custkey % 11 = 0 THEN 'none' ELSE CAST(10000 + c_custkey % 500 AS {s}) END || chr(9) || CAST(c_custkey % 3 AS {s}) END AS line
FROM customer
"""

#: Package dump: a seven-line block per part, packages repeat.
DUMP = """
SELECT 'dev' || CAST(p % 4 AS {s}) AS device_serial, p * 8 + i AS seq,
  CASE i
    WHEN 0 THEN '  Package [com.app' || CAST((p {d} 4) % 200 AS {s}) || '.main] (ab12):'
    WHEN 1 THEN '    codePath=' || CASE WHEN p % 9 = 0 THEN '/system/app/' ELSE '/data/app/' END || 'x'
    WHEN 2 THEN CASE WHEN p % 10 = 3 THEN '    versionName=' ELSE '    versionName=' || CAST(p_size AS {s}) || '.' || CAST(p AS {s}) || ' extra' END
    WHEN 3 THEN '    versionCode=5 minSdk=24 targetSdk=' || CAST(20 + p_size % 14 AS {s})
    WHEN 4 THEN '    firstInstallTime=2024-01-0' || CAST(1 + p % 9 AS {s}) || ' 10:00:00'
    WHEN 5 THEN CASE WHEN p % 13 = 0 THEN '    flags=[ SYSTEM HAS_CODE ]' ELSE '    lastUpdateTime=2024-02-0' || CAST(1 + p % 9 AS {s}) || ' 11:00:00' END
    ELSE '    User 0: ceDataInode=1 installed=true enabled=' || CAST(p_size % 6 AS {s}) || ' instant=false' END AS line
FROM (SELECT p_partkey AS p, p_size FROM part) q
CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) n
"""

#: Three uid listings.
UIDS = """
SELECT 'dev' || CAST(c_custkey % 4 AS {s}) AS device_serial,
  CASE c_custkey % 3 WHEN 0 THEN 'dumpsys' WHEN 1 THEN 'cmd' ELSE 'list' END AS listing,
  CASE WHEN c_custkey % 3 = 0 THEN 'com.app' || CAST(c_custkey {d} 8 AS {s}) || '.main' END AS package,
  c_custkey AS line_no,
  CASE c_custkey % 3
    WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '    userId=' || CAST(10000 + c_custkey AS {s}) || ' gids=[]' ELSE '    versionName=1' END
    WHEN 1 THEN 'package:com.app' || CAST(c_custkey {d} 8 AS {s}) || '.main uid:' || CAST(20000 + c_custkey AS {s})
    ELSE 'com.app' || CAST(c_custkey {d} 8 AS {s}) || '.main ' || CAST(30000 + c_custkey AS {s}) || ' 0 /data/user/0/x default' END AS line
FROM customer
"""

#: ``uname -r`` and ``logcat -g`` lines of devices dev0, dev1, …
PROFILE = """
SELECT 'dev' || CAST(k AS {s}) AS device_serial, CASE WHEN i = 0 THEN 'uname' ELSE 'logcat' END AS command, i AS line_no,
  CASE WHEN i = 0 THEN CASE k % 6 WHEN 0 THEN '5.10.' || CAST(nk AS {s}) || '-android12-9' WHEN 1 THEN '3.4.67-perf' WHEN 2 THEN '3.10.49' WHEN 3 THEN '' WHEN 4 THEN 'custom-kernel' ELSE '4.14_x' END
       WHEN k % 5 = 2 THEN 'logcat: Unable to open' 
       ELSE CASE (i + k) % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'system' WHEN 2 THEN 'crash' WHEN 3 THEN 'events' ELSE 'kernel' END || ': ring buffer is 256Kb (200Kb consumed), max entry is 5120b' END AS line
FROM (SELECT s_suppkey AS k, s_nationkey AS nk FROM supplier) q
CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n
"""

#: Dropbox dumps: eight-line entries, every eleventh without a body.
DROPBOX = """
SELECT 'dev' || CAST((g {d} 50) % 4 AS {s}) AS device_serial, 'b' || CAST(g {d} 50 AS {s}) AS session_id, k AS seq,
  CASE t
    WHEN 0 THEN '========================================'
    WHEN 1 THEN CASE WHEN g % 13 = 5 THEN 'Drop box contents: (!)' ELSE '2024-01-' || lpad(CAST(1 + g % 28 AS {s}), 2, '0') || ' 10:11:12 ' || CASE g % 9
      WHEN 0 THEN 'data_app_crash' WHEN 1 THEN 'system_app_crash' WHEN 2 THEN 'system_server_crash' WHEN 3 THEN 'data_app_anr' WHEN 4 THEN 'data_app_native_crash'
      WHEN 5 THEN 'SYSTEM_TOMBSTONE' WHEN 6 THEN 'system_server_wtf' WHEN 7 THEN 'system_server_watchdog' ELSE 'storage_trim' END ||
      ' (text, ' || CAST(100 + g AS {s}) || ' bytes)' END
    WHEN 2 THEN CASE WHEN g % 11 = 0 THEN '' ELSE 'Process: com.app' || CAST(g % 5 AS {s}) || '.main' END
    WHEN 3 THEN CASE WHEN g % 11 = 0 THEN '  ' ELSE 'PID: ' || CAST(2000 + g % 150 AS {s}) END
    WHEN 4 THEN CASE WHEN g % 11 = 0 THEN '' ELSE 'java.lang.IllegalStateException: bad ' || pr END
    WHEN 5 THEN CASE WHEN g % 11 = 0 THEN '' ELSE chr(9) || 'at com.app.Main.run(Main.java:' || CAST(g % 3 AS {s}) || ')' END
    WHEN 6 THEN CASE WHEN g % 11 = 0 OR g % 4 = 0 THEN '' ELSE chr(9) || 'at android.os.Looper.loop(Looper.java:10)' END
    ELSE '' END AS line
FROM (SELECT o_orderkey AS k, o_orderkey {d} 8 AS g, o_orderkey % 8 AS t, o_orderpriority AS pr FROM orders) q
"""

#: Artifact texts with their read outcome: tombstones, ANR traces, dropbox files, kernel texts.
ARTIFACTS = """
SELECT 'dev' || CAST(p % 4 AS {s}) AS device_serial, 'a' || CAST(p {d} 40 AS {s}) AS session_id, p AS ordinal,
  CASE p % 4 WHEN 0 THEN 'tombstones' WHEN 1 THEN 'anr' WHEN 2 THEN 'dropbox' ELSE 'pstore' END AS dir,
  CASE p % 4 WHEN 0 THEN 'tombstone_' || lpad(CAST(p % 100 AS {s}), 2, '0') || '.' || CAST(p AS {s}) WHEN 1 THEN 'anr_2024-01-' || CAST(p AS {s})
    WHEN 2 THEN CASE WHEN p % 28 = 2 THEN 'no name ' || CAST(p AS {s}) WHEN p % 20 = 6 THEN 'system_app_anr@170406' || CAST(7200000 + p AS {s}) || '.txt' ELSE 'data_app_crash@170406' || CAST(7200000 + p AS {s}) || '.txt' END
    ELSE 'console-ramoops-' || CAST(p AS {s}) END AS name,
  CASE WHEN p % 16 = 15 THEN '' WHEN p % 4 = 0 THEN
      '*** *** *** *** *** *** *** *** *** *** *** *** *** *** *** ***' || chr(10) || 'Build fingerprint: ''x/y/z''' || chr(10) ||
      'pid: ' || CAST(3000 + p AS {s}) || ', tid: ' || CAST(4000 + p AS {s}) || ', name: Thread-' || CAST(p_size AS {s}) || '  >>> com.app' || CAST(p % 5 AS {s}) || '.main <<<' || chr(10) ||
      'signal ' || CASE WHEN p % 8 = 0 THEN '11 (SIGSEGV), code 1 (SEGV_MAPERR), fault addr 0x' || CAST(p AS {s}) ELSE '6 (SIGABRT), code -1 (SI_QUEUE), fault addr --------' END || chr(10) ||
      CASE WHEN p % 12 = 0 THEN 'Abort message: ''FORTIFY: bad ' || p_name || '''' || chr(10) ELSE '' END ||
      'backtrace:' || chr(10) || '    #00 pc 0001 /system/lib/libc.so (abort+1)' || chr(10) || '    #01 pc 0002 /data/lib/libx.so' || chr(10)
    WHEN p % 4 = 1 THEN
      'Subject: wait' || chr(10) || '----- pid ' || CAST(5000 + p AS {s}) || ' at 2024-01-02 03:04:05 -----' || chr(10) || 'Cmd line: com.app' || CAST(p % 5 AS {s}) || '.main' || chr(10) ||
      '"main" prio=5 tid=1 Blocked' || chr(10) || '  at com.app.Main.wait(Main.java:1)' || chr(10) || '----- end ' || CAST(5000 + p AS {s}) || ' -----' || chr(10) ||
      '----- pid ' || CAST(9000 + p AS {s}) || ' at 2024-01-02 03:04:06 -----' || chr(10) || 'Cmd line: system_server' || chr(10) || '"Binder" tid=7' || chr(10)
    WHEN p % 4 = 2 THEN
      'Process: com.app' || CAST(p % 5 AS {s}) || '.main' || chr(10) || 'Flags: 0x1' || chr(10) || chr(10) || 'java.lang.RuntimeException: ' || p_type || chr(10) || chr(9) || 'at com.app.A.b(A.java:' || CAST(p_size AS {s}) || ')' || chr(10)
    ELSE '<6>[    1.5] usb: ' || p_name || chr(10) || '<0>[    2.5] Kernel panic - not syncing: ' || p_brand || chr(10) || chr(10) || chr(1) || chr(2) || chr(3) || 'ab' || chr(10) END AS text,
  CASE WHEN p % 48 = 15 THEN 'cat: Permission denied' WHEN p % 48 = 31 THEN 'No such file or directory' WHEN p % 96 = 47 THEN 'klogctl: dmesg_restrict' ELSE '' END AS error_text,
  CASE WHEN p % 48 IN (15, 31, 47) THEN 1 ELSE 0 END AS exit_code
FROM (SELECT p_partkey AS p, p_name, p_type, p_brand, p_size FROM part) q
"""

#: Overlapping kernel polls: a window of four blocks of 200 events, moving by one.
POLLS = """
SELECT 'dev' || CAST(e % 4 AS {s}) AS device_serial, e {d} 200 + 3 - j AS poll_no, e AS line_no,
  CASE WHEN u % 6 = 0 THEN '<6>[ 1.0] binder: repeated' WHEN u % 50 = 1 THEN '' ELSE '<6>[ ' || CAST(e AS {s}) || '.5] usb 1-' || CAST(u AS {s}) || ': event' END AS line
FROM (SELECT event_id AS e, user_id AS u FROM events) q
CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n
"""

#: Boot polls: one boot per 25 polls of a device.
BOOTS = """
SELECT 'dev' || CAST(x % 4 AS {s}) AS device_serial, x {d} 100 AS boot_id, x {d} 4 AS poll_no, 1704067200000 + (x {d} 4) * 9000 AS polled_at_ms,
  (x {d} 4) % 25 >= 8 + (x {d} 100) % 12 AS booted
FROM (SELECT DISTINCT event_id {d} 50 AS x FROM events) q
"""

#: What a user asked to follow.
INPUTS = """
SELECT 'dev' || CAST(c_custkey % 4 AS {s}) AS device_serial,
  CASE c_custkey % 7 WHEN 0 THEN CAST(2000 + 3 * (c_custkey % 50) AS {s}) WHEN 1 THEN CAST(10010 + c_custkey % 9 AS {s}) WHEN 2 THEN ' com.app' || CAST(c_custkey % 9 AS {s}) || '.main '
    WHEN 3 THEN 'com.missing.x' || CAST(c_custkey AS {s}) WHEN 4 THEN 'bad name!' WHEN 5 THEN CAST(90000 + c_custkey AS {s}) ELSE 'com.app' || CAST(c_custkey AS {s}) || '.main' END AS input
FROM customer
"""

#: States of followed applications: pids per poll.
STATES = """
SELECT 'dev' || CAST(e % 4 AS {s}) AS device_serial, 'com.app' || CAST((e {d} 4) % 5 AS {s}) || '.main' AS package, 1704067200000 + (e {d} 20) * 1000 AS polled_at_ms,
  CASE WHEN u % 3 = 0 THEN 0 ELSE 2000 + u % 4 END AS pid
FROM (SELECT event_id AS e, user_id AS u FROM events) q
"""

#: Boot recorder files.
BOOT_FILES = """
SELECT 'dev' || CAST(p % 4 AS {s}) AS device_serial,
  CASE WHEN p % 9 = 8 THEN 'notes-' || CAST(p AS {s}) || '.txt' WHEN p % 9 = 7 THEN 'bootup-' || CAST(p % 40 AS {s}) || '.log' ELSE
  '202401' || lpad(CAST(1 + p_size % 28 AS {s}), 2, '0') || '-1011' || lpad(CAST(p_size % 60 AS {s}), 2, '0') || CASE p % 3 WHEN 0 THEN '.meta' WHEN 1 THEN '.dmesg.txt' ELSE '.props' END END AS name
FROM (SELECT p_partkey AS p, p_size FROM part) q
"""

SCENES = {
    "lines": LINES, "sessions": SESSIONS, "ps": PS, "labels": LABELS, "dump": DUMP, "uids": UIDS,
    "profile": PROFILE, "dropbox": DROPBOX, "artifacts": ARTIFACTS, "polls": POLLS, "boots": BOOTS,
    "inputs": INPUTS, "states": STATES, "boot_files": BOOT_FILES,
}
_TABLES = ("events", "customer", "supplier", "part", "orders")


def _fill(text: str, us: str, div: str, string: str) -> str:
    return text.replace("{us}", us).replace("{d}", div).replace("{s}", string)


def duck_sql(name: str) -> str:
    return _fill(SCENES[name], "epoch_us(ts)", "//", "VARCHAR")


def _spread(df: DataFrame) -> DataFrame:
    """A table of one small file is dealt to all cores; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scene(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _fill(SCENES[name], "unix_micros(CAST(ts AS TIMESTAMP))", "DIV", "STRING")
    used = {t: _spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in _TABLES if t in sql}
    for table in used:
        sql = sql.replace(f"FROM {table}", "FROM {" + table + "}")
    # literal braces of the log text are not format fields
    sql = sql.replace("{ab ", "{{ab ").replace("u0a12}", "u0a12}}")
    out = spark.sql(sql, **used)
    # the generated text is computed once, as if it were a stored column
    for column in ("line", "text"):
        if column in out.columns:
            out = pinned(out, column, F.col(column))
    return out
