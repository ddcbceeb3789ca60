"""Schemas and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

#: Partition key of every capture-local operator; ``SEQ`` is the only order within it.
SESSION = ("device_serial", "session_id")
SEQ = "seq"

# --- fixed values: levels -------------------------------------------------------------
LEVELS = ("verbose", "debug", "info", "warn", "error", "fatal", "unknown")
LEVEL_RANK = {name: rank for rank, name in enumerate(LEVELS)}
LEVEL_BADGE = {
    "verbose": "V", "debug": "D", "info": "I", "warn": "W",
    "error": "E", "fatal": "F", "unknown": "?",
}
LEVEL_OF_LETTER = {
    "V": "verbose", "D": "debug", "I": "info", "W": "warn",
    "E": "error", "F": "fatal", "A": "fatal", "S": "unknown",
}
LEVEL_NAMES = {
    "verbose": "verbose", "v": "verbose",
    "debug": "debug", "d": "debug",
    "info": "info", "i": "info",
    "warn": "warn", "warning": "warn", "w": "warn",
    "error": "error", "e": "error",
    "fatal": "fatal", "f": "fatal", "assert": "fatal", "a": "fatal",
    "unknown": "unknown", "?": "unknown", "": "unknown",
}
#: printk digit modulo 8 -> level
LEVEL_OF_DIGIT = {
    0: "error", 1: "error", 2: "error", 3: "error",
    4: "warn", 5: "info", 6: "info", 7: "debug",
}

# --- fixed values: other enumerations ---------------------------------------------------
SOURCES = ("logcat", "dmesg", "kmsg", "crash", "boot", "recovery", "module")
CRASH_KINDS = (
    "kernelPanic", "oops", "kernelBug", "watchdog",
    "lowMemory", "anr", "systemServer", "nativeCrash",
)
CRASH_KIND_LABEL = {
    "kernelPanic": "Kernel panic",
    "oops": "Kernel oops",
    "kernelBug": "Kernel BUG",
    "watchdog": "Watchdog",
    "lowMemory": "Low-memory kill",
    "anr": "Not responding",
    "systemServer": "System server crash",
    "nativeCrash": "Native crash",
}
CRASH_KIND_BADGE = {
    "kernelPanic": "P", "oops": "O", "kernelBug": "B", "watchdog": "W",
    "lowMemory": "M", "anr": "A", "systemServer": "S", "nativeCrash": "N",
}
CRASH_ORIGINS = ("crashBuffer", "dropbox", "tombstone", "anrTrace", "kernel")
AMS_KINDS = (
    "amCrash", "amAnr", "amProcDied", "amKill", "amProcStart", "forceFinish", "forceStop",
    "killing", "processDied", "isCrashing", "anrIn", "restart", "processRecord",
)
AMS_LABEL = {
    "amCrash": "crashed", "amAnr": "stopped responding", "amProcDied": "ended",
    "amKill": "killed", "amProcStart": "started", "forceFinish": "force-finished",
    "forceStop": "force-stopped", "killing": "killed", "processDied": "died",
    "isCrashing": "crashing", "anrIn": "stopped responding", "restart": "restarted",
    "processRecord": "recorded",
}
AMS_SOURCE_KINDS = ("amCrash", "amAnr", "isCrashing", "anrIn")
AMS_VICTIM_KINDS = ("forceFinish", "forceStop", "killing", "processDied", "amProcDied")
RESOURCE_KINDS = (
    "lowMemoryKill", "outOfMemory", "fdExhaustion", "threadExhaustion", "binderFailure",
)
DROPBOX_KINDS = (
    "systemAppCrash", "systemServerCrash", "dataAppCrash", "anr", "nativeCrash",
    "tombstone", "wtf", "watchdog", "other",
)
READ_STATUSES = ("found", "empty", "missing", "denied", "restricted", "failed")
CHECK_RANK = {"ok": 0, "notice": 1, "warning": 2}
CHECKS = ("records", "dropped", "unparsed", "buffers", "gaps", "stacks")
BUFFERS = ("main", "system", "crash", "radio", "events", "kernel", "security", "stats")
KERNEL_ERAS = ("legacyLastKmsg", "pstore", "unknown")
INTERESTING_TAGS = (
    "ActivityManager", "AndroidRuntime", "DEBUG", "libc", "art", "fdsan", "lowmemorykiller",
    "lmkd", "JavaBinder", "Binder", "Watchdog", "system_server", "am_",
)

# --- fixed values: limits ---------------------------------------------------------------
SNAPSHOT_VERSION = 1
MAX_FOLLOW_UP_FILES = 3
INVENTORY_TTL_MS = 300_000
BOOT_WINDOW_MS = 120_000
DAY_MS = 86_400_000

_KEYS = [
    T.StructField("device_serial", T.StringType(), False),
    T.StructField("session_id", T.StringType(), False),
]

LOG_LINE = T.StructType(
    _KEYS
    + [
        T.StructField("seq", T.LongType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("received_at_ms", T.LongType()),
        T.StructField("line", T.StringType()),
    ]
)

PS_ROW = T.StructType(
    [
        T.StructField("device_serial", T.StringType(), False),
        T.StructField("polled_at_ms", T.LongType()),
        T.StructField("pid", T.IntegerType()),
        T.StructField("user", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)

SESSION_ROW = T.StructType(
    _KEYS
    + [
        T.StructField("source", T.StringType()),
        T.StructField("command", T.StringType()),
        T.StructField("capacity", T.IntegerType()),
        T.StructField("started_at_ms", T.LongType()),
        T.StructField("year", T.IntegerType()),
    ]
)

ARTIFACT = T.StructType(
    [
        T.StructField("device_serial", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("dir", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

#: Column order of a finished crash event.
CRASH_EVENT_COLUMNS = (
    "device_serial", "session_id", "event_id", "origin", "kind", "process", "pid", "tid",
    "thread", "exception", "message", "frames", "caused_by", "timestamp", "raw", "start_seq",
    "n_lines", "n_frames", "stack_hash",
)
