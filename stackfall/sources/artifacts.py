"""Crash artifacts: files and probe texts, from bytes to crash events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.crash import is_frame
from ..functions.text import strip
from ..operators import blocks as B
from ..operators import chunks as H
from ..schema import MAX_FOLLOW_UP_FILES, SESSION
from .lines import clean_line, explode_lines, with_bundle_seq, with_file_seq

#: Key of one artifact text.
ARTIFACT_KEY = (*SESSION, "dir", "name")


def read_artifacts(
    spark: SparkSession,
    path: str,
    device: str | Column,
    session: str | Column,
    *,
    glob: str | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Files below ``path`` as artifacts, whole or up to ``max_bytes`` with a ``truncated`` flag.

    ``device`` and ``session`` may be Columns over ``path``. The byte limit works on whole
    characters; the size on disk is kept in ``size_bytes``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)

    def key(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    parts = F.split("path", "/", -1)
    return files.select(
        key(device).alias("device_serial"),
        key(session).alias("session_id"),
        F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1).alias("dir"),
        F.element_at(parts, -1).alias("name"),
        (
            F.make_valid_utf8(F.col("content").cast("string"))
            if max_bytes is None
            else cap_bytes(F.col("content"), max_bytes)
        ).alias("text"),
        (F.lit(False) if max_bytes is None else F.col("length") > max_bytes).alias("truncated"),
        F.col("length").alias("size_bytes"),
    )


def cap_bytes(content: Column, max_bytes: int) -> Column:
    """Lossy text of the first ``max_bytes`` bytes; a character cut in half is left out."""
    text = F.make_valid_utf8(F.substring(content, 1, max_bytes).cast("string"))
    cut = F.length(content) > max_bytes
    return F.when(cut, F.regexp_replace(text, "�\\z", "")).otherwise(text)


def scan_artifacts(
    spark: SparkSession,
    path: str,
    device: str | Column,
    session: str | Column,
    *,
    directory: Column | None = None,
    name: Column | None = None,
    glob: str | None = None,
    bundled: bool = False,
) -> DataFrame:
    """Lines of the files below ``path``: the key of their artifact, ``seq`` and ``line``.

    Files are read in splits and never held whole, so an artifact may have any size. ``device``,
    ``session``, ``directory`` and ``name`` may be Columns over ``file_path`` (decoded); the last two are
    the last parts of the path by default.

    Millions of small artifacts cost more to list and open than to read: with ``bundled``, a file holds
    many of them, every line after the path of its artifact and a tab (see ``lines.with_bundle_seq``).
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if bundled:
        lines = with_bundle_seq(reader.text(path))
    else:
        lines = with_file_seq(reader.text(path))
        plain = F.url_decode(F.regexp_replace("file_path", r"\+", "%2B"))
        lines = lines.withColumn("file_path", plain)

    def key(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    parts = F.split("file_path", "/", -1)
    return lines.select(
        key(device).alias("device_serial"),
        key(session).alias("session_id"),
        (F.element_at(parts, -2) if directory is None else directory).alias("dir"),
        (F.element_at(parts, -1) if name is None else name).alias("name"),
        "seq",
        clean_line(F.col("value")).alias("line"),
    )


def newest_files(files: DataFrame, n: int = MAX_FOLLOW_UP_FILES) -> DataFrame:
    """The ``n`` last names of each directory; only bare names count."""
    bare = files.where((F.col("name") != "") & ~F.col("name").rlike(r"[/\s]"))
    ranked = Window.partitionBy(*SESSION, "dir").orderBy(F.desc("name"))
    return (
        bare.withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= n)
        .drop("_rank")
    )


def route_artifact(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``route``: empty, anrTrace, tombstone or dropbox."""
    return df.withColumn("route", C.artifact_route(F.col(text)))


def split_sections(lines: DataFrame, *, chunk_rows: int = H.CHUNK_ROWS) -> DataFrame:
    """``== <file>`` headers -> file name and body lines. ``lines`` is ordered by ``seq``."""
    name = strip(F.regexp_extract("line", r"^== (.*)$", 1))
    header = F.col("line").startswith("== ") & (name != "") & ~F.contains(name, F.lit(" "))
    rows = H.scan(
        lines.withColumn("_header", header),
        last={"_section": F.when(header, F.struct(F.col("seq").alias("seq"), name.alias("name")))},
        chunk_rows=chunk_rows,
    )
    return rows.where(F.col("_section").isNotNull() & ~F.col("_header")).select(
        *SESSION, "seq", F.col("_section.seq").alias("section"),
        F.col("_section.name").alias("name"), "line",
    )


# --- dropbox ---------------------------------------------------------------------------


def dropbox_bodies(lines: DataFrame, *, chunk_rows: int = H.CHUNK_ROWS) -> DataFrame:
    """A dropbox dump (ordered by ``seq``) as body lines with their entry's header.

    A line of equal signs ends an entry; the first readable line after it is the header.
    """
    sep = C.is_dropbox_separator(F.col("line"))
    rows = H.scan(
        lines.withColumn("_sep", sep), count={"entry": F.col("_sep").cast("int")},
        chunk_rows=chunk_rows,
    ).where(~F.col("_sep"))
    parsed = rows.withColumn("_header", C.dropbox_header(F.col("line")))
    heads = parsed.groupBy(*SESSION, "entry").agg(
        F.min_by(
            F.struct(F.col("seq").alias("head_seq"), F.col("_header").alias("header")),
            F.when(F.col("_header").isNotNull(), F.col("seq")),
        ).alias("_h")
    ).where(F.col("_h").isNotNull())
    return (
        parsed.drop("_header", "_sep")
        .join(heads, [*SESSION, "entry"])
        .where(F.col("seq") >= F.col("_h.head_seq"))
        .select(
            *SESSION, "entry", "seq", "line",
            F.col("_h.head_seq").alias("head_seq"), F.col("_h.header.timestamp").alias("header_time"),
            F.col("_h.header.tag").alias("tag"), F.col("_h.header.size_bytes").alias("size_bytes"),
            (F.col("seq") == F.col("_h.head_seq")).alias("is_header"),
        )
    )


def parse_dropbox_dump(lines: DataFrame, *, chunk_rows: int = H.CHUNK_ROWS) -> DataFrame:
    """Entries of a dump: tag, kind, time, size and the crash event; ``skipped`` marks a header
    without a body."""
    bodies = dropbox_bodies(lines, chunk_rows=chunk_rows)
    heads = bodies.where("is_header").select(
        *SESSION, F.col("entry").alias("start_seq"), "tag", "header_time", "size_bytes"
    )
    events = entry_events(
        bodies.where(~F.col("is_header")), origin="dropbox", block="entry"
    )
    out = heads.join(events, [*SESSION, "start_seq"], "left")
    return out.withColumn("dropbox_kind", C.dropbox_kind(F.col("tag"))).withColumn(
        "skipped", F.col("event_id").isNull()
    )


def entry_events(lines: DataFrame, *, origin: str, block: str) -> DataFrame:
    """One crash event per block of already delimited lines; blank blocks give none.

    Needs session keys, ``seq``, ``line`` and the block id column.
    """
    placed = _number_block(lines, block)
    events = B.crash_events(placed, origin=origin)
    filled = (
        placed.groupBy(*SESSION, "start_seq")
        .agg(F.bool_or(strip(F.col("line")) != "").alias("_any"))
        .where("_any")
        .drop("_any")
    )
    return events.join(filled, [*SESSION, "start_seq"], "left_semi")


def _number_block(lines: DataFrame, block: str) -> DataFrame:
    rows = lines.select(*SESSION, "seq", "line", F.col(block).cast("bigint").alias("start_seq"))
    numbered = H.scan(
        rows.withColumn("_f", is_frame(F.col("line")).cast("int")),
        count={"line_no": F.lit(1), "frame_no": F.col("_f")},
        before=True,
        keys=(*SESSION, "start_seq"),
    )
    return numbered.drop("_f")


def parse_dropbox_files(files: DataFrame) -> DataFrame:
    """Dropbox files -> one row per file: tag, kind, time, size, event, and ``skipped`` for a
    name or a body that cannot be used."""
    named = files.withColumn("_name", C.dropbox_file_name(F.col("name")))
    rows = named.select(
        *ARTIFACT_KEY,
        F.col("_name.tag").alias("tag"),
        F.col("_name.timestamp").alias("file_time"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        "text",
    )
    events = artifact_events(
        files.where(C.dropbox_file_name(F.col("name")).isNotNull()), route="dropbox"
    )
    keep = ("event_id", "kind", "process", "pid", "exception", "message", "n_frames", "timestamp")
    out = rows.drop("text").join(
        events.select(*ARTIFACT_KEY, *keep), list(ARTIFACT_KEY), "left"
    )
    return out.withColumn("dropbox_kind", C.dropbox_kind(F.col("tag"))).withColumn(
        "skipped", F.col("event_id").isNull()
    )


# --- any artifact ------------------------------------------------------------------------


def artifact_lines(artifacts: DataFrame) -> DataFrame:
    """Artifact texts as lines keyed by (session, dir, name), ordered by ``seq``."""
    return explode_lines(artifacts.select(*ARTIFACT_KEY, "text"), line_no="seq").withColumn(
        "seq", F.col("seq").cast("bigint")
    )


def artifact_events(artifacts: DataFrame, *, route: str | None = None) -> DataFrame:
    """Crash events of artifact texts, routed by shape.

    An ANR trace gives one event per ``----- pid`` section, any other text one event. A
    text is one value already, so its blocks are arrays of one row and nothing is shuffled.
    """
    routed = route_artifact(artifacts)
    if route is not None:
        routed = routed.withColumn("route", F.when(F.col("route") == "empty", "empty").otherwise(route))
    body = F.regexp_replace("text", r"\n\z", "")
    lines = F.transform(F.split(body, "\n", -1), lambda l: F.regexp_replace(l, r"\r\z", ""))
    texts = routed.where(F.col("route") != "empty").select(
        *ARTIFACT_KEY, F.col("route").alias("origin"), lines.alias("_lines")
    )
    heads = F.filter(
        F.transform(
            F.col("_lines"),
            lambda l, i: F.when(F.ltrim(l).startswith("----- pid "), i),
        ),
        lambda i: i.isNotNull(),
    )
    is_anr = F.col("origin") == "anrTrace"
    cuts = F.when(is_anr, heads).otherwise(F.array(F.lit(0)))
    placed = texts.withColumn("_cuts", cuts).select(
        *ARTIFACT_KEY, "origin", "_lines", "_cuts", F.posexplode("_cuts").alias("event_no", "_from")
    )
    end = F.coalesce(F.get("_cuts", F.col("event_no") + 1), F.size("_lines"))
    blocks = placed.select(
        *ARTIFACT_KEY, "origin", "event_no",
        F.slice("_lines", F.col("_from") + 1, end - F.col("_from")).alias("_block"),
    )
    name = C.dropbox_file_name(F.col("name"))
    tag = F.coalesce(name.getField("tag"), F.col("origin"))
    head = F.concat(F.lit("["), tag, F.lit("] "), F.col("name"))
    event_id = F.concat(
        F.col("origin"), F.lit("#"), F.concat_ws("/", "dir", "name"),
        F.lit("#"), F.col("event_no").cast("string"),
    )
    events = B.fields_of_arrays(blocks, "_block")
    return events.select(
        *ARTIFACT_KEY, "event_no",
        event_id.alias("event_id"), "origin", "kind", "process", "pid", "tid", "thread",
        "exception", "message", "frames", "caused_by",
        F.coalesce("timestamp", name.getField("timestamp")).alias("timestamp"),
        F.concat(F.array(head), "_block").alias("raw"),
        F.lit(0).cast("bigint").alias("start_seq"),
        F.size("_block").cast("bigint").alias("n_lines"),
        "n_frames", "stack_hash",
    )


def scanned_events(
    lines: DataFrame, *, arrays: bool = False, chunk_rows: int = H.CHUNK_ROWS
) -> DataFrame:
    """The events of :func:`artifact_events` out of lines (see :func:`scan_artifacts`).

    Shape, sections and fields are aggregates over lines in bounded chunks; nothing holds a text.
    Stacks and raw lines come with ``arrays`` only.
    """
    line = F.col("line")
    said = lambda what: F.bool_or(F.contains(line, F.lit(what)))
    routes = lines.groupBy(*ARTIFACT_KEY).agg(
        C.route_by(
            F.bool_or(strip(line) != ""), said("----- pid "), said("*** *** ***"),
            said("signal "), said("(SIG"),
        ).alias("route")
    )
    rows = lines.join(routes.where(F.col("route") != "empty"), list(ARTIFACT_KEY))
    header = F.ltrim("line").startswith("----- pid ")
    opens = F.when(F.col("route") == "anrTrace", header).otherwise(F.col("seq") == 0)
    rows = H.scan(
        rows.withColumns({"_frame": is_frame(line), "_opens": opens}),
        count={"_frames": F.col("_frame").cast("int")},
        before=True, keys=ARTIFACT_KEY, chunk_rows=chunk_rows,
    )
    opening = F.struct(F.col("seq").alias("seq"), F.col("_frames").alias("frames"))
    rows = H.scan(
        rows, last={"_section": F.when(F.col("_opens"), opening)}, keys=ARTIFACT_KEY, chunk_rows=chunk_rows
    ).where(F.col("_section").isNotNull())
    placed = rows.select(
        *ARTIFACT_KEY, "route", "line", F.col("_section.seq").alias("start_seq"),
        (F.col("seq") - F.col("_section.seq")).alias("line_no"),
        (F.col("_frames") - F.col("_section.frames")).alias("frame_no"),
    )
    events = B.crash_events(placed, arrays=arrays, keys=(*ARTIFACT_KEY, "route"))
    order = Window.partitionBy(*ARTIFACT_KEY).orderBy("start_seq")
    stamp = C.dropbox_file_name(F.col("name")).getField("timestamp")
    numbered = events.withColumn("event_no", F.row_number().over(order) - 1)
    event_id = F.concat(
        F.col("route"), F.lit("#"), F.concat_ws("/", "dir", "name"), F.lit("#"), F.col("event_no").cast("string")
    )
    return numbered.withColumns(
        {"event_id": event_id, "origin": F.col("route"), "timestamp": F.coalesce("timestamp", stamp)}
    ).drop("route")
