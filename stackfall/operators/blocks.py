"""Multi-line crash blocks: which lines belong together, and the event they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import crash as K
from ..functions.signals import ANOMALY, AMS, may_be_ams, may_be_anomaly
from ..schema import CRASH_EVENT_COLUMNS, SESSION
from . import chunks as H


def _resolve_blocks(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Adds ``start_seq``, ``line_no`` and ``frame_no`` (NULL outside a block).

    Needs ``_start``, ``_extends`` (continues whatever block is open), ``_tag`` (extends a block
    of the same tag) and ``_frame`` per row. A start opens a block, a row that does not extend
    it closes it. Three local windows plus one summary row per chunk.
    """
    here = H.in_chunk()
    opened = F.when(
        F.col("_start"),
        F.struct(
            F.col("seq").alias("seq"),
            F.col("_tag").alias("tag"),
            F.col("_row").alias("row"),
            F.col("_frames").alias("frames"),
        ),
    )
    local = (
        H.with_chunk(rows, chunk_rows)
        .withColumn("_row", F.count(F.lit(1)).over(here))
        .withColumn("_frames", F.sum(F.col("_frame").cast("bigint")).over(here))
        .withColumn("_opened", opened)
        .withColumn("_open", F.last("_opened", ignorenulls=True).over(here))
    )

    def breaks(open_tag):
        same = F.coalesce(F.col("_tag") == open_tag, F.lit(False))
        return ~F.col("_start") & ~F.col("_extends") & ~same

    # what a chunk does to a block that is open when it begins or ends
    loose = ~F.col("_start") & ~F.col("_extends")
    tails = (
        local.withColumn(
            "_cut", F.when(F.col("_open").isNotNull() & breaks(F.col("_open.tag")), F.col("seq"))
        )
        .groupBy(*SESSION, H.CHUNK)
        .agg(
            F.max_by("_opened", F.when(F.col("_start"), F.col("seq"))).alias("_last"),
            F.max("_cut").alias("_last_cut"),
            F.count(F.lit(1)).alias("_n"),
            F.sum(F.col("_frame").cast("bigint")).alias("_nf"),
            F.min(F.when(loose, F.col("_tag"))).alias("_tag_low"),
            F.max(F.when(loose, F.col("_tag"))).alias("_tag_high"),
            F.coalesce(F.bool_or(loose & F.col("_tag").isNull()), F.lit(False)).alias("_untagged"),
        )
    )
    over = H.earlier_chunks()
    zero = F.lit(0).cast("bigint")
    carry = (
        tails.withColumn("_rows", F.coalesce(F.sum("_n").over(over), zero))
        .withColumn("_fr", F.coalesce(F.sum("_nf").over(over), zero))
        .withColumn(
            "_last",
            F.when(
                F.col("_last").isNotNull(),
                F.struct(
                    F.col("_last.seq").alias("seq"),
                    F.col("_last.tag").alias("tag"),
                    (F.col("_last.row") + F.col("_rows")).alias("row"),
                    (F.col("_last.frames") + F.col("_fr")).alias("frames"),
                    F.col(H.CHUNK).alias("chunk"),
                ),
            ),
        )
        .withColumn("_in", F.last("_last", ignorenulls=True).over(over))
    )
    tag_in = F.col("_in.tag")
    no_loose = F.col("_tag_low").isNull() & ~F.col("_untagged")
    all_same = ~F.col("_untagged") & (F.col("_tag_low") == tag_in) & (F.col("_tag_high") == tag_in)
    closes = F.when(
        F.col("_last").isNotNull(),
        F.coalesce(F.col("_last_cut") > F.col("_last.seq"), F.lit(False)),
    ).otherwise(~(no_loose | F.coalesce(all_same, F.lit(False))))
    carry = (
        carry.withColumn("_closed", F.when(closes, F.col(H.CHUNK)))
        .withColumn("_closed", F.max("_closed").over(over))
        .select(
            *SESSION, H.CHUNK, "_rows", "_fr",
            F.when(
                F.col("_closed").isNull() | (F.col("_closed") < F.col("_in.chunk")), F.col("_in")
            ).alias("_in"),
        )
    )
    joined = H.join_carry(local, carry)
    shifted = F.struct(
        F.col("_open.seq").alias("seq"),
        F.col("_open.tag").alias("tag"),
        (F.col("_open.row") + F.col("_rows")).alias("row"),
        (F.col("_open.frames") + F.col("_fr")).alias("frames"),
    )
    carried = F.struct(*[F.col("_in").getField(n).alias(n) for n in ("seq", "tag", "row", "frames")])
    block = F.when(F.col("_open").isNotNull(), shifted).when(F.col("_in").isNotNull(), carried)
    marked = joined.withColumn("_b", block)
    marked = marked.withColumn(
        "_cut", F.when(F.col("_b").isNotNull() & breaks(F.col("_b.tag")), F.col("seq"))
    ).withColumn("_cut", F.max("_cut").over(here))
    member = F.col("_b").isNotNull() & (
        F.col("_cut").isNull() | (F.col("_cut") < F.col("_b.seq"))
    )
    frames = F.col("_frames") + F.col("_fr") - F.col("_b.frames")
    return marked.select(
        *rows.columns,
        F.when(member, F.col("_b.seq")).alias("start_seq"),
        F.when(member, F.col("_row") + F.col("_rows") - F.col("_b.row")).alias("line_no"),
        F.when(member, frames - F.when(F.col("_frame"), 1).otherwise(0)).alias("frame_no"),
    )


def crash_blocks(
    lines: DataFrame, *, line: str = "line", chunk_rows: int = H.CHUNK_ROWS
) -> DataFrame:
    """Rows of a crash buffer that belong to a block, with ``start_seq`` and ``line_no``.

    A start line opens a block; a line of the same tag or a continuation extends it.
    """
    text = F.col(line)
    rows = (
        lines.select(*SESSION, "seq", text.alias("line"))
        .withColumn("_body", K.message_body(F.col("line")))
        .withColumn("_start", K.starts_block(F.col("_body")))
        .withColumn(
            "_extends", K.continues_block(F.col("line")) | K.continues_block(F.col("_body"))
        )
        .withColumn("_tag", K.logcat_tag(F.col("line")))
        .withColumn("_frame", K.is_frame_text(F.col("_body")))
    )
    placed = _resolve_blocks(rows, chunk_rows).where(F.col("start_seq").isNotNull())
    return placed.select(*SESSION, "seq", "line", "start_seq", "line_no", "frame_no")


def crash_events(
    block_lines: DataFrame,
    *,
    origin: str = "crashBuffer",
    arrays: bool = True,
    opening: tuple[str, ...] = (),
    keys: tuple[str, ...] = SESSION,
) -> DataFrame:
    """One row per block, of any length. Scalars are mergeable aggregates over its lines.

    ``frames``, ``caused_by`` and ``raw`` hold all lines they are about; without ``arrays`` they
    are NULL for every block and ``block_lines`` itself is the frame of lines. ``opening`` names
    further columns to take from the row that opened the block, ``keys`` what ``start_seq`` is unique
    in."""
    parts = K.with_hashes(K.with_line_parts(block_lines, F.col("line")))
    inline = F.lit(arrays)
    fields = K.merge(K.row_reducer("line_no", inline))
    raw = F.transform(
        F.array_sort(
            F.collect_list(F.when(inline, F.struct(F.col("line_no").alias("at"), F.col("line").alias("text"))))
        ),
        lambda p: p.getField("text"),
    )
    events = parts.groupBy(*keys, "start_seq").agg(
        *[c.alias(n) for n, c in fields.items()],
        raw.alias("raw"),
        F.count(F.lit(1)).alias("n_lines"),
        *[F.max(F.when(F.col("line_no") == 0, F.col(n))).alias(n) for n in opening],
    )
    return events.withColumns(
        {
            "event_id": F.concat_ws("#", F.lit(origin), F.col("start_seq")),
            "origin": F.lit(origin),
            "frames": F.when(inline, F.col("frames")),
            "caused_by": F.when(inline, F.col("caused_by")),
            "raw": F.when(inline, F.col("raw")),
        }
    ).select(*CRASH_EVENT_COLUMNS, *[k for k in keys if k not in SESSION], *opening)


def fields_of_arrays(df: DataFrame, lines: str) -> DataFrame:
    """Crash fields of bounded blocks that already are arrays of lines: no shuffle."""
    return df.withColumn("_f", K.crash_fields(F.col(lines))).select(*df.columns, "_f.*")


# --- live rule ------------------------------------------------------------------------


def live_blocks(records: DataFrame, *, chunk_rows: int = H.CHUNK_ROWS) -> DataFrame:
    """Gated rows under the live rule: no tag rule, blocks of any length.

    Rows of other tags neither extend nor close a block, so they are filtered first; what is
    left is a few rows per second of log. Rows outside a block keep NULL ``start_seq``.
    """
    gated = records.where(C.is_interesting_tag(F.col("tag"))).select(
        *SESSION, "seq", "tag", "message", "package", "pid"
    )
    body = F.col("message")
    rows = (
        gated.withColumn("_start", K.starts_block(body))
        .withColumn("_extends", K.continues_block(body))
        .withColumn("_tag", F.lit(None).cast("string"))
        .withColumn("_frame", K.is_frame(body))
    )
    return _resolve_blocks(rows, chunk_rows).select(
        *SESSION, "seq", "tag", "message", "package", "pid", "start_seq", "line_no", "frame_no"
    )


def live_crash_events(rows: DataFrame, *, finish: bool = True) -> DataFrame:
    """Crash events of :func:`live_blocks` in their newest state.

    Process and pid missing in the block come from the row that opened it. ``complete`` is false
    for a block still open at the end unless ``finish`` ends the capture.
    """
    members = rows.where(F.col("start_seq").isNotNull())
    named = members.select(
        *SESSION, "seq", F.col("message").alias("line"), "start_seq", "line_no", "frame_no",
        F.col("package").alias("_package"), F.col("pid").alias("_pid"),
    )
    filled = _filled(crash_events(named, opening=("_package", "_pid")))
    if finish:
        return filled.withColumn("complete", F.lit(True))
    ends = rows.groupBy(*SESSION).agg(
        F.max("seq").alias("_end"), F.max_by("start_seq", "seq").alias("_open")
    )
    still_open = F.coalesce(F.col("_open") == F.col("start_seq"), F.lit(False))
    return (
        filled.join(ends, list(SESSION), "left")
        .withColumn("complete", ~still_open)
        .drop("_end", "_open")
    )


def fill_identity(events: DataFrame, opening: DataFrame) -> DataFrame:
    """Missing process and pid of an event from its opening row, given as ``_package``/``_pid``
    per ``start_seq``."""
    return _filled(events.join(opening, [*SESSION, "start_seq"], "left"))


def _filled(events: DataFrame) -> DataFrame:
    return (
        events.withColumn("process", F.coalesce("process", "_package"))
        .withColumn("pid", F.coalesce("pid", "_pid"))
        .drop("_package", "_pid")
    )


def live_signals(rows: DataFrame) -> DataFrame:
    """Activity-manager signals and anomalies of the live rows outside a block."""
    outside = rows.where(F.col("start_seq").isNull()).select(
        *SESSION, "seq", F.concat_ws(": ", "tag", "message").alias("line")
    )
    gated = outside.where(may_be_ams(F.col("line")) | may_be_anomaly(F.col("line")))
    both = ANOMALY.on(AMS.on(gated, F.col("line"), "ams"), F.col("line"), "anomaly")
    return both.where(F.col("ams").isNotNull() | F.col("anomaly").isNotNull())


# --- sections ---------------------------------------------------------------------------


def sections(
    lines: DataFrame, is_header, *, keys: tuple[str, ...], chunk_rows: int = H.CHUNK_ROWS
) -> DataFrame:
    """Rows from each header line up to the next one; rows before the first header drop out.

    ``lines`` needs ``seq`` as the order within ``keys``. Adds ``section`` (its header's seq).
    """
    out = H.scan(
        lines,
        last={"section": F.when(is_header, F.col("seq"))},
        keys=keys,
        chunk_rows=chunk_rows,
    )
    return out.where(F.col("section").isNotNull())


def anr_sections(
    lines: DataFrame, *, keys: tuple[str, ...] = SESSION, chunk_rows: int = H.CHUNK_ROWS
) -> DataFrame:
    """Each ``----- pid N at T -----`` header opens one event."""
    header = F.ltrim(F.col("line")).startswith("----- pid ")
    return sections(lines, header, keys=keys, chunk_rows=chunk_rows)
