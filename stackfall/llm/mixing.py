"""Mixing sources to target weights by Pfair scheduling.

A source of weight ``w`` among weights that sum to ``W`` owns a share of ``w / W``. Its block
``k`` is released at slot ``floor(k * W / w)`` and due by ``ceil((k + 1) * W / w)``; in every slot
the released block with the earliest deadline runs. On one lane this meets every deadline, so at any
slot each source is less than one block away from its share. Weights are exact fractions, never
rounded, so nothing adds up however long the mix is. The schedule has one step per block that
exists (a slot without one is skipped); rows are numbered inside their source by bounded buckets.
No source is ever sorted in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from decimal import Decimal
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

#: Documents of one source that are taken together.
BLOCK_ROWS = 64
#: Blocks of a frame: the schedule is laid out frame by frame, each goes on where the last ended.
FRAME_SLOTS = 4096
#: Schedules of up to this many blocks are sent to the rows, longer ones are joined by a shuffle.
SEND_BLOCKS = 1_000_000
#: Rows a numbering bucket holds on average.
BUCKET_ROWS = 1024
#: Production weights: document counts to this power.
TEMPERATURE = 0.5


def whole_weights(weights: Mapping, slots: int = FRAME_SLOTS) -> dict:
    """Integer weights, one at least, that sum to ``max(slots, number of sources)``, for a single
    :func:`frame`; a mix of any length needs :func:`exact_weights`.

    Largest remainders get the slots that rounding leaves; ties go in the order of the names.
    """
    if any(not w > 0 or w == float("inf") for w in weights.values()):
        raise ValueError("target weights must be positive and finite")
    slots, total = max(slots, len(weights)), float(sum(weights.values()))
    names = sorted(weights, key=lambda s: (s is None, s))
    exact = {s: weights[s] / total * slots for s in names}
    whole = {s: max(1, int(exact[s])) for s in names}
    by_rest = sorted(names, key=lambda s: -(exact[s] - whole[s]))
    for s in by_rest[: max(0, slots - sum(whole.values()))]:
        whole[s] += 1
    while (over := sum(whole.values()) - slots) > 0:
        for s in sorted((s for s in names if whole[s] > 1), key=lambda s: exact[s] - whole[s])[:over]:
            whole[s] -= 1
    return whole


def exact_weights(weights: Mapping) -> dict:
    """Integers in exactly the proportions of ``weights``."""
    if any(not w > 0 or w == float("inf") for w in weights.values()):
        raise ValueError("target weights must be positive and finite")
    exact = {
        s: Fraction(w if isinstance(w, (int, Decimal, Fraction)) else float(w))
        for s, w in weights.items()
    }
    common = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * common) for s, x in exact.items()}


def schedule(whole: Mapping, blocks: Mapping) -> Iterator[tuple]:
    """``(source, k, release, deadline, slot)`` of every block ``k < blocks[source]``, by slot.

    Slots that belong to blocks behind the end of a source stay empty.
    """
    total = sum(whole.values())
    names = sorted(whole, key=lambda s: (s is None, s))
    weight, ends = [whole[s] for s in names], [blocks[s] for s in names]
    waiting = [(0, i, 0) for i in range(len(names)) if ends[i]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple] = []  # deadline, source, block, release
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weight[i]), i, k, release))
        deadline, i, k, release = heapq.heappop(ready)
        yield names[i], k, release, deadline, slot
        if k + 1 < ends[i]:
            heapq.heappush(waiting, ((k + 1) * total // weight[i], i, k + 1))
        slot += 1


def frame(whole: Mapping) -> list[tuple]:
    """``(source, j, slot)`` of one frame: the slot in which block ``j`` of the source runs."""
    return [(s, k, slot) for s, k, _, _, slot in schedule(whole, whole)]


def _plan(whole: Mapping, blocks: Mapping, slots: int) -> pa.Table:
    """The schedule as a table, made frame by frame."""
    longs = ("_k", "release", "deadline", "slot")
    schema = pa.schema([("_t", pa.string()), *((c, pa.int64()) for c in longs)])
    steps, frames = schedule(whole, blocks), []
    while some := list(islice(steps, slots)):
        if max(r[3] for r in some) >= 1 << 63:
            raise ValueError("a target weight is so small that its slots exceed 64 bits")
        frames.append(
            pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema
            )
        )
    return pa.Table.from_batches(frames, schema)


def numbered(docs: DataFrame, source: str, key: Column, counts: Mapping) -> DataFrame:
    """Adds ``_n``: the number of the row within its source, from 0, in the order of ``key``'s hash.

    Rows are dealt to about ``rows / BUCKET_ROWS`` hash ranges per source; only bucket counts
    are summed over a source, so a source with a third of all rows is still many small tasks.
    """
    spark = docs.sparkSession
    sizes = spark.createDataFrame(
        [(s, max(1, -(-n // BUCKET_ROWS))) for s, n in counts.items()], "_s string, _buckets bigint"
    )
    h = F.shiftrightunsigned(F.xxhash64(key), 33)  # 31 bits
    rows = (
        docs.withColumn("_s", F.col(source).cast("string"))
        .join(F.broadcast(sizes).withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")))
        .drop("_t")
        .withColumn("_h", h)
        .withColumn("_bucket", F.shiftright(F.col("_h") * F.col("_buckets"), 31))
    )
    per_bucket = rows.groupBy("_s", "_bucket").count()
    before = (
        F.sum("count").over(
            Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        )
    )
    starts = per_bucket.select(
        F.col("_s").alias("_t"), F.col("_bucket").alias("_b"),
        F.coalesce(before, F.lit(0)).alias("_before"),
    )
    inside = F.row_number().over(
        Window.partitionBy("_s", "_bucket").orderBy("_h", key)
    )
    return (
        rows.withColumn("_inside", inside)
        .join(starts, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_n", F.col("_before") + F.col("_inside") - 1)
        .drop("_t", "_b", "_before", "_inside", "_h", "_bucket", "_buckets")
    )


def mix(
    docs: DataFrame,
    weights: Mapping | None = None,
    *,
    id_col: str = "doc_id",
    source: str = "source",
    block_rows: int = BLOCK_ROWS,
    slots: int = FRAME_SLOTS,
) -> DataFrame:
    """Every row of ``docs`` with ``block_no, release, deadline, slot`` and ``place`` in its block.

    Reading by ``(slot, place)`` gives the mix. ``weights`` maps each source to its target weight; sources
    that it leaves out weigh 1, by default all weigh their row count to the power
    ``TEMPERATURE``. Weights count exactly, however small and however many sources there are. The
    driver lays out the schedule in frames of ``slots`` blocks; sources and one short row per
    ``block_rows`` rows must fit it.
    When a source ends its slots stay empty and the others keep their proportions; no row is
    dropped or repeated. A null source is a source of its own, null ids sort first, repeated rows
    stay repeated, an empty table gives no rows. Columns of ``docs`` named like a result column are
    replaced, all others stay.
    """
    own = ("block_no", "release", "deadline", "slot", "place")
    kept = [c for c in docs.columns if c not in own]
    docs = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"),
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source}`").alias("_source"),
    )
    source = "_source"
    counts = {
        r["s"]: r["n"]
        for r in docs.groupBy(F.col(source).cast("string").alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    target = _targets(counts, weights)
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    plan = docs.sparkSession.createDataFrame(_plan(exact_weights(target), blocks, slots))
    if sum(blocks.values()) <= SEND_BLOCKS:
        plan = F.broadcast(plan)
    rows = numbered(docs, source, F.col("_id"), counts).withColumn(
        "block_no", F.floor(F.col("_n") / block_rows).cast("bigint")
    )
    return (
        rows.join(plan, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("block_no") == F.col("_k")))
        .withColumn("place", (F.col("_n") % block_rows).cast("int"))
        .select("_row.*", *own)
    )


def interleave(
    docs: DataFrame,
    weights: Mapping | None = None,
    *,
    source: str = "source",
    block_rows: int = BLOCK_ROWS,
    slots: int = FRAME_SLOTS,
) -> DataFrame:
    """The rows of ``docs`` laid out in the mixed order: files and rows follow the slots.

    Rows are numbered and scheduled by 16 bytes each, source and hash: rows of a source follow each
    other by the hash of all their columns, so a block is a range of hashes, and a row finds its
    slot among the block borders of its bucket. Whole rows move once, to their slot. Borders are one
    entry per block; Spark sends them to the rows or shuffles both by their size.
    Rows that are equal in every column lie in one block.
    """
    if not docs.columns:
        return docs
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [
        F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()
    ]
    rows = docs.select(
        F.struct(*columns).alias("row"),
        F.col(f"`{source}`").cast("string").alias("s"),
        F.shiftrightunsigned(F.xxhash64(*hashed), 1).alias("h"),
    )
    counts = {r["s"]: r["n"] for r in rows.groupBy("s").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts, key=lambda s: (s is None, s))
    codes = F.broadcast(
        docs.sparkSession.createDataFrame(
            [(s, i, max(1, -(-counts[s] // BUCKET_ROWS))) for i, s in enumerate(names)],
            "t string, code int, buckets bigint",
        )
    )
    bucket = F.shiftright(F.shiftright("h", 32) * F.col("buckets"), 31).alias("bucket")
    rows = rows.join(codes, F.col("s").eqNullSafe(F.col("t"))).select("row", "code", bucket, "h")
    narrow = rows.select("code", "bucket", "h")
    earlier = (
        Window.partitionBy("code").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = narrow.groupBy("code", "bucket").count()
    starts = starts.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("code", "bucket").orderBy("h"))
    number = F.col("before") + F.col("inside") - 1
    borders = (
        narrow.withColumn("inside", inside)
        .join(starts, ["code", "bucket"])
        .where(number % block_rows == 0)
        .select("code", "bucket", "h", F.expr(f"(before + inside - 1) div {block_rows}").alias("k"))
    )
    # the block that a bucket begins in
    carried = starts.select(
        "code", "bucket", F.lit(-1).cast("bigint").alias("h"), F.expr(f"before div {block_rows}").alias("k")
    )
    plan = _plan(
        exact_weights(_targets(counts, weights)),
        {s: -(-n // block_rows) for s, n in counts.items()}, slots,
    )
    plan = docs.sparkSession.createDataFrame(plan).join(codes, F.col("_t").eqNullSafe(F.col("t")))
    plan = plan.select("code", F.col("_k").alias("k"), "slot")
    blocks = (
        borders.unionByName(carried)
        .join(plan, ["code", "k"])
        .groupBy("code", "bucket")
        .agg(F.array_sort(F.collect_list(F.struct("h", "slot"))).alias("blocks"))
    )
    blocks = cut(blocks, "blocks")  # as a table its size is known before the rows are read
    reached = F.filter("blocks", lambda b: b.getField("h") <= F.col("h"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.join(blocks, ["code", "bucket"])
        .select("row", "h", F.element_at(reached, -1).getField("slot").alias("slot"))
        .repartitionByRange(parts, "slot", "h")
        .sortWithinPartitions("slot", "h")
        .select("row.*")
    )


def _targets(counts: Mapping, weights: Mapping | None) -> dict:
    if weights is None:
        return {s: n**TEMPERATURE for s, n in counts.items()}
    return {s: weights.get(s, 1.0) for s in counts}
