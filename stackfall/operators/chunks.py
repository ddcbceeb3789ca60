"""Ordered operators over sessions of any length.

A session may hold a third of all rows, so no window here spans a whole session. ``seq`` is a
unique counter, hence a range of ``chunk_rows`` sequence numbers holds at most that many rows:
windows run inside such a chunk, each chunk is reduced to one summary row, a second window runs
over the summaries, and its result is joined back on the chunk key (which the rows are already
partitioned by).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import SEQ, SESSION

CHUNK_ROWS = 1 << 18
CHUNK = "_chunk"
_WORD = "_word"
#: Sequence numbers of a word of the rank structure: the bits of a long.
_WORD_ROWS = 64
_CHUNK_WORDS = CHUNK_ROWS // _WORD_ROWS


def with_chunk(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return df.withColumn(CHUNK, F.expr(f"{SEQ} div {int(chunk_rows)}"))


def in_chunk(keys: Sequence[str] = SESSION) -> WindowSpec:
    return (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(SEQ)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def in_chunk_before(keys: Sequence[str] = SESSION) -> WindowSpec:
    return (
        Window.partitionBy(*keys, CHUNK).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, -1)
    )


def earlier_chunks(keys: Sequence[str] = SESSION) -> WindowSpec:
    return (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )


def newest(value: str, when: Column | None = None) -> Column:
    """Aggregate: the value with the highest ``seq`` among rows where it is set."""
    held = F.col(value).isNotNull() if when is None else when
    return F.max_by(value, F.when(held, F.col(SEQ)))


def oldest(value: str) -> Column:
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(SEQ)))


def join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    return rows.join(carry, [*keys, CHUNK], "left")


def scan(
    df: DataFrame,
    *,
    last: Mapping[str, Column] | None = None,
    count: Mapping[str, Column] | None = None,
    before: bool = False,
    keys: Sequence[str] = SESSION,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Running values along ``seq`` of each key.

    ``last`` adds the latest non-NULL value of an expression, ``count`` its running sum; with
    ``before`` the current row is left out.
    """
    last, count = dict(last or {}), dict(count or {})
    rows = with_chunk(df, chunk_rows).withColumns(
        {f"_v_{n}": c for n, c in last.items()} | {f"_v_{n}": c.cast("bigint") for n, c in count.items()}
    )
    tails = rows.groupBy(*keys, CHUNK).agg(
        *[newest(f"_v_{n}").alias(f"_t_{n}") for n in last],
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in count],
    )
    over = earlier_chunks(keys)
    carry = tails.select(
        *keys,
        CHUNK,
        *[F.last(f"_t_{n}", ignorenulls=True).over(over).alias(f"_c_{n}") for n in last],
        *[F.sum(f"_t_{n}").over(over).alias(f"_c_{n}") for n in count],
    )
    here = in_chunk_before(keys) if before else in_chunk(keys)
    zero = F.lit(0).cast("bigint")
    local = rows.withColumns(
        {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(here) for n in last}
        | {f"_l_{n}": F.sum(f"_v_{n}").over(here) for n in count}
    )
    joined = join_carry(local, carry, keys)
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in last],
        *[
            (F.coalesce(f"_l_{n}", zero) + F.coalesce(f"_c_{n}", zero)).alias(n)
            for n in count
        ],
    )


def with_line_index(
    df: DataFrame, keys: Sequence[str] = SESSION, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Ordinal of every row in its session, from 0."""
    out = scan(df, count={"line_index": F.lit(1)}, before=True, keys=keys, chunk_rows=chunk_rows)
    return out


def line_ranks(of: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Rank structure of the rows of every key: one row for 64 sequence numbers.

    ``_bits`` says which of them exist, ``_earlier`` how many rows of the key come before. Bits are
    collected by a hash aggregate on the map side, so less than a byte of key and bits moves per
    log row; store the result beside the records (``exports.write_ranks``) and it never moves again.
    """
    place = F.expr(f"cast({SEQ} % {_WORD_ROWS} AS int)")
    words = of.groupBy(*keys, F.expr(f"{SEQ} div {_WORD_ROWS}").alias(_WORD)).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).alias("_bits")
    )
    words = words.withColumns(
        {"_n": F.bit_count("_bits").cast("bigint"), CHUNK: F.expr(f"{_WORD} div {_CHUNK_WORDS}")}
    )
    before = (
        Window.partitionBy(*keys, CHUNK).orderBy(_WORD).rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("bigint")
    carry = words.groupBy(*keys, CHUNK).agg(F.sum("_n").alias("_n"))
    carry = carry.select(*keys, CHUNK, F.coalesce(F.sum("_n").over(earlier_chunks(keys)), zero).alias("_c"))
    local = words.withColumn("_l", F.coalesce(F.sum("_n").over(before), zero))
    return join_carry(local, carry, keys).select(
        *keys, _WORD, "_bits", (F.col("_l") + F.col("_c")).alias("_earlier")
    )


def place_in(subset: DataFrame, ranks: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """``line_index`` of a few rows by a rank structure: an equi-join and two bit operations."""
    rows = subset.withColumn(_WORD, F.expr(f"{SEQ} div {_WORD_ROWS}"))
    ahead = F.expr(f"~shiftleft(-1L, cast({SEQ} % {_WORD_ROWS} AS int))")
    inside = F.bit_count(F.col("_bits").bitwiseAND(ahead))
    return rows.join(ranks, [*keys, _WORD], "left").select(
        *subset.columns, (F.col("_earlier") + inside).cast("bigint").alias("line_index")
    )


def rank_of(subset: DataFrame, of: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """``line_index`` of a few rows among all rows of ``of`` without shuffling ``of``."""
    return place_in(subset, line_ranks(of, keys), keys)
