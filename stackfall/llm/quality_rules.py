"""Quality rules: a table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .text_stats import with_stats


class Rule(NamedTuple):
    """Keep a document while ``low <= scale * top / bottom <= high``; a bound of None is open.

    Compared as whole numbers (``scale * top`` against ``low * bottom``), so an empty
    denominator never divides.
    """

    name: str
    top: str
    bottom: str
    scale: int
    low: int | None
    high: int | None


#: Length, symbol, stop-word and line ratios. Word length is in tenths of a character, the
#: others in per cent.
RULES = (
    Rule("word_length", "word_chars", "n_words", 10, 20, 120),
    Rule("symbols", "n_symbols", "n_words", 100, None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 100, 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 100, None, 60),
)

#: The base rule every table starts from: fewest words, and the largest share in per cent of
#: words inside repeated 3-word windows.
MIN_WORDS = 50
MAX_REPEAT = 50


def passes(rule: Rule) -> Column:
    top, bottom = F.col(rule.top) * rule.scale, F.col(rule.bottom)
    verdict = F.lit(True)
    if rule.low is not None:
        verdict = verdict & (top >= bottom * rule.low)
    if rule.high is not None:
        verdict = verdict & (top <= bottom * rule.high)
    return verdict


def judge(
    docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id, base statistics, ``base_failed`` and ``kept``.

    Null, empty and blank texts have no words: all counts 0, ``base_failed``. Repeated rows and
    null ids are judged like any other; other columns of ``docs`` are ignored. No shuffle.
    """
    stats = with_stats(docs.select(F.col(id_col), F.col(text).alias("text")))
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & passes(rule)
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT
    )
    return stats.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict).alias("kept"),
    )


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns unchanged.

    The verdict is computed beside the row, so nothing is joined or shuffled and repeated rows
    or null ids need no care; rows and verdict are written to the shared folder once.
    """
    names = docs.columns
    at = [f"_c{i}" for i in range(len(names))]  # clear of the names of the statistics
    rows = docs.toDF(*at)
    stats = with_stats(rows.withColumn("_text", F.col(at[names.index("text")])), "_text")
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & passes(rule)
    base = (F.col("n_words") >= MIN_WORDS) & (
        F.col("n_repeat_words") * 100 <= F.col("n_words") * MAX_REPEAT
    )
    # a filter right above the statistics makes the optimizer repeat them without end, so the
    # verdict is written beside the rows once and the filter reads it
    judged = cut(stats.select(*at, (base & verdict).alias("_kept")), "rules")
    return judged.where("_kept").select(*(F.col(c).alias(n) for c, n in zip(at, names)))


# --- DuckDB equivalent --------------------------------------------------------------------
_LIST = lambda names: ", ".join(f"'{n}'" for n in names)


def oracle_sql() -> str:
    from .text_stats import STOP_WORDS

    ratio = " AND ".join(
        f"{r.scale} * {r.top} {op} {bound} * {r.bottom}"
        for r in RULES
        for op, bound in ((">=", r.low), ("<=", r.high))
        if bound is not None
    )
    space = r"[\x20\x09-\x0D]"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{space}+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT *, list_transform(range(1, greatest(len(words) - 1, 1)),
  lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams FROM w),
k AS (SELECT row_number() OVER () AS r, * FROM g),
e AS (SELECT r, unnest(grams) AS gram, generate_subscripts(grams, 1) AS p FROM k),
f AS (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS n FROM e),
c AS (SELECT r, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM f WHERE n > 1) GROUP BY r),
s AS (SELECT doc_id, len(words)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(list_filter(words, lambda x: x IN ({_LIST(STOP_WORDS)})))::BIGINT AS n_stop_words
  FROM k LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {ratio} AS kept FROM b"""
