"""Statistics of whole texts as plain Spark expressions: one row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_RE

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

# --- fixed values: frequent function words of four languages -----------------------------
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "have", "in", "is", "it", "not",
    "of", "on", "that", "the", "this", "to", "was", "with",
    "auf", "das", "den", "der", "des", "die", "ein", "eine", "er", "es", "im", "ist", "mit",
    "nicht", "sich", "und", "von", "zu",
    "au", "dans", "de", "du", "elle", "en", "est", "et", "la", "le", "les", "par", "pour",
    "que", "qui", "un", "une",
    "al", "con", "del", "el", "las", "los", "no", "por", "se", "su", "y",
)


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are no white space; empty for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WS_RE, -1)
    )


def _neighbours(name: str, equal) -> Column:
    """Elements of a sorted array that ``equal(x, next)`` their successor, with it, as pairs."""
    follower = lambda i: F.get(F.col(name), i + 1)
    pairs = F.transform(F.col(name), lambda x, i: F.struct(x.alias("a"), follower(i).alias("b")))
    return F.filter(pairs, lambda x: equal(x["a"], x["b"]))


def _covered(pairs: Column, position) -> Column:
    """Number of distinct words in the windows of all pairs."""
    spans = F.transform(
        pairs, lambda x: F.array(*(position(x[k]) + j for k in "ab" for j in range(3)))
    )
    return F.size(F.array_distinct(F.flatten(spans))).cast("bigint")


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words inside 3-word windows found twice or more in their text.

    Every window becomes one long: its position in the low bits, a hash in the others. After a
    primitive sort equal windows are neighbours, and neighbours of equal hash are compared word
    by word. Only a text where two different windows met in one hash (the comparison shows it)
    pays for a second sort by the words themselves, so the count is exact. Linear memory and
    n log n time, whatever the text repeats.
    """
    kept = df.columns
    w, high, low = F.col(words), F.col("_high"), F.bitwise_not("_high")
    window = lambda p: tuple(F.get(w, p + j) for j in range(3))
    place = lambda v: v.bitwiseAND(low).cast("int")
    packed = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(*window(i)).bitwiseAND(high).bitwiseOR(i.cast("bigint")),
        )
    )
    near = F.filter(
        F.transform(
            "_packed",
            lambda v, i: F.when(
                v.bitwiseXOR(F.get("_packed", i + 1)).bitwiseAND(high) == 0,
                F.struct(place(v).alias("a"), place(F.get("_packed", i + 1)).alias("b")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    paired = F.filter(
        "_near",
        lambda x: F.concat_ws(" ", *window(x["a"])) == F.concat_ws(" ", *window(x["b"])),
    )
    grams = F.sort_array(
        F.transform(
            "_packed",
            lambda v: F.struct(F.concat_ws(" ", *window(place(v))).alias("g"), place(v).alias("p")),
        )
    )
    clean = F.size("_paired") == F.size("_near")
    none = F.array().cast("array<bigint>")
    return (
        df.withColumn("_high", F.expr(f"-shiftleft(1L, length(bin(size({words}))))"))
        .withColumn("_packed", F.when(F.size(w) >= 3, packed).otherwise(none))
        .withColumn("_near", near)
        .withColumn("_paired", paired)
        .withColumn("_grams", F.when(~clean, grams))
        .withColumn(
            out,
            F.when(F.size("_near") == 0, F.lit(0).cast("bigint"))
            .when(clean, _covered(F.col("_paired"), lambda p: p))
            .otherwise(
                _covered(_neighbours("_grams", lambda x, y: x["g"] == y["g"]), lambda x: x["p"])
            ),
        )
        .select(*kept, out)
    )


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces ``text`` by its statistics, all long and never null.

    ``n_chars_all, n_words, word_chars, n_symbols, n_lines`` (lines with a word), ``n_dup_lines``
    (those equal to an earlier one), ``n_repeat_words, n_stop_words, n_distinct_words``. Null text
    counts as empty: all zero. Columns of ``df`` with these names are overwritten.
    """
    own = ("n_chars_all", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
           "n_repeat_words", "n_stop_words", "n_distinct_words")
    rest = [c for c in df.columns if c != text and c not in own]
    raw = F.coalesce(F.col(text), F.lit(""))
    base = df.select(
        *rest,
        F.char_length(raw).alias("n_chars_all"),
        F.length(F.regexp_replace(raw, f"[^{SYMBOLS}]+", "")).alias("n_symbols"),
        F.filter(
            F.split(raw, "\n", -1), lambda s: F.length(F.btrim(s, F.lit(WS))) > 0
        ).alias("_lines"),
        words_of(F.col(text)).alias("_words"),
    )
    counted = base.select(
        *rest,
        "n_chars_all",
        "n_symbols",
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.size("_words").alias("n_words"),
        F.char_length(F.array_join("_words", "")).alias("word_chars"),
        F.size(F.filter("_words", lambda x: x.isin(*STOP_WORDS))).alias("n_stop_words"),
        F.size(F.array_distinct("_words")).alias("n_distinct_words"),
        "_words",
    )
    out = repeated_words(counted, "_words", "n_repeat_words")
    return out.select(*rest, *(F.col(c).cast("bigint").alias(c) for c in own))
