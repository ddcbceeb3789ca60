"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, return.
WS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"

#: Text bytes that one Arrow batch may carry into a Python worker.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One input table; Arrow batches of long texts are bounded by bytes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows no label or language may be learned from; a null id is not held out."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def label_of(labels: DataFrame, name: str) -> DataFrame:
    """One 0/1 label per document: rows without id or label are left out, of contradicting
    rows the larger label counts."""
    value = F.col(name).cast("int")
    return (
        labels.where(F.col("doc_id").isNotNull() & value.isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(value).alias("label"))
    )
