"""Registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    cross_align,
    impact_search,
    language_id,
    mixing,
    ngram_join,
    quality_classifier,
    quality_rules,
    segment_bpe,
    toxicity,
    url_filter,
    vp_tree,
    warc,
)
from ..session import scratch_path
from .common import table


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def _file(name: str) -> str:
    import public_tokenizers as public

    return public.path(name)


def op1_vp_tree(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return vp_tree.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join(table(spark, sf, "documents"), count_links=True)


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(table(spark, sf, "documents"))


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"))


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), *_tokenizer())


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "source"))


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"), scratch_path(spark, "warc"))


def op11_segment_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return segment_bpe.round_trip(table(spark, sf, "documents"), _file("byte_bpe_50k.json"))


def op12_cross_align(spark: SparkSession, sf: str) -> DataFrame:
    files = _file("byte_bpe_50k.json"), _file("piece_bpe_32k.model")
    return cross_align.align(table(spark, sf, "documents"), *files)


def op13_impact_search(spark: SparkSession, sf: str) -> DataFrame:
    return impact_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_vp_tree,
        op2_quality_classifier,
        op3_ngram_join,
        op4_quality_rules,
        op5_toxicity,
        op6_language_id,
        op7_url_filter,
        op8_byte_bpe,
        op9_mixing,
        op10_warc,
        op11_segment_bpe,
        op12_cross_align,
        op13_impact_search,
    )
}

_WARC_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 100
  THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM s)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM m"""

ORACLE = {
    "op4_quality_rules": quality_rules.oracle_sql(),
    "op10_warc": _WARC_SQL,
    "op13_impact_search": impact_search.oracle_sql(),
}
