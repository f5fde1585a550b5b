"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, clustering, decontam, jaccard, langid, neighbours, quality, search, suffix_dedup, token_store, toxicity, warc
from .common import ship

#: The vocabularies that the queries use; operators take any path.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
#: Turns that the chat query renders in one row (the SQL has the same number).
CHUNK_TURNS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, PATTERN, cuts_at_space=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(spark, table(spark, sf_dir, "documents"))


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"), CHUNK_TURNS)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(spark, table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.summary(spark, table(spark, sf_dir, "documents"), TOKENIZER)


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_weighted_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(table(spark, sf_dir, "embeddings"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 with all its evidence: markup, address and host of ``pages``."""
    return langid.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_byte_bpe, op2_language_id, op3_quality_rules, op4_warc_zstd, op5_suffix_array_dedup, op6_chat_perspectives, op7_ngram_jaccard_join, op8_decontamination, op9_toxicity, op10_token_store, op11_tiered_search, op12_neighbour_votes, op13_weighted_clustering, language_of_pages)
    return {f.__name__: f for f in found}


SUFFIX_DEDUP = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 49)::BIGINT)) AS p FROM d WHERE length(h) >= 100)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM f),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, k),
s AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
    array_agg(a ORDER BY a) AS starts, array_agg(b ORDER BY a) AS ends
  FROM r GROUP BY doc_id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, (n_spans + 2)::BIGINT), lambda j:
    substr(h, (CASE WHEN j = 1 THEN 0 ELSE 2 * ends[j - 1] END + 1)::BIGINT,
      (CASE WHEN j > n_spans THEN length(h) ELSE 2 * starts[j] END - CASE WHEN j = 1 THEN 0 ELSE 2 * ends[j - 1] END)::BIGINT)), '') END)) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality.ORACLE,
        "op4_warc_zstd": warc.ORACLE,
        "op5_suffix_array_dedup": SUFFIX_DEDUP,
        "op6_chat_perspectives": chat.ORACLE,
        "op7_ngram_jaccard_join": jaccard.ORACLE,
        "op8_decontamination": decontam.ORACLE,
        "op11_tiered_search": search.ORACLE,
        "op13_weighted_clustering": clustering.ORACLE,
    }
