"""A corpus pipeline in five stages, each an operator of netquarry.llm, each written as Parquet for the next.

Rows without a doc_id can't be told apart and go with the first stage. Null and empty
texts have no letters and go with it too; repeated rows of one id stay or go together;
extra columns of any name stay until the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm import bpe, decontam, jaccard, langid, suffix_dedup
from netquarry.llm.common import ship, written
from netquarry.llm.queries import PATTERN, RANKS


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language identification keeps."""
    ship(spark)
    kept = langid.identify_documents(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that five-word shingles of similarity 0.8 or more connect."""
    ship(spark)
    kept = jaccard.similar(docs, 5, 80).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 50 that an earlier document has."""
    ship(spark)
    return suffix_dedup.deduplicated(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    ship(spark)
    return decontam.removed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and digests of the ids and of what they decode to."""
    ship(spark)
    out = bpe.encode(docs, RANKS, PATTERN, decoded_sha256=True, cuts_at_space=True)
    return out.select("doc_id", F.floor(F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), "decoded_sha256")


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("decontamination", benchmark_passages),
    ("byte_bpe", tokens),
]

#: Language identification can't be expressed in SQL; tests hold each stage's operator against brute force, and the stages' columns and rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
