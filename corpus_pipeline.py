"""A training-data pipeline of five operators over ``documents``.

Quality rules drop what they reject; of each group of near copies one document stays; found
secrets are masked; sources are interleaved to their target weights; the rest is encoded.
Each stage takes the documents its predecessor kept and returns the same columns, the last
one the tokens' digests. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, jaccard, pfair, quality, secrets
from wardline.session import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.quality_rules(docs).filter("kept").select(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component; documents without an id stay."""
    found = jaccard.jaccard_components(docs.select("doc_id", "text"))
    gone = found.filter("doc <> component").select(F.col("doc").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked and ``n_chars`` counted anew where that changed them."""
    masked = secrets.redact(secrets.scan_secrets(docs))
    length = F.when(F.size("secret_spans") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: files in range order, rows sorted."""
    order = ["mix_step", "mix_place"]
    return pfair.mix(docs).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens, counted and digested, and the digest of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode_decode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN))


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_copies_stage),
    ("secret_scans", secrets_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]
#: The Jaccard components and byte-pair merges are recursive over all rows; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
