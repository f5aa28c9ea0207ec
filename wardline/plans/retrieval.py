"""Hybrid search over a chunk table or a stored index."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.config import RetrievalParams
from wardline.operators import retrieval as R
from wardline.operators.embedding import Embedder
from wardline.operators.postings import BUCKETS, posting_blocks, posting_rows, stored_blocks, term_table
from wardline.session import materialise

PARTS = ("chunks", "term_stats", "postings", "corpus_stats", "vectors")
MANIFEST = "manifest"


def _latest(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that was finished last; None when there is none."""
    try:
        done = spark.read.schema("version string, built_at timestamp").parquet(os.path.join(path, MANIFEST))
        row = done.agg(F.max(F.struct("built_at", "version")).alias("m")).first()["m"]
    except AnalysisException:
        return None
    return os.path.join(path, row["version"]) if row else None


def index_exists(spark: SparkSession, path: str) -> bool:
    """True only when a finished version is there and every part of it can be read."""
    at = _latest(spark, path)
    try:
        for part in PARTS if at else ():
            spark.read.parquet(os.path.join(at, part))
    except AnalysisException:
        return False
    return at is not None


def build_index(
    chunks: DataFrame, embedder: Embedder, path: str, params: RetrievalParams = RetrievalParams(), buckets: int = BUCKETS
) -> None:
    """Write a version of the index: chunk texts, term statistics, blocks of postings, corpus
    statistics and vectors. The manifest gets its row last, by one added file: until then, and if
    the build fails, searches read the version before.
    """
    spark, version = chunks.sparkSession, f"version-{uuid.uuid4().hex}"

    def save(df: DataFrame, part: str, by: tuple[str, ...] = ()) -> DataFrame:
        at = os.path.join(path, version, part)
        df.write.partitionBy(*by).parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    stored = save(chunks.select("chunk_id", "text"), "chunks")
    words = R.word_rows(stored)
    stats = save(R.corpus_stats(words).withColumn("buckets", F.lit(buckets)), "corpus_stats")
    average = stats.select("avg_length").scalar()
    blocks = materialise(posting_blocks(posting_rows(words), average, params, buckets=buckets), "blocks")
    terms = term_table(blocks)
    order = ["bucket", "term"]
    terms = save(terms.repartitionByRange(*order).sortWithinPartitions(*order), "term_stats", ("bucket",))
    order = ["bucket", "term", "block"]
    # blocks have been written in order of their terms, so they need no further shuffle
    save(stored_blocks(blocks, terms).sortWithinPartitions(*order), "postings", ("bucket",))
    save(embedder.attach(stored, "text", "vector").select("chunk_id", "vector"), "vectors")
    done = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("built_at"))
    done.write.mode("append").parquet(os.path.join(path, MANIFEST))


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    at = _latest(spark, path)
    return {part: spark.read.parquet(os.path.join(at, part)) for part in PARTS}


def open_index(chunks: DataFrame, embedder: Embedder, path: str, force_rebuild: bool = False) -> dict[str, DataFrame]:
    """Load the index at ``path``, building it first when parts are missing or on request."""
    if force_rebuild or not index_exists(chunks.sparkSession, path):
        build_index(chunks, embedder, path)
    return load_index(chunks.sparkSession, path)


def hybrid_search(
    queries: DataFrame,
    embedder: Embedder,
    chunks: DataFrame | None = None,
    index: dict[str, DataFrame] | None = None,
    params: RetrievalParams = RetrievalParams(),
) -> DataFrame:
    """Fused hits of BM25 and vector search for (query_id, text) rows."""
    asked = embedder.attach(queries, "text", "vector").select("query_id", "vector")
    if index is None:
        vectors = embedder.attach(chunks, "text", "vector").select("chunk_id", "vector")
    else:
        vectors = index["vectors"]
    words = R.bm25_topk(queries, chunks, params.bm25_top_k, params, index)
    near = R.cosine_topk(asked, vectors, params.vector_top_k)
    return R.fuse(words, near, params.hybrid_top_k)


def retrieved_text(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, context): the hits of each query rendered as text; NULL without hits."""
    from wardline.functions.messages import result_text

    none = F.lit(None).cast("string")
    per_query = R.hit_contexts(hits, chunks).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    results = F.transform(
        "hits",
        lambda h: F.struct(
            none.alias("content"), h["text"].alias("text"), none.alias("document"), none.alias("passage"),
            none.alias("source"), none.alias("url"), none.alias("title"),
            h["score"].alias("score"), F.lit(None).cast("double").alias("similarity"),
        ),
    )
    return per_query.select("query_id", result_text(F.col("query"), results).alias("context"))
