"""The pipeline operations as registered queries, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import alignment, bpe, jaccard, kdtree, maxscore, mixlm, pfair, pii, quality, secrets, spelling, suffixes, urls
from wardline.llm.sqltext import SQL as SQL

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(documents(spark, sf_dir).select("doc_id", "text")))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return found.drop("text")


@query
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return secrets.digests(secrets.scan_secrets(docs, keep_text=False))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(documents(spark, sf_dir).select("doc_id", "text")))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return pfair.digests(pfair.mix(docs, keep_text=False))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    return kdtree.digests(kdtree.kd_shards(docs, shards=24))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(coded)


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return jaccard.digests(docs, jaccard.jaccard_components(docs))


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.digests(mixlm.score(documents(spark, sf_dir).select("doc_id", "text")))


@query
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return maxscore.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@query
def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/pages.parquet"
    named = spark.read.parquet(path).select("page_id", "url").schema
    return urls.url_filter(spark.read.schema(named).parquet(path)).drop("url")


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.alignment(documents(spark, sf_dir).select("doc_id", "text"), a, b, public_tokenizers.PATTERN)
    return found.withColumnRenamed("doc", "doc_id")
