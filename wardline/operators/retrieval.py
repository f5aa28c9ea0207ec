"""Chunking, BM25, exact and approximate vector search, fusion and the relevance gate.

Chunk tables have chunk_id and text, query tables query_id and text; hit tables have
query_id, chunk_id, score and rank, ties broken by chunk_id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.config import ChunkParams, RetrievalParams
from wardline.functions.rows import explode_positions, explode_values
from wardline.functions.text import NON_WORD, WORD, lines, lower_tokens, tokens
from wardline.operators.cells import exact_topk, fit_centres, matrix
from wardline.operators.postings import query_terms, search_index, search_words
from wardline.operators.ranking import DIGITS, Best, top_k
from wardline.session import is_small

#: A side of at most so many vectors is sent to the tasks whole.
SMALL_QUERIES = 2_000
SMALL_CORPUS = 50_000
#: Coarse cells for two sides that are both larger.
CELLS = 256
BLOCK_CELLS = 8_000_000


# ---------------------------------------------------------------- chunks


def line_chunks(docs: DataFrame, ids: Sequence[str], text: str = "text", min_length: int = 10) -> DataFrame:
    """Stripped lines longer than ``min_length`` with their position."""
    return explode_positions(docs, ids, lines(F.col(text), min_length), "pos", "chunk")


def chunk_units(text: Column, size: int) -> Column:
    """Sentences in order, those over ``size`` tokens cut into pieces of that many tokens."""
    whole = F.filter(F.split(text, r"(?<=[。.])"), lambda s: F.length(s) > 0)
    pieces = f"(?s)((?:{NON_WORD}*{WORD}+){{1,{size}}}{NON_WORD}*)"
    return F.flatten(
        F.transform(
            whole,
            lambda s: F.when(
                F.size(tokens(s)) > size, F.regexp_extract_all(s, F.lit(pieces), F.lit(1))
            ).otherwise(F.array(s)),
        )
    )


def spans_of(counts: Sequence[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Pack units into spans [a, b) of at most ``size`` tokens; a span restarts with as many
    trailing units of the one before as fit both ``overlap`` and the next unit."""
    spans, a, n = [], 0, len(counts)
    while a < n:
        b, total = a + 1, counts[a]
        while b < n and total + counts[b] <= size:
            total += counts[b]
            b += 1
        spans.append((a, b))
        if b == n:
            break
        start, carried = b, 0
        while start - 1 > a:
            more = carried + counts[start - 1]
            if more > overlap or more + counts[b] > size:
                break
            carried, start = more, start - 1
        a = start
    return spans


def sentence_chunks(
    docs: DataFrame, ids: Sequence[str], text: str = "text", params: ChunkParams = ChunkParams()
) -> DataFrame:
    """Sentence-aware chunks with token size and overlap: (ids, pos, n_tokens, chunk).

    Only token counts go to Python; the texts stay in the row and are sliced there.
    """
    size, overlap = params.size, params.overlap

    @F.pandas_udf("array<array<int>>")
    def spans(batch: pd.Series) -> pd.Series:
        return pd.Series([[list(s) for s in spans_of(list(c), size, overlap)] for c in batch])

    units = docs.select(*ids, F.coalesce(chunk_units(F.col(text), size), F.array().cast("array<string>")).alias("_units"))
    counted = units.withColumn("_counts", F.transform("_units", lambda u: F.size(tokens(u))))
    packed = counted.withColumn("_spans", spans("_counts"))
    rows = explode_positions(packed, [*ids, "_units", "_counts"], F.col("_spans"), "pos", "_span")
    a, width = F.get("_span", F.lit(0)) + 1, F.get("_span", F.lit(1)) - F.get("_span", F.lit(0))
    total = F.aggregate(F.slice("_counts", a, width), F.lit(0), lambda x, y: x + y)
    return rows.select(
        *ids, "pos", total.cast("bigint").alias("n_tokens"), F.array_join(F.slice("_units", a, width), "").alias("chunk")
    )


# ---------------------------------------------------------------- BM25


def word_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, words): the words of each chunk, in its row."""
    return chunks.select("chunk_id", lower_tokens(F.col("text")).alias("words"))


def corpus_stats(words: DataFrame) -> DataFrame:
    """One row: number of chunks and their average length in words."""
    return words.select(F.size("words").alias("dl")).agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avg_length"))


def document_frequencies(words: DataFrame) -> DataFrame:
    """(term, df). Words are made distinct in their row, so only per-task counts are shuffled and a
    frequent term is nothing special."""
    return explode_values(words, [], F.array_distinct("words"), "term").groupBy("term").agg(F.count("*").alias("df"))


def term_stats(words: DataFrame) -> DataFrame:
    """(term, df, cf) of a corpus."""
    occurrences = explode_values(words, [], F.col("words"), "term").groupBy("term").agg(F.count("*").alias("cf"))
    return document_frequencies(words).join(occurrences, "term")


def bm25_topk(
    queries: DataFrame,
    chunks: DataFrame | None,
    k: int,
    params: RetrievalParams = RetrievalParams(),
    index: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """BM25 top-k of (query_id, text) over the postings of a stored index, or without one over
    (chunk_id, text). One lazy plan either way."""
    asked = query_terms(queries, lower_tokens(F.col("text")))
    if index is None:
        return search_words(asked, word_rows(chunks), k, params)
    return search_index(asked, index, k, params)


# ---------------------------------------------------------------- vectors


def _hit_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType([queries.schema["query_id"], corpus.schema["chunk_id"]]).add("score", "double")


def _frame(best: Best, names: np.ndarray) -> pd.DataFrame:
    ids = np.empty(0, dtype=object) if best.ids is None else best.ids
    return pd.DataFrame({"query_id": names[best.q], "chunk_id": ids, "score": best.score})


def _collected(df: DataFrame, key: str):
    """Ids and unit vectors of a side whose size has been checked, broadcast to the tasks."""
    pdf = df.select(key, "vector").toPandas()
    if pdf.empty:
        return None
    return df.sparkSession.sparkContext.broadcast((pdf[key].to_numpy(), matrix(pdf["vector"])))


def _queries_to_corpus(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Few queries: every task multiplies its part of the corpus with the query matrix."""
    schema, shared = _hit_schema(queries, corpus), _collected(queries, "query_id")
    if shared is None:
        return corpus.sparkSession.createDataFrame([], schema)

    def run(batches):
        names, asked = shared.value
        best = Best(k)
        for batch in batches:
            if len(batch):
                best.add(np.round(asked @ matrix(batch["vector"]).T, DIGITS), batch["chunk_id"].to_numpy())
        yield _frame(best, names)

    return corpus.select("chunk_id", "vector").mapInPandas(run, schema)


def _corpus_to_queries(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Small corpus: every task finishes its own queries against the whole of it."""
    schema, shared = _hit_schema(queries, corpus), _collected(corpus, "chunk_id")
    if shared is None:
        return queries.sparkSession.createDataFrame([], schema)

    def run(batches):
        ids, known = shared.value
        step = max(1, BLOCK_CELLS // len(ids))
        for batch in batches:
            names = batch["query_id"].to_numpy()
            for low in range(0, len(batch), step):
                best = Best(k)
                best.add(np.round(matrix(batch["vector"].iloc[low : low + step]) @ known.T, DIGITS), ids)
                yield _frame(best, names[low : low + step])

    return queries.select("query_id", "vector").mapInPandas(run, schema)


def cosine_topk(
    queries: DataFrame, corpus: DataFrame, k: int, small_queries: int = SMALL_QUERIES, small_corpus: int = SMALL_CORPUS
) -> DataFrame:
    """Exact cosine top-k of (query_id, vector) against (chunk_id, vector).

    A side of checked size goes to the tasks as a matrix and the other one is read in place.
    Two larger sides are cut into coarse cells, and pairs of cells that cannot hold a hit are
    never compared.
    """
    if is_small(queries, small_queries):
        return top_k(_queries_to_corpus(queries, corpus, k), k)
    if is_small(corpus, small_corpus):
        return top_k(_corpus_to_queries(queries, corpus, k), k)
    return exact_topk(queries, corpus, k, fit_centres(corpus, CELLS))


def lsh_topk(
    queries: DataFrame, corpus: DataFrame, k: int, bucket: float = 0.5, tables: int = 12, max_distance: float = 1.2, seed: int = 42
) -> DataFrame:
    """Approximate cosine top-k: candidates by random projection, ranked exactly."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    def unit(df, key):
        v = df.select(key, array_to_vector(F.col("vector").cast("array<double>")).alias("_raw"))
        return Normalizer(inputCol="_raw", outputCol="_v").transform(v).select(key, "_v")

    docs, asked = unit(corpus, "chunk_id"), unit(queries, "query_id")
    model = BucketedRandomProjectionLSH(
        inputCol="_v", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=seed
    ).fit(docs)
    near = model.approxSimilarityJoin(asked, docs, max_distance, "_d")
    cosine = 1 - F.col("_d") * F.col("_d") / 2  # of unit vectors
    hits = near.select(
        F.col("datasetA.query_id").alias("query_id"),
        F.col("datasetB.chunk_id").alias("chunk_id"),
        F.round(cosine, DIGITS).alias("score"),
    )
    return top_k(hits, k)


def fuse(bm25_hits: DataFrame, vector_hits: DataFrame, k: int) -> DataFrame:
    """Union of two hit lists: one row per (query, chunk) with the higher score, best k."""
    both = bm25_hits.select("query_id", "chunk_id", "score", F.lit(True).alias("b"), F.lit(False).alias("v")).unionByName(
        vector_hits.select("query_id", "chunk_id", "score", F.lit(False).alias("b"), F.lit(True).alias("v"))
    )
    merged = both.groupBy("query_id", "chunk_id").agg(
        F.max("score").alias("score"), F.bool_or("b").alias("in_bm25"), F.bool_or("v").alias("in_vector")
    )
    return top_k(merged, k)


def relevance_gate(
    queries: DataFrame, corpus: DataFrame, threshold: float = RetrievalParams().relevance, enabled: bool = True
) -> DataFrame:
    """(query_id, best, is_relevant): relevant when the closest chunk reaches ``threshold``.
    Without a corpus, or when switched off, everything is relevant."""
    if not enabled:
        return queries.select("query_id", F.lit(None).cast("double").alias("best"), F.lit(True).alias("is_relevant"))
    best = cosine_topk(queries, corpus, 1).select("query_id", F.col("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").withColumn(
        "is_relevant", F.coalesce(F.col("best") >= threshold, F.lit(True))
    )


def hit_contexts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per query the ranked hits as an array of (rank, score, chunk_id, text); at most k each."""
    texts = hits.join(chunks.select("chunk_id", "text"), "chunk_id")
    return texts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "score", "chunk_id", "text"))).alias("hits")
    )
