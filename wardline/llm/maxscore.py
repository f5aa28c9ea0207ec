"""Exact top-k search by inner product with MaxScore.

Dimensions are the terms, components the weights. Vectors are packed into shards; a shard
keeps, per term, its postings (one array) and the largest and smallest weight, which bound
what the term can add to a query's score. For a query, terms are ordered by the spread of
that bound; the trailing terms whose spreads together cannot lift a vector over the
threshold are non-essential. The essential postings are traversed for all vectors of the
shard; the others are probed in blocks, only for vectors that are still competitive. The
threshold is the k-th best of the scores known so far and rises on the way. Shards' best
are merged per query.

Queries are all rows of a stated set, in blocks; every (query block, shard) pair is a task
row found by a join on the shard. Vectors that are null, or hold null or non-finite
components, take no part; shorter vectors have no postings beyond their length (zeros).
Equal scores go to the smaller id. Rows of equal id each count as a candidate, none of them
for a query of that id; a repeated query row is answered once for each distinct vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8_192
QUERY_ROWS = 4_096
PROBE = 8
FOUND = "query_id bigint, query bigint, vec_id bigint, score bigint"


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``(vec_id, v)``: usable vectors with components floor(scale * x) as double."""
    x = F.col(vector)
    fine = x.isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # floor() of a double is a bigint here; the arrays hold doubles, exact up to 2**53
    cell = lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("double")
    return vectors.filter(fine).select(F.col(key).cast("bigint").alias("vec_id"), F.transform(x, cell).alias("v"))


def _dense(table, dims: int):
    """``(ids, query keys, matrix)`` of a table of vectors, zeros beyond a vector's length."""
    import numpy as np

    table = table.combine_chunks()
    lists = table.column("v").chunk(0) if table.num_rows else None
    ids = table.column("vec_id").to_numpy().astype(np.int64)
    keys = table.column("query").to_numpy().astype(np.int64)
    dense = np.zeros((len(ids), dims))
    if lists is not None:
        offsets = lists.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(len(ids)), sizes)
        dense[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.values.to_numpy(
            zero_copy_only=False
        )[offsets[0] : offsets[-1]]
    return ids, keys, dense


def _dims(table) -> int:
    import pyarrow.compute as pc

    return (pc.max(pc.list_value_length(table.column("v"))).as_py() or 0) if table.num_rows else 0


def search_shard(query, own: int, ids, postings, top, low, k: int):
    """``(ids, scores)`` of the k best vectors of a shard for one query. ``postings`` is one
    row per term; ``top`` and ``low`` are each term's extreme weights."""
    import numpy as np

    most = np.where(query >= 0, query * top, query * low)
    least = np.where(query >= 0, query * low, query * top)
    order = np.argsort(-(most - least), kind="stable")
    rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # what the terms from here on add at most
    floor = np.append(np.cumsum(least[order][::-1])[::-1], 0)  # and at least
    alive = np.flatnonzero(ids != own)
    if not len(alive):
        return ids[:0], np.zeros(0)
    score = np.zeros(len(alive))
    for at in range(0, len(order), PROBE):
        terms = order[at : at + PROBE]
        part = postings[terms] if len(alive) == postings.shape[1] else postings[np.ix_(terms, alive)]
        score = score + query[terms] @ part
        done = at + len(terms)
        if len(alive) > k:
            # k vectors reach this much whatever their remaining terms are
            threshold = np.partition(score, len(score) - k)[len(score) - k] + floor[done]
            keep = score + rest[done] >= threshold
            alive, score = alive[keep], score[keep]
    best = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][best], score[best]


def _search(k: int):
    def run(left, right):
        import numpy as np
        import pyarrow as pa

        out = [np.zeros(0, np.int64)] * 4
        if left.num_rows and right.num_rows:
            dims = max(_dims(left), _dims(right))
            ids, _, vectors = _dense(left, dims)
            own, keys, queries = _dense(right, dims)
            large = dims * np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) >= 2**53
            if large:  # beyond exact doubles: whole numbers of any size, slower
                exact = np.vectorize(int, otypes=[object])
                vectors, queries = exact(vectors), exact(queries)
            postings = np.ascontiguousarray(vectors.T)
            top, low = (f(axis=1) if dims else np.zeros(0) for f in (postings.max, postings.min))
            found = [search_shard(q, o, ids, postings, top, low, k) for q, o in zip(queries, own, strict=True)]
            counts = [len(f[0]) for f in found]
            scores = np.concatenate([f[1] for f in found])
            scores = np.clip(scores, -(2**63), 2**63 - 1) if large else scores
            out = [np.repeat(own, counts), np.repeat(keys, counts), np.concatenate([f[0] for f in found]), scores.astype(np.int64)]
        return pa.table(dict(zip(("query_id", "query", "vec_id", "score"), out, strict=True)))

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows of ``vectors`` for each row of
    ``queries``. Repeats of a query row, id and vector, are answered once."""
    held = whole_numbers(vectors, key, vector, scale).withColumn("query", F.lit(0).cast("bigint"))
    asked = whole_numbers(queries, key, vector, scale).dropDuplicates().withColumn("query", F.xxhash64("v"))
    shards = max(1, -(-held.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    spread = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.withColumn("shard", spread(shards, "vec_id", "v")).withColumn("block", every(blocks))
    right = asked.withColumn("block", spread(blocks, "vec_id", "v")).withColumn("shard", every(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(k), FOUND)
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
