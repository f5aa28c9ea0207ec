"""Vectors in coarse cells: nearest neighbours of two large sides, approximate or exact.

Centres are the coarse quantiser: fitted by k-means on a bounded sample, or given. Every vector
belongs to the cell of its closest centre. ``cell_topk`` ranks the vectors of a query's closest
cells exactly. ``exact_topk`` first does the same, which gives each query a bar - the k-th best
score so far - and then looks into all other cells whose radius lets a member reach the bar:
angles obey the triangle inequality, so a member is at least the angle to the centre less the
cell's radius away.

Queries and vectors meet by cell, and a cell is cut into parts of bounded size on both sides, so
neither a crowded cell nor many queries end up in one task. Only centres are broadcast, at most
``MAX_CENTRES`` of them.

Vectors of zeros have no direction; their score with anything is 0. They form a cell of their
own, of which the ``k`` smallest ids can be hits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators.embedding import vector_array
from wardline.operators.ranking import DIGITS, Best, top_k
from wardline.session import materialise

SAMPLE_ROWS = 20_000
MAX_CENTRES = 4_096
PART_ROWS, PART_QUERIES = 20_000, 2_000
BLOCK_CELLS = 4_000_000
#: Scores are compared after rounding; a bar is lowered by a little more than that.
SLACK = 2e-6
ZERO_CELL = -1
VECTOR = T.ArrayType(T.DoubleType())


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1.0, norm)


def matrix(batch: pd.Series) -> np.ndarray:
    return unit_rows(np.stack(batch.to_numpy()).astype("float64"))


def dense(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix; no row becomes an object."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.unique(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError("vectors of several lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(lists), int(lengths[0]) if len(lengths) else 0)


def fit_centres(vectors: DataFrame, cells: int, sample_rows: int = SAMPLE_ROWS, rounds: int = 12) -> np.ndarray:
    """Unit centres by k-means on directions, of the ``sample_rows`` vectors of smallest digest. The
    sample is bounded, so it is worked on here; it begins with the first distinct vectors."""
    known = vectors.select(F.col("vector").cast("array<double>").alias("vector")).where(has_direction(F.col("vector")))
    digest = F.md5(F.concat_ws(",", F.col("vector").cast("array<string>")))
    sample = known.withColumn("digest", digest).orderBy("digest").limit(sample_rows).select("vector").toPandas()
    if sample.empty:
        return np.zeros((0, 0))
    rows = matrix(sample["vector"])
    first = np.sort(np.unique(np.round(rows, 9), axis=0, return_index=True)[1])
    centres = rows[first[: min(cells, MAX_CENTRES)]]
    for _ in range(rounds):
        near = np.argmax(rows @ centres.T, axis=1)
        order = np.argsort(near, kind="stable")
        begin = np.flatnonzero(np.diff(near[order], prepend=-1))
        centres = centres.copy()
        centres[near[order][begin]] = np.add.reduceat(rows[order], begin)  # a centre nobody is close to stays
        centres = unit_rows(centres)
    return centres


def has_direction(vector: Column) -> Column:
    return F.exists(vector, lambda x: x != 0)


def _nearest(rows: np.ndarray, centres: np.ndarray, some: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``some`` closest centres of each row, ties by number, and the angles to them."""
    if not len(centres):  # nothing has a direction: a single cell
        return np.zeros((len(rows), 1), int), np.zeros((len(rows), 1))
    cosine = np.clip(rows @ centres.T, -1.0, 1.0)
    order = np.argsort(-np.round(cosine, 9), axis=1, kind="stable")[:, :some]
    return order, np.arccos(np.take_along_axis(cosine, order, axis=1))


def in_cells(vectors: DataFrame, key: str, centres: np.ndarray) -> DataFrame:
    """(key, vector, cell, angle): unit vectors with their cell and the angle to its centre."""
    schema = T.StructType([vectors.schema[key]]).add("vector", VECTOR).add("cell", T.IntegerType()).add("angle", "double")

    def place(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 4_096):
                part = batch.slice(low, 4_096)
                rows = unit_rows(dense(part.column(1)))
                order, angle = _nearest(rows, centres, 1)
                zero = ~rows.any(axis=1)
                cell = np.where(zero, ZERO_CELL, order[:, 0]).astype(np.int32)
                found = [part.column(0), vector_array(rows), pa.array(cell), pa.array(np.where(zero, 0.0, angle[:, 0]))]
                yield pa.RecordBatch.from_arrays(found, names=[key, "vector", "cell", "angle"])

    known = vectors.select(key, F.col("vector").cast(VECTOR)).where(F.col("vector").isNotNull())
    return known.mapInArrow(place, schema)


def probes(queries: DataFrame, centres: np.ndarray, some: int) -> DataFrame:
    """(query_id, vector, probes): unit vectors with their ``some`` closest cells, (cell, angle) each.
    A vector of zeros is at angle 0 of every cell: none can be ruled out for it."""
    schema = T.StructType([queries.schema["query_id"]]).add("vector", VECTOR)
    probe = T.StructType().add("cell", T.IntegerType()).add("angle", "double")
    schema = schema.add("probes", T.ArrayType(probe))

    def look(batches):
        for batch in batches:
            for low in range(0, len(batch), 1_024):
                part = batch.iloc[low : low + 1_024]
                rows = matrix(part["vector"])
                order, angle = _nearest(rows, centres, some)
                angle[~rows.any(axis=1)] = 0.0
                found = [[{"cell": int(c), "angle": float(a)} for c, a in zip(*x, strict=True)] for x in zip(order, angle, strict=True)]
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy(), "vector": list(rows), "probes": found})

    return queries.select("query_id", "vector").where(F.col("vector").isNotNull()).mapInPandas(look, schema)


def _parts(rows: DataFrame, most: int) -> DataFrame:
    """(cell, n): into how many parts a cell's rows are cut; a row per cell at most."""
    return rows.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("n"))


def ranked_within(asked: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score): for (query_id, vector, cell) rows the k best of each part of
    the cell. Every part of a cell's queries meets every part of its vectors."""
    q_parts, v_parts = _parts(asked, PART_QUERIES), _parts(placed, PART_ROWS)
    shape = v_parts.select("cell", F.col("n").alias("nv")).join(q_parts.select("cell", F.col("n").alias("nq")), "cell")
    shape = F.broadcast(shape)  # a row per centre at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = asked.join(shape, "cell").select("query_id", "vector", "cell", one("query_id", "nq").alias("pq"), every("nv").alias("pv"))
    right = placed.join(shape, "cell").select("chunk_id", "vector", "cell", one("chunk_id", "nv").alias("pv"), every("nq").alias("pq"))
    schema = T.StructType([asked.schema["query_id"], placed.schema["chunk_id"]]).add("score", "double")
    keys = ["cell", "pq", "pv"]

    def rank(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = vectors.column("chunk_id").combine_chunks()
        names = queries.column("query_id").combine_chunks()
        known, asked_rows = dense(vectors.column("vector")), dense(queries.column("vector"))
        order = pc.sort_indices(ids)  # ties then go by place, and ids stay in Arrow
        ids, known = ids.take(order), known[order.to_numpy()]
        out, step = [], max(1, BLOCK_CELLS // max(1, len(ids)))
        for low in range(0, len(names) if len(ids) else 0, step):
            best = Best(k)
            best.add(np.round(asked_rows[low : low + step] @ known.T, DIGITS) + 0.0, np.arange(len(ids)))
            hits = [names.take(pa.array(low + best.q)), ids.take(pa.array(best.ids)), pa.array(best.score)]
            out.append(pa.Table.from_arrays(hits, names=["query_id", "chunk_id", "score"]))
        if not out:
            return pa.table({"query_id": names[:0], "chunk_id": ids[:0], "score": pa.array([], pa.float64())})
        return pa.concat_tables(out)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, schema)


def _probed(looked: DataFrame, columns: list[str], start: int, some: int | None) -> DataFrame:
    length = F.lit(some) if some is not None else F.greatest(F.size("probes") - start, F.lit(0))
    return looked.select(*columns, F.inline(F.slice("probes", F.lit(start + 1), length)))


def cell_topk(queries: DataFrame, corpus: DataFrame, k: int, centres: np.ndarray, n_probes: int) -> DataFrame:
    """Approximate cosine top-k of (query_id, vector) against (chunk_id, vector): the exact ranking of
    what is in the ``n_probes`` cells closest to a query."""
    looked = probes(queries, centres, n_probes)
    asked = _probed(looked, ["query_id", "vector"], 0, n_probes).drop("angle")
    return top_k(ranked_within(asked, in_cells(corpus, "chunk_id", centres).drop("angle"), k), k)


def candidate_pairs(queries: DataFrame, corpus: DataFrame, centres: np.ndarray, n_probes: int) -> DataFrame:
    """(query_id, n): how many vectors ``cell_topk`` ranks for each query."""
    sizes = in_cells(corpus, "chunk_id", centres).groupBy("cell").agg(F.count("*").alias("n"))
    asked = _probed(probes(queries, centres, n_probes), ["query_id"], 0, n_probes)
    return asked.join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.sum("n").alias("n"))


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int, centres: np.ndarray, n_probes: int = 2) -> DataFrame:
    """Exact cosine top-k of (query_id, vector) against (chunk_id, vector), both of any size."""
    placed = materialise(in_cells(corpus, "chunk_id", centres), "cells")
    looked = materialise(probes(queries, centres, len(centres)), "probes")
    zeros = placed.where(F.col("cell") == ZERO_CELL).select("chunk_id").orderBy("chunk_id").limit(k)
    zeros = zeros.agg(F.collect_list("chunk_id").alias("ids")).scalar()  # k ids at most
    asked = _probed(looked, ["query_id", "vector"], 0, n_probes).drop("angle")
    first = ranked_within(asked, placed.where(F.col("cell") != ZERO_CELL).drop("angle"), k)
    blank = looked.select("query_id", F.explode(zeros).alias("chunk_id")).withColumn("score", F.lit(0.0))
    first = materialise(top_k(first.unionByName(blank), k).drop("rank"), "first")
    bars = first.groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    bars = bars.select("query_id", F.when(F.col("n") == k, F.col("score") - SLACK).otherwise(F.lit(-2.0)).alias("bar"))
    radius = placed.where(F.col("cell") != ZERO_CELL).groupBy("cell").agg(F.max("angle").alias("radius"))
    others = _probed(looked, ["query_id"], n_probes, None).join(F.broadcast(radius), "cell")
    reach = F.cos(F.greatest(F.col("angle") - F.col("radius"), F.lit(0.0)))
    open_cells = others.join(bars, "query_id", "left").where(reach >= F.coalesce("bar", F.lit(-2.0))).select("query_id", "cell")
    rest = ranked_within(open_cells.join(looked.select("query_id", "vector"), "query_id"), placed.drop("angle"), k)
    return top_k(first.unionByName(rest), k)
