"""An inverted index as tables, and BM25 search that reads only what can still win.

``term_stats`` has a row per term, ``postings`` the term's occurrences cut into blocks:

    bucket, term, block, n, max_tf, min_length, head, chunk_ids, tfs, lengths

A term's postings are ordered by their weight before they are cut, so one block holds postings
of like weight, ``max_tf`` and ``min_length`` bound all of them, and a term that a third of all
chunks have is many rows instead of a large one. ``head`` marks a term's heaviest block. Both
tables are stored by ``bucket``, a digest of the term, and joined on it, so that a search reads
the buckets of its own terms only.

Queries and postings meet by shard of the corpus and block of queries, both of bounded size, where
a task adds up scores and gives back its own k best. A search of an index scores the head blocks
first: the k-th best of these partial scores is a bar no hit can be under. A block is read
only if its bound and all that a query's other terms can add reach the bar of some query that
asks for the term; a chunk that an unread block would have completed stays under the bar as
well, so the hits are exact. All of it is one lazy plan; nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.config import RetrievalParams
from wardline.functions.rows import explode_structs, explode_values
from wardline.operators.ranking import DIGITS, Best, top_k

BLOCK_POSTINGS = 512
SEPARATOR = "\x01"
BUCKETS = 64
#: Words or postings of a shard of the corpus, and queries, that one task scores.
SHARD_WORDS, PART_QUERIES = 1_000_000, 1_000
BLOCK_CELLS = 4_000_000
#: Scores are compared with the bar after rounding; sums of floats come out a little apart.
SLACK = 1e-5


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def posting_rows(words: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, length) from (chunk_id, words), one row per term of a chunk. Whole chunks
    are dealt by id, their words joined to one string - a third of the array's size - and so are
    counted where they are exploded. No word holds the separator, a control character."""
    length = F.size("words")
    joined = F.when(length > 0, F.array_join("words", SEPARATOR)).alias("joined")
    dealt = words.select("chunk_id", length.alias("length"), joined).repartition("chunk_id")
    rows = explode_values(dealt, ["chunk_id", "length"], F.split("joined", SEPARATOR), "term")
    return rows.groupBy("chunk_id", "length", "term").agg(F.count("*").cast("int").alias("tf"))


def weight(tf, length, average, params: RetrievalParams):
    """What an occurrence counts for, before the term's idf; rises with ``tf`` and falls with ``length``.
    For columns and arrays."""
    return tf / (tf + params.k1 * (1 - params.b + params.b * length / average))


def idf(n_chunks: Column, df: Column) -> Column:
    return F.log(1 + (n_chunks - df + 0.5) / (df + 0.5))


def posting_blocks(
    postings: DataFrame, average: Column, params: RetrievalParams = RetrievalParams(),
    block: int = BLOCK_POSTINGS, buckets: int = BUCKETS,
) -> DataFrame:
    """Blocks of (term, chunk_id, tf, length). Rows are placed by range on (bucket, term, weight),
    which spreads a frequent term over partitions, and cut there into blocks of at most ``block``;
    ``first`` marks the one that begins a term's run in its partition."""
    rows = postings.withColumns({
        "bucket": bucket_of(F.col("term"), buckets),
        "minus": -weight(F.col("tf"), F.col("length"), average, params),
    })
    order = ["bucket", "term", "minus", "chunk_id"]
    rows = rows.select("bucket", "term", "chunk_id", "tf", "length", "minus")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = T.StructType([rows.schema[c] for c in ("chunk_id", "tf", "length")])
    schema = T.StructType([rows.schema["bucket"], rows.schema["term"]]).add("block", T.LongType()).add("n", T.LongType())
    schema = schema.add("max_tf", rows.schema["tf"].dataType).add("min_length", rows.schema["length"].dataType)
    schema = schema.add("minus", T.DoubleType()).add("first", T.BooleanType()).add("rows", T.ArrayType(held))

    def cut(batches):
        number, before = TaskContext.get().partitionId() << 33, None
        for batch in batches:
            if not batch.num_rows:
                continue
            terms = batch.column("term")
            coded = terms.dictionary_encode()
            # a term has one bucket, so it alone tells where a run of postings begins
            begins = np.flatnonzero(np.diff(coded.indices.to_numpy(), prepend=-1))
            of_run = np.arange(batch.num_rows) - np.repeat(begins, np.diff(np.append(begins, batch.num_rows)))
            starts = np.flatnonzero(of_run % block == 0)
            first = of_run[starts] == 0
            first[0] = first[0] and terms[0].as_py() != before
            before = terms[-1].as_py()
            at, tf, length, minus = pa.array(starts), *(batch.column(c).to_numpy() for c in ("tf", "length", "minus"))
            offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            fields = [batch.column(c) for c in ("chunk_id", "tf", "length")]
            packed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["chunk_id", "tf", "length"]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("bucket").take(at), terms.take(at), pa.array(number + np.arange(len(starts))),
                    pa.array(np.diff(np.append(starts, batch.num_rows))), pa.array(np.maximum.reduceat(tf, starts)),
                    pa.array(np.minimum.reduceat(length, starts)), pa.array(np.minimum.reduceat(minus, starts)), pa.array(first), packed,
                ],
                names=schema.names,
            )
            number += len(starts)

    return placed.mapInArrow(cut, schema)


def term_table(blocks: DataFrame) -> DataFrame:
    """(bucket, term, df, cf, head_block, max_tf, min_length): document and corpus frequency and the
    heaviest block."""
    cf = F.sum(F.aggregate("rows", F.lit(0).cast("bigint"), lambda s, r: s + r["tf"]))
    return blocks.groupBy("bucket", "term").agg(
        F.sum("n").alias("df"), cf.alias("cf"), F.min(F.struct("minus", "block")).alias("heaviest"),
        F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"),
    ).select("bucket", "term", "df", "cf", F.col("heaviest.block").alias("head_block"), "max_tf", "min_length")


def stored_blocks(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """Blocks as they are stored: packed columns and the mark of the heaviest. That is the first one
    of the term's run; only terms whose run goes over from one partition to others - fewer than
    there are partitions - are looked up in ``terms``."""
    cut = blocks.where("first").groupBy("bucket", "term").agg(F.count("*").alias("runs")).where("runs > 1")
    heads = terms.join(F.broadcast(cut), ["bucket", "term"]).select("bucket", "term", "head_block")
    marked = blocks.join(F.broadcast(heads), ["bucket", "term"], "left")
    return marked.select(
        "bucket", "term", "block", "n", "max_tf", "min_length",
        (F.col("first") & (F.coalesce("head_block", "block") == F.col("block"))).alias("head"),
        *[F.col(f"rows.{c}").alias(name) for c, name in (("chunk_id", "chunk_ids"), ("tf", "tfs"), ("length", "lengths"))],
    )


def query_terms(queries: DataFrame, words: Column) -> DataFrame:
    """(query_id, term), each term once. The filter on its length is always true; it lets Spark
    prune the buckets of a stored index by the terms asked for."""
    return explode_values(queries, ["query_id"], F.array_distinct(words), "term").where(F.length("term") > 0)


# ---------------------------------------------------------------- scores


def _rank(asked, ids, doc, term, part, k: int):
    """The k best (query_id, chunk_id, score). ``asked``: table (query_id, term, idf) of which the
    codes ``term`` count distinct terms; ``part[i]``: weight of a term in ``ids[doc[i]]``, by doc."""
    names = asked.column("query_id").combine_chunks().dictionary_encode()
    terms = asked.column("term").combine_chunks().dictionary_encode()
    who, what = names.indices.to_numpy(), terms.indices.to_numpy()
    idf_of = np.zeros(len(terms.dictionary))
    idf_of[what] = asked.column("idf").to_numpy()
    order = np.argsort(what, kind="stable")
    askers, first = who[order], np.searchsorted(what[order], np.arange(len(terms.dictionary) + 1))
    part, n_queries = part * idf_of[term], len(names.dictionary)
    best, step = Best(k), max(1, BLOCK_CELLS // n_queries)
    for low in range(0, len(ids), step):  # bounded score blocks
        a, z = np.searchsorted(doc, [low, low + step])
        if a == z:
            continue
        width = min(step, len(ids) - low)
        many = first[term[a:z] + 1] - first[term[a:z]]  # queries asking for the term
        start = np.repeat(first[term[a:z]] - (np.cumsum(many) - many), many)
        q = askers[start + np.arange(many.sum())]
        flat = q.astype(np.int64) * width + np.repeat(doc[a:z] - low, many)
        block = np.bincount(flat, weights=np.repeat(part[a:z], many), minlength=n_queries * width)
        best.add(np.round(block.reshape(n_queries, width), DIGITS), np.arange(low, low + width), positive=True)
    at = np.zeros(0, np.int64) if best.ids is None else best.ids
    return pa.Table.from_arrays(
        [names.dictionary.take(pa.array(best.q)), ids.take(pa.array(at)), pa.array(best.score)], names=["query_id", "chunk_id", "score"]
    )


def _none(asked, rows):
    kinds = {"query_id": asked.schema.field("query_id").type, "chunk_id": rows.schema.field("chunk_id").type, "score": pa.float64()}
    return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})


def _sorted_ids(ids):
    """Distinct ids in order, and for each row its place among them: ties then go by place."""
    coded = ids.combine_chunks().dictionary_encode()
    order = pa.compute.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]


def _score_words(k: int, params: RetrievalParams):
    """Scores of whole chunks: rows (chunk_id, words)."""

    def score(asked, chunks):
        import pyarrow.compute as pc

        if not asked.num_rows or not chunks.num_rows:
            return _none(asked, chunks)
        terms = asked.column("term").combine_chunks().dictionary_encode().dictionary
        ids, place = _sorted_ids(chunks.column("chunk_id"))
        lists = chunks.column("words").combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        code = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy().astype(np.int64)
        cell = np.repeat(place, lengths) * len(terms) + code
        cell, tf = np.unique(cell[code >= 0], return_counts=True)
        doc, term = np.divmod(cell, len(terms))
        length = np.zeros(len(ids))
        length[place] = lengths
        part = weight(tf, length[doc], asked.column("average")[0].as_py(), params)
        return _rank(asked, ids, doc, term, part, k)

    return score


def _score_postings(k: int, params: RetrievalParams):
    """Scores from rows (chunk_id, term, tf, length)."""

    def score(asked, rows):
        import pyarrow.compute as pc

        if not asked.num_rows or not rows.num_rows:
            return _none(asked, rows)
        terms = asked.column("term").combine_chunks().dictionary_encode().dictionary
        ids, doc = _sorted_ids(rows.column("chunk_id"))
        code = pc.fill_null(pc.index_in(rows.column("term").combine_chunks(), value_set=terms), -1).to_numpy().astype(np.int64)
        order = np.argsort(doc, kind="stable")
        order = order[code[order] >= 0]
        tf, length = (rows.column(c).to_numpy()[order] for c in ("tf", "length"))
        part = weight(tf, length, asked.column("average")[0].as_py(), params)
        return _rank(asked, ids, doc[order], code[order], part, k)

    return score


def _scored(weighed: DataFrame, rows: DataFrame, size: DataFrame, score) -> DataFrame:
    """(query_id, chunk_id, score) of all shards of the corpus against all blocks of queries.
    ``size`` has one row (n): how many words or postings there are to score."""
    ceil = lambda n, most: F.greatest(F.ceil(F.coalesce(n, F.lit(0)) / most).cast("int"), F.lit(1))
    shards = size.select(ceil(F.col("n"), SHARD_WORDS).alias("n")).scalar()
    parts = weighed.agg(ceil(F.count_distinct("query_id"), PART_QUERIES).alias("n")).scalar()
    grid = {"_shards": shards, "_parts": parts}
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = weighed.withColumns(grid).withColumn("_part", one("query_id", "_parts")).withColumn("_shard", every("_shards"))
    right = rows.withColumns(grid).withColumn("_shard", one("chunk_id", "_shards")).withColumn("_part", every("_parts"))
    left, right = (df.drop("_shards", "_parts") for df in (left, right))
    # columns of their own: both sides may come from one table
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    schema = T.StructType([weighed.schema["query_id"], rows.schema["chunk_id"]]).add("score", "double")
    return left.groupBy("_shard", "_part").cogroup(right.groupBy("_shard", "_part")).applyInArrow(score, schema)


def search_index(
    asked: DataFrame, index: dict[str, DataFrame], k: int, params: RetrievalParams = RetrievalParams()
) -> DataFrame:
    """BM25 top-k of (query_id, term) over the tables of an index, as ``top_k`` gives it."""
    terms, blocks, stats = index["term_stats"], index["postings"], index["corpus_stats"]
    placed = asked.withColumn("stats", stats.select(F.struct("n_chunks", "avg_length", "buckets").alias("s")).scalar())
    placed = placed.select("query_id", "term", "stats.*")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets").cast("int"))
    average, one = F.col("average"), idf(F.col("n_chunks"), F.col("df"))
    weighed = placed.join(terms, ["bucket", "term"]).select(
        "query_id", "bucket", "term", one.alias("idf"), F.col("avg_length").alias("average"), "max_tf", "min_length"
    )
    most = F.col("idf") * weight(F.col("max_tf"), F.col("min_length"), average, params)
    weighed = weighed.select("query_id", "bucket", "term", "idf", "average", most.alias("most"))

    def found(opened: DataFrame) -> DataFrame:
        rows = explode_structs(opened, ["term"], F.arrays_zip("chunk_ids", "tfs", "lengths"), "chunk_ids")
        rows = rows.select(F.col("chunk_ids").alias("chunk_id"), "term", F.col("tfs").alias("tf"), F.col("lengths").alias("length"))
        weights = weighed.select("query_id", "term", "idf", "average")
        return top_k(_scored(weights, rows, opened.agg(F.sum("n").alias("n")), _score_postings(k, params)), k)

    known = weighed.select("bucket", "term").distinct()
    sure = found(known.join(blocks.where("head"), ["bucket", "term"]))
    bar = sure.groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    bar = bar.select("query_id", F.when(F.col("n") == k, F.col("score") - SLACK).otherwise(F.lit(0.0)).alias("bar"))
    total = weighed.groupBy("query_id").agg(F.sum("most").alias("total")).join(bar, "query_id", "left")
    # what a block must be able to give per unit of idf for the most lenient of the term's queries
    missing = F.coalesce("bar", F.lit(0.0)) - (F.col("total") - F.col("most"))
    floors = weighed.join(total, "query_id").groupBy("bucket", "term").agg(
        F.min(missing / F.col("idf")).alias("floor"), F.first("average").alias("average")
    )
    bound = weight(F.col("max_tf"), F.col("min_length"), average, params)
    return found(floors.join(blocks, ["bucket", "term"]).where(bound >= F.col("floor"))).select("query_id", "chunk_id", "score", "rank")


def search_words(
    asked: DataFrame, words: DataFrame, k: int, params: RetrievalParams = RetrievalParams()
) -> DataFrame:
    """BM25 top-k of (query_id, term) over (chunk_id, words) without an index."""
    size = F.size("words")
    stats = words.agg(F.count("*").alias("n_chunks"), F.avg(size).alias("average"), F.sum(size).alias("n"))
    known = asked.select("term").distinct()
    distinct = explode_values(words, [], F.array_distinct("words"), "term").join(known, "term", "left_semi")
    counted = distinct.groupBy("term").agg(F.count("*").alias("df"))
    counted = counted.withColumn("stats", stats.select(F.struct("n_chunks", "average").alias("s")).scalar())
    weighed = asked.join(counted, "term").select(
        "query_id", "term", idf(F.col("stats.n_chunks"), F.col("df")).alias("idf"), F.col("stats.average").alias("average")
    )
    scores = _scored(weighed, words.select("chunk_id", "words"), stats.select("n"), _score_words(k, params))
    return top_k(scores, k).select("query_id", "chunk_id", "score", "rank")
