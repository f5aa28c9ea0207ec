import hashlib
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.config import ChunkParams, RetrievalParams
from wardline.operators import cells
from wardline.operators import postings as P
from wardline.operators import retrieval as R
from wardline.operators.embedding import HashingEmbedder, ModelEmbedder, PrecomputedEmbedder, TfIdfEmbedder
from wardline.plans.retrieval import build_index, hybrid_search, index_exists, load_index, open_index

WORDS = "alpha beta gamma delta eps zeta eta theta".split()


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS[: rng.randrange(1, 9)]) for _ in range(rng.randrange(0, 12))) for _ in range(n)]


DOCS, ASKED = texts(120, 1), texts(25, 2) + ["unknown words", ""]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(DOCS)], "chunk_id string, text string").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "query_id int, text string")


def brute_bm25(k):
    docs = [re.findall(r"\w+", d) for d in DOCS]
    average = sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    out = set()
    for q, text in enumerate(ASKED):
        scores = []
        for i, d in enumerate(docs):
            tf, s = Counter(d), 0.0
            for t in set(re.findall(r"\w+", text)):
                if tf[t]:
                    s += math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / average))
            if s > 0:
                scores.append((-round(s, 6), f"c{i:03d}"))
        out |= {(q, c, -s, r + 1) for r, (s, c) in enumerate(sorted(scores)[:k])}
    return out


def hits_of(df):
    return {tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect()}


@pytest.mark.parametrize("k", [1, 4, 500])
def test_bm25_equals_brute_force(chunks, queries, k):
    assert hits_of(R.bm25_topk(queries, chunks, k)) == brute_bm25(k)


@pytest.fixture(scope="module")
def index(chunks):
    """Index tables with blocks of two postings."""
    block, buckets = 2, 3
    words = R.word_rows(chunks)
    stats = R.corpus_stats(words).withColumn("buckets", F.lit(buckets))
    blocks = P.posting_blocks(P.posting_rows(words), stats.select("avg_length").scalar(), block=block, buckets=buckets).cache()
    terms = P.term_table(blocks).cache()
    yield {"corpus_stats": stats, "term_stats": terms, "postings": P.stored_blocks(blocks, terms).cache()}
    chunks.sparkSession.catalog.clearCache()


@pytest.mark.parametrize("k, params", [(1, RetrievalParams()), (3, RetrievalParams(k1=0.4, b=0.1)), (500, RetrievalParams())])
def test_index_search_equals_search_without_index(chunks, queries, index, k, params):
    got = hits_of(R.bm25_topk(queries, None, k, params, index))
    assert got == hits_of(R.bm25_topk(queries, chunks, k, params)) and got


def test_blocks_hold_every_posting_once_within_their_bounds(chunks, index):
    rows = index["postings"].collect()
    found = Counter()
    for r in rows:
        assert r["n"] == len(r["chunk_ids"]) and r["max_tf"] == max(r["tfs"]) and r["min_length"] == min(r["lengths"])
        found.update((r["term"], c, tf) for c, tf in zip(r["chunk_ids"], r["tfs"], strict=True))
    want = Counter((t, f"c{i:03d}", n) for i, d in enumerate(DOCS) for t, n in Counter(re.findall(r"\w+", d)).items())
    assert found == want
    assert Counter(r["term"] for r in rows if r["head"]) == Counter({r["term"] for r in rows})


def test_search_plans_without_running_a_job(spark, chunks, queries, index):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "planning only")
    R.bm25_topk(queries, None, 3, index=index)
    R.bm25_topk(queries, chunks, 3)
    assert not tracker.getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(5)
    vec = lambda: [rng.choice([-1.0, 0.0, 1.0]) for _ in range(6)]  # noqa: E731  (many ties)
    corpus = spark.createDataFrame([(i, vec()) for i in range(90)], "chunk_id int, vector array<double>").repartition(4)
    return spark.createDataFrame([(i, vec()) for i in range(15)], "query_id int, vector array<float>"), corpus


def test_cosine_ways_agree_with_brute_force(vectors):
    asked, corpus = vectors
    q, c = [(r[0], r[1]) for r in asked.collect()], [(r[0], r[1]) for r in corpus.collect()]
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    want = set()
    for qi, qv in q:
        best = sorted((-round(sum(a * b for a, b in zip(qv, cv)) / norm(qv) / norm(cv), 6) + 0.0, ci) for ci, cv in c)[:5]
        want |= {(qi, ci, rank + 1) for rank, (_, ci) in enumerate(best)}
    for options in ({}, {"small_queries": 4, "small_corpus": 0}, {"small_queries": 4, "small_corpus": 1000}):
        hits = R.cosine_topk(asked, corpus, 5, **options)
        assert {tuple(r) for r in hits.select("query_id", "chunk_id", "rank").collect()} == want


def test_relevance_gate_without_corpus(vectors):
    asked, corpus = vectors
    for df in (R.relevance_gate(asked, corpus.limit(0)), R.relevance_gate(asked, corpus, enabled=False)):
        assert [r["is_relevant"] for r in df.collect()] == [True] * 15
    split = R.relevance_gate(asked, corpus, 0.9)
    assert {r["is_relevant"] for r in split.collect()} == {True, False}


def test_lsh_finds_most_of_the_nearest(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    corpus = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = {tuple(r) for r in R.cosine_topk(asked, corpus, 3).select("query_id", "chunk_id").collect()}
    near = {tuple(r) for r in R.lsh_topk(asked, corpus, 3, max_distance=1.5).select("query_id", "chunk_id").collect()}
    assert len(exact & near) > 0.9 * len(exact)


@pytest.fixture(scope="module")
def clusters(spark):
    """Vectors around 12 directions, one crowded; copies, a tie of many, zeros; ids that are strings."""
    rng = random.Random(8)
    middle = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    near = lambda m: [x + rng.gauss(0, 0.15) for x in m]
    rows = [near(middle[0 if i % 3 == 0 else i % 12]) for i in range(600)] + [middle[1]] * 40 + [[0.0] * 8] * 30
    corpus = [(f"v{i:04d}", v) for i, v in enumerate(rows)]
    asked = [(i, near(middle[i % 12])) for i in range(60)] + [(60, [0.0] * 8), (61, [rng.gauss(0, 1) for _ in range(8)]), (62, None)]
    return (
        spark.createDataFrame(asked, "query_id int, vector array<double>").repartition(3),
        spark.createDataFrame([*corpus, ("none", None)], "chunk_id string, vector array<double>").repartition(3),
        asked[:62], corpus,
    )


def brute_cosine(asked, corpus, k):
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    out = {}
    for q, qv in asked:
        scores = ((-round(sum(a * b for a, b in zip(qv, v)) / norm(qv) / norm(v), 6) + 0.0, c) for c, v in corpus)
        out[q] = [c for _, c in sorted(scores)[:k]]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["chunk_id"])
    return out


@pytest.mark.parametrize("part_rows", [7, 20_000])
def test_two_large_sides_equal_brute_force(clusters, monkeypatch, part_rows):
    asked, corpus, asked_rows, corpus_rows = clusters
    monkeypatch.setattr(cells, "PART_ROWS", part_rows)
    monkeypatch.setattr(cells, "PART_QUERIES", part_rows)
    centres = cells.fit_centres(corpus, 16)
    assert ranked(cells.exact_topk(asked, corpus, 5, centres)) == brute_cosine(asked_rows, corpus_rows, 5)


def test_few_cells_find_most_of_the_nearest(clusters):
    asked, corpus, asked_rows, corpus_rows = clusters
    centres = cells.fit_centres(corpus, 24)
    got, want = ranked(cells.cell_topk(asked, corpus, 5, centres, 4)), brute_cosine(asked_rows[:60], corpus_rows, 5)
    assert sum(len(set(got.get(q, ())) & set(w)) for q, w in want.items()) >= 0.9 * 5 * len(want)
    assert {tuple(c) for c in cells.fit_centres(corpus, 24)} == {tuple(c) for c in centres}


def test_cells_of_empty_sides(clusters):
    asked, corpus, *_ = clusters
    centres = cells.fit_centres(corpus, 4)
    for a, c in ((asked.limit(0), corpus), (asked, corpus.limit(0))):
        assert cells.exact_topk(a, c, 3, centres).count() == 0 and cells.cell_topk(a, c, 3, centres, 2).count() == 0


def test_failed_rebuild_leaves_the_index_readable(chunks, tmp_path):
    path, embedder = str(tmp_path / "index"), HashingEmbedder(8)
    build_index(chunks, embedder, path)

    class Broken:
        def attach(self, df, text, out):
            return df.withColumn(out, F.raise_error(F.lit("no model")).cast("array<double>"))

    with pytest.raises(Exception, match="no model"):
        build_index(chunks.limit(3), Broken(), path)
    assert index_exists(chunks.sparkSession, path) and load_index(chunks.sparkSession, path)["chunks"].count() == 120


def test_one_query_reads_the_buckets_of_its_terms(spark, chunks, tmp_path):
    path = str(tmp_path / "index")
    build_index(chunks, HashingEmbedder(8), path, buckets=16)
    index = load_index(spark, path)
    one = spark.createDataFrame([(1, "alpha theta")], "query_id int, text string")
    hits = R.bm25_topk(one, None, 3, index=index)
    assert "dynamicpruning" in hits._jdf.queryExecution().executedPlan().toString().lower()
    assert hits_of(hits) == {(1, *h[1:]) for h in hits_of(R.bm25_topk(one, chunks, 3))}


def test_index_is_built_once_and_on_request(chunks, queries, tmp_path):
    path, embedder = str(tmp_path / "index"), HashingEmbedder(16)
    assert not index_exists(chunks.sparkSession, path)
    build_index(chunks, embedder, path)
    assert index_exists(chunks.sparkSession, path)
    direct = hybrid_search(queries, embedder, chunks)
    stored = hybrid_search(queries, embedder, index=load_index(chunks.sparkSession, path))
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, stored.collect()))
    fewer = chunks.where("chunk_id < 'c010'")
    assert open_index(fewer, embedder, path)["chunks"].count() == 120
    assert open_index(fewer, embedder, path, force_rebuild=True)["chunks"].count() == 10


def test_hybrid_marks_where_hits_come_from(chunks, queries):
    hits = hybrid_search(queries, HashingEmbedder(16), chunks, params=RetrievalParams(2, 2, 3)).collect()
    assert all(r["in_bm25"] or r["in_vector"] for r in hits) and max(r["rank"] for r in hits) == 3


@given(st.lists(st.integers(0, 10), max_size=60), st.integers(10, 25), st.integers(0, 9))
def test_spans_cover_everything_within_bounds(counts, size, overlap):
    spans = R.spans_of(counts, size, overlap)
    assert ([] if not counts else [0, len(counts)]) == ([] if not spans else [spans[0][0], spans[-1][1]])
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and sum(counts[c:b]) <= overlap
    assert all(sum(counts[a:b]) <= size for a, b in spans)


def test_long_sentences_are_cut_without_losing_text(spark):
    text = "one two three four five six seven. 八 九！ ten"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "...")], "id int, text string")
    rows = R.sentence_chunks(df, ["id"], "text", ChunkParams(3, 0)).orderBy("id", "pos").collect()
    assert "".join(r["chunk"] for r in rows if r["id"] == 1) == text
    assert all(r["n_tokens"] <= 3 for r in rows)


def test_embedders(spark, chunks):
    ready = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    assert PrecomputedEmbedder().attach(ready, "x", "v").first()["v"] == [1.0, 2.0]

    def load():
        return lambda batch: [[float(len(t)), 1.0] for t in batch]

    assert ModelEmbedder(load).attach(chunks, "text", "v").where("chunk_id = 'c000'").first()["v"] == [float(len(DOCS[0])), 1.0]
    tfidf = TfIdfEmbedder(32).fit(chunks, "text").attach(chunks, "text", "v").where("length(text) > 0").first()["v"]
    assert abs(sum(x * x for x in tfidf) - 1) < 1e-9


def test_hashed_words_stay_in_arrow(spark):
    """Batches of any cut, with texts that are missing or without words, and no vocabulary kept."""
    texts = ["a b a C", "", None, "x y z", "é a"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["i"]: r["v"] for r in HashingEmbedder(8).attach(df, "text", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, text in enumerate(texts):
        want = [0.0] * 8
        for w in (text or "").lower().split():
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8] += 1
        assert got[i] == want


def test_blocks_are_cut_without_another_shuffle(spark):
    """A term that spans range partitions has one head; blocks are dealt by chunk and by range only."""
    docs = spark.createDataFrame([(f"c{i:03d}", "all " * (1 + i % 3) + f"w{i % 5}") for i in range(90)], "chunk_id string, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        found = P.posting_blocks(P.posting_rows(R.word_rows(docs)), F.lit(2.0), block=4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange rangepartitioning") == 1
        blocks = found.cache()
        assert blocks.where("first AND term = 'all'").count() > 1
        rows = P.stored_blocks(blocks, P.term_table(blocks)).collect()
        blocks.unpersist()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert Counter(r["term"] for r in rows if r["head"]) == Counter({r["term"] for r in rows})
    weights = [(max(P.weight(t, n, 2.0, RetrievalParams()) for t, n in zip(r["tfs"], r["lengths"], strict=True)), r["head"]) for r in rows if r["term"] == "all"]
    assert max(weights)[0] == next(w for w, head in weights if head) and sum(len(r["chunk_ids"]) for r in rows) == 180
