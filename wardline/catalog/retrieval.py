"""Retrieval: ``benchmark`` passages as queries over the lines of ``documents``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wardline.catalog import fixtures as fx
from wardline.catalog import sqltext as q
from wardline.catalog.chats import PAIRS_SQL, pairs
from wardline.catalog.gates import pair_gate_sql
from wardline.catalog.registry import query, table
from wardline.config import MAX_CONTEXT_CHARS, NO_RESULT_TEXT, SERVICE_RETRIEVAL, TRUNCATED_NOTICE, ChunkParams
from wardline.functions import messages as M
from wardline.operators import cells
from wardline.operators import retrieval as R
from wardline.operators.embedding import HashingEmbedder
from wardline.plans import gates
from wardline.plans.retrieval import hybrid_search, open_index, retrieved_text
from wardline.session import scratch_path

EMBEDDER = HashingEmbedder(64)
DOMAIN_THRESHOLD = 0.8

CHUNKS_SQL = f"""lns AS (SELECT doc_id, list_filter(list_transform(string_split({q.strip('text')}, chr(10)), lambda s: {q.strip('s')}), lambda s: length(s) > 10) AS ls FROM documents),
ln AS (SELECT doc_id, unnest(ls) AS text, unnest(range(len(ls))) AS pos FROM lns),
chunks AS (SELECT doc_id || '-' || pos AS chunk_id, text FROM ln)"""


def chunks(spark, sf):
    rows = R.line_chunks(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])
    return rows.select(F.concat_ws("-", "doc_id", "pos").alias("chunk_id"), F.col("chunk").alias("text"))


def queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("kb_chunks", f"WITH {CHUNKS_SQL} SELECT doc_id, pos, text AS chunk FROM ln")
def kb_chunks(spark, sf):
    return R.line_chunks(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])


_UNIT_SPLIT = "regexp_replace(text, '([。.])', '\\1' || chr(1), 'g')"
SPLITTER_SQL = f"""u0 AS (SELECT doc_id, list_filter(string_split({_UNIT_SPLIT}, chr(1)), lambda s: length(s) > 0) AS ss FROM documents),
u1 AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM u0),
u2 AS (SELECT *, {q.tokens('s')} AS toks FROM u1),
u3 AS (SELECT doc_id, i, s, unnest(CASE WHEN len(toks) > 128 THEN regexp_extract_all(s, '(?s)(?:{q.OTHER}*{q.WORD}+){{1,128}}{q.OTHER}*') ELSE [s] END) AS u,
 unnest(range(CASE WHEN len(toks) > 128 THEN len(regexp_extract_all(s, '(?s)(?:{q.OTHER}*{q.WORD}+){{1,128}}{q.OTHER}*')) ELSE 1 END)) AS j FROM u2),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS n, u, len({q.tokens('u')}) AS c FROM u3),
cum AS (SELECT doc_id, n, u, c, CAST(sum(c) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS upto, count(*) OVER (PARTITION BY doc_id) AS total FROM u),
ends AS (SELECT a.doc_id, a.n AS a, greatest(a.n, max(b.n)) + 1 AS b FROM cum a JOIN cum b ON b.doc_id = a.doc_id AND b.n >= a.n
 AND (b.n = a.n OR b.upto - (a.upto - a.c) <= 128) GROUP BY a.doc_id, a.n),
nexts AS (SELECT e.doc_id, e.a, e.b, min(s.n) AS nxt FROM ends e JOIN cum f ON f.doc_id = e.doc_id AND f.n = e.b
 JOIN cum s ON s.doc_id = e.doc_id AND s.n > e.a AND s.n <= e.b
 AND (s.n = e.b OR ((f.upto - f.c) - (s.upto - s.c) <= 20 AND f.upto - (s.upto - s.c) <= 128)) GROUP BY e.doc_id, e.a, e.b)"""


@query(
    "sentence_chunks",
    f"""WITH RECURSIVE {SPLITTER_SQL}, walk AS (SELECT doc_id, a, b, CAST(0 AS BIGINT) AS pos FROM ends WHERE a = 0
 UNION ALL SELECT w.doc_id, e.a, e.b, w.pos + 1 FROM walk w JOIN nexts x ON x.doc_id = w.doc_id AND x.a = w.a
  JOIN ends e ON e.doc_id = w.doc_id AND e.a = x.nxt)
SELECT w.doc_id, w.pos, CAST(sum(c.c) AS BIGINT) AS n_tokens, string_agg(c.u, '' ORDER BY c.n) AS chunk
FROM walk w JOIN cum c ON c.doc_id = w.doc_id AND c.n >= w.a AND c.n < w.b GROUP BY w.doc_id, w.pos""",
)
def sentence_chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return R.sentence_chunks(docs, ["doc_id"], "text", ChunkParams(128, 20))


# ---------------------------------------------------------------- BM25

BM25_SQL = f"""{CHUNKS_SQL}, ct AS (SELECT chunk_id, {q.tokens('lower(text)')} AS toks FROM chunks),
cs AS (SELECT count(*) AS n, avg(len(toks)) AS average FROM ct),
occ AS (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM ct),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM occ GROUP BY ALL),
df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term),
qt AS (SELECT item_id AS query_id, unnest(list_distinct({q.tokens('lower(text)')})) AS term FROM benchmark),
bm AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / average))), 6) AS score
 FROM qt JOIN tf USING (term) JOIN df USING (term), cs GROUP BY query_id, chunk_id)"""


def ranked_sql(source: str, k: int) -> str:
    return f"""SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
 FROM {source}) WHERE rank <= {k}"""


@query("bm25_stats", f"WITH {BM25_SQL} SELECT term, df, cf, n AS n_chunks, round(average, 6) AS avg_length FROM df, cs")
def bm25_stats(spark, sf):
    words = R.word_rows(chunks(spark, sf))
    stats = R.corpus_stats(words)
    return R.term_stats(words).select(
        "term", "df", "cf",
        stats.select("n_chunks").scalar().alias("n_chunks"),
        F.round(stats.select("avg_length").scalar(), 6).alias("avg_length"),
    )


@query("bm25_from_index", f"WITH {BM25_SQL} {ranked_sql('bm', 3)}")
def bm25_from_index(spark, sf):
    """The same search over postings written to the shared folder."""
    index = open_index(chunks(spark, sf), EMBEDDER, scratch_path(spark, "index"))
    return R.bm25_topk(queries(spark, sf), None, 3, index=index)


@query("bm25_topk", f"WITH {BM25_SQL} {ranked_sql('bm', 3)}")
def bm25_topk(spark, sf):
    return R.bm25_topk(queries(spark, sf), chunks(spark, sf), 3)


# ---------------------------------------------------------------- vectors


def vectors_sql(name: str, source: str, key: str, text: str = "text") -> str:
    """CTE (key, b, v): hashed word counts divided by their norm, non-zero buckets only."""
    return f"""{name}0 AS (SELECT {key}, unnest({q.tokens(f'lower({text})')}) AS term FROM {source}),
{name}1 AS (SELECT {key}, CAST('0x' || substr(md5(term), 1, 8) AS UBIGINT) % 64 AS b, count(*) AS c FROM {name}0 GROUP BY ALL),
{name} AS (SELECT {key}, b, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS v FROM {name}1)"""


VECTOR_SQL = f"""{CHUNKS_SQL}, bq AS (SELECT item_id AS query_id, text FROM benchmark),
{vectors_sql('qv', 'bq', 'query_id')}, {vectors_sql('cv', 'chunks', 'chunk_id')},
cs_ AS (SELECT query_id, chunk_id, round(sum(qv.v * cv.v), 6) AS score FROM qv JOIN cv USING (b) GROUP BY query_id, chunk_id)"""


@query("cosine_topk", f"WITH {VECTOR_SQL} {ranked_sql('cs_', 3)}")
def cosine_topk(spark, sf):
    asked = EMBEDDER.attach(queries(spark, sf), "text", "vector")
    corpus = EMBEDDER.attach(chunks(spark, sf), "text", "vector")
    return R.cosine_topk(asked, corpus, 3)


def centroids(spark, sf):
    """Mean vector of each label of ``embeddings``."""
    flat = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    per = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_v"))
    return per.select("label", F.transform("_v", lambda e: e["m"]).alias("vector"))


_CENTROIDS = """fl AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
ce AS (SELECT label, i, avg(x) AS m FROM fl GROUP BY label, i),
cen AS (SELECT label, list(m ORDER BY i) AS v FROM ce GROUP BY label)"""


@query(
    "centroid_neighbours",
    f"""WITH {_CENTROIDS}, s AS (SELECT cen.label AS query_id, vec_id AS chunk_id,
 round(list_cosine_similarity(cen.v, CAST(embedding AS DOUBLE[])), 6) AS score FROM cen, embeddings)
{ranked_sql('s', 5)}""",
)
def centroid_neighbours(spark, sf):
    """The vectors closest to the centre of each label."""
    asked = centroids(spark, sf).select(F.col("label").alias("query_id"), "vector")
    corpus = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return R.cosine_topk(asked, corpus, 5)


@query(
    "relevance_gate",
    f"""WITH {_CENTROIDS}, s AS (SELECT vec_id AS query_id, max(round(list_cosine_similarity(cen.v, CAST(embedding AS DOUBLE[])), 6)) AS best
 FROM embeddings, cen GROUP BY vec_id) SELECT query_id, best, best >= 0.35 AS is_relevant FROM s""",
)
def relevance_gate(spark, sf):
    """Which vectors are close to the centre of any label."""
    asked = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    corpus = centroids(spark, sf).select(F.col("label").alias("chunk_id"), "vector")
    return R.relevance_gate(asked, corpus)


@query("lsh_topk")
def lsh_topk(spark, sf):
    asked = centroids(spark, sf).select(F.col("label").alias("query_id"), "vector")
    corpus = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return R.lsh_topk(asked, corpus, 5)


# ---------------------------------------------------------------- coarse cells

SOME_CELLS, SOME_PROBES = 64, 6
_CELLS_SQL = f"""{VECTOR_SQL}, coarse AS (SELECT CAST(row_number() OVER (ORDER BY md5(text)) - 1 AS INT) AS cell, text
 FROM (SELECT DISTINCT text FROM chunks) QUALIFY row_number() OVER (ORDER BY md5(text)) <= {SOME_CELLS}),
{vectors_sql('zv', 'coarse', 'cell')},
placed AS (SELECT chunk_id, cell FROM (SELECT chunk_id, cell, sum(cv.v * zv.v) AS s FROM cv JOIN zv USING (b) GROUP BY chunk_id, cell)
 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY round(s, 9) DESC, cell) = 1),
every AS (SELECT DISTINCT chunk_id FROM cv), member AS (SELECT chunk_id, coalesce(cell, 0) AS cell FROM every LEFT JOIN placed USING (chunk_id)),
sims AS (SELECT query_id, cell, sum(qv.v * zv.v) AS s FROM qv JOIN zv USING (b) GROUP BY query_id, cell),
probed AS (SELECT b.query_id, coarse.cell FROM bq b CROSS JOIN coarse LEFT JOIN sims ON sims.query_id = b.query_id AND sims.cell = coarse.cell
 QUALIFY row_number() OVER (PARTITION BY b.query_id ORDER BY round(coalesce(s, 0), 9) DESC, coarse.cell) <= {SOME_PROBES}),
ch AS (SELECT cs_.* FROM cs_ JOIN member m USING (chunk_id) JOIN probed p ON p.query_id = cs_.query_id AND p.cell = m.cell)"""


def line_vectors(spark, sf):
    return EMBEDDER.attach(chunks(spark, sf), "text", "vector").select("chunk_id", "vector")


def query_vectors(spark, sf):
    return EMBEDDER.attach(queries(spark, sf), "text", "vector").select("query_id", "vector")


@query("cell_topk", f"WITH {_CELLS_SQL} {ranked_sql('ch', 3)}")
def cell_topk(spark, sf):
    """Approximate search in the cells around 64 given centres, lines of smallest digest."""
    some = chunks(spark, sf).select("text").distinct().orderBy(F.md5("text")).limit(SOME_CELLS).withColumn("at", F.md5("text"))
    given = EMBEDDER.attach(some, "text", "vector").orderBy("at").collect()  # SOME_CELLS rows
    centres = cells.unit_rows(np.array([r["vector"] for r in given], dtype="float64").reshape(-1, EMBEDDER.dims))
    return cells.cell_topk(query_vectors(spark, sf), line_vectors(spark, sf), 3, centres, SOME_PROBES)


@query(
    "cosine_topk_two_sides",
    f"WITH {VECTOR_SQL} {ranked_sql('cs_', 3)}",
)
def cosine_topk_two_sides(spark, sf):
    """Exact search the way that two large sides take: cells, then all that can still reach the bar."""
    lines = line_vectors(spark, sf)
    return cells.exact_topk(query_vectors(spark, sf), lines, 3, cells.fit_centres(lines, 64))


FINE_CELLS, FINE_PROBES = 1024, 32


@query(
    "cell_quality",
    f"""WITH {VECTOR_SQL}, kth AS ({ranked_sql('cs_', 3)})
SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_hits, TRUE AS recall_reached, TRUE AS few_candidates FROM kth""",
)
def cell_quality(spark, sf):
    """Approximate against exact search: at least 0.9 of the hits from less than a tenth of the pairs."""
    asked, lines = query_vectors(spark, sf), line_vectors(spark, sf)
    centres = cells.fit_centres(lines, FINE_CELLS)
    exact = R.cosine_topk(asked, lines, 3).groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("k"))
    near = cells.cell_topk(asked, lines, 3, centres, FINE_PROBES).select("query_id", "score")
    pairs = cells.candidate_pairs(asked, lines, centres, FINE_PROBES).agg(F.sum("n").alias("n"))
    # a line as close as the last of the exact hits is as good as that one
    found = near.join(exact, "query_id").where("score >= bar").agg(F.count("*").alias("n"))
    counts = (asked.agg(F.count("*").alias("n")), lines.agg(F.count("*").alias("n")))
    all_pairs = counts[0].scalar() * counts[1].scalar()
    return exact.agg(F.count("*").alias("n_queries"), F.sum("k").alias("n_hits")).select(
        "n_queries", "n_hits", (found.scalar() >= 0.9 * F.col("n_hits")).alias("recall_reached"),
        (pairs.scalar() < 0.1 * all_pairs).alias("few_candidates"),
    )


# ---------------------------------------------------------------- fusion and prompts

HYBRID_SQL = f"""{BM25_SQL}, {VECTOR_SQL.replace(CHUNKS_SQL + ', ', '')},
bh AS ({ranked_sql('bm', 5)}), vh AS ({ranked_sql('cs_', 5)}),
fu AS (SELECT query_id, chunk_id, max(score) AS score, bool_or(b) AS in_bm25, bool_or(v) AS in_vector FROM
 (SELECT query_id, chunk_id, score, TRUE AS b, FALSE AS v FROM bh UNION ALL SELECT query_id, chunk_id, score, FALSE, TRUE FROM vh) GROUP BY query_id, chunk_id),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu) WHERE rank <= 10)"""


@query("hybrid_topk", f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, score, in_bm25, in_vector, rank FROM hy")
def hybrid_topk(spark, sf):
    return hybrid_search(queries(spark, sf), EMBEDDER, chunks(spark, sf), params=SERVICE_RETRIEVAL)


@query("hybrid_from_index", f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, score, in_bm25, in_vector, rank FROM hy")
def hybrid_from_index(spark, sf):
    """The same search through index tables written to the shared folder."""
    index = open_index(chunks(spark, sf), EMBEDDER, scratch_path(spark, "index"))
    return hybrid_search(queries(spark, sf), EMBEDDER, index=index, params=SERVICE_RETRIEVAL)


@query(
    "context_prompt",
    f"""WITH {BM25_SQL}, h AS ({ranked_sql('bm', 3)})
SELECT query_id, 'Context:' || chr(10) || string_agg('- ' || c.text, chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(b.text)
 || chr(10) || 'Answer using the context above.' AS prompt
FROM h JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = h.query_id GROUP BY query_id""",
)
def context_prompt(spark, sf):
    c, asked = chunks(spark, sf), queries(spark, sf)
    per_query = R.hit_contexts(R.bm25_topk(asked, c, 3), c).join(asked, "query_id")
    return per_query.select(
        "query_id", M.context_prompt(F.transform("hits", lambda h: h["text"]), F.col("text")).alias("prompt")
    )


_RESULT_SQL = f"""{BM25_SQL}, h AS ({ranked_sql('bm', 3)}),
rt AS (SELECT query_id, any_value(b.text) AS question, '查询问题: ' || any_value(b.text) || chr(10) || chr(10) || '检索到' || count(*) || '条相关信息:' || chr(10)
 || string_agg(chr(10) || '[结果' || rank || ']' || chr(10) || '内容: ' || c.text || chr(10) || '相关度: ' || CAST(round(CAST(score AS DECIMAL(18, 6)), 4) AS VARCHAR), chr(10) ORDER BY rank) AS context
 FROM h JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = h.query_id GROUP BY query_id)"""


@query("result_text", f"WITH {_RESULT_SQL} SELECT query_id, context FROM rt")
def result_text(spark, sf):
    c, asked = chunks(spark, sf), queries(spark, sf)
    return retrieved_text(R.bm25_topk(asked, c, 3), c, asked)


def clean_sql(x: str) -> str:
    squeezed = f"regexp_replace({q.strip(x)}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    bare = f"list_transform(string_split({squeezed}, chr(10)), lambda s: {q.strip('s')})"
    kept = (
        f"list_filter(string_split({squeezed}, chr(10)), lambda s, i: length({q.strip('s')}) = 0 "
        f"OR list_position({bare}, {q.strip('s')}) = i)"
    )
    joined = f"array_to_string({kept}, chr(10))"
    notice = TRUNCATED_NOTICE.replace("\n", "' || chr(10) || '")
    return (
        f"CASE WHEN {x} = '' THEN '{NO_RESULT_TEXT}' WHEN length({joined}) > {MAX_CONTEXT_CHARS} "
        f"THEN left({joined}, {MAX_CONTEXT_CHARS}) || '{notice}' ELSE {joined} END"
    )


@query("clean_context", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean_context(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.clean_context(F.col("text")).alias("cleaned"))


_HEAD, _REST = M.DEFAULT_SAFE_TEMPLATE.split("{context}")
_MIDDLE, _TAIL = _REST.split("{query}")


@query(
    "safe_messages",
    f"""WITH {_RESULT_SQL}, b AS (SELECT item_id AS query_id, text FROM benchmark)
SELECT b.query_id, 'system:{M.DEFAULT_SAFE_SYSTEM}|user:' || '{_HEAD}' || CASE WHEN rt.context IS NULL THEN '{NO_RESULT_TEXT}' ELSE {clean_sql('rt.context')} END
 || '{_MIDDLE}' || b.text || '{_TAIL}' AS messages FROM b LEFT JOIN rt USING (query_id)""",
)
def safe_messages(spark, sf):
    asked = queries(spark, sf)
    context = result_text(spark, sf)
    prompt = M.safe_prompt(F.col("text"), F.col("context"))
    rows = asked.join(context, "query_id", "left").select("query_id", M.rag_messages(prompt).alias("m"))
    said = F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"]))
    return rows.select("query_id", F.array_join(said, "|").alias("messages"))


# ---------------------------------------------------------------- gates with retrieval

_DOMAIN_SQL = f"""{CHUNKS_SQL}, {PAIRS_SQL}, pq AS (SELECT conv_id || '-' || turn AS query_id, conv_id, turn, user_message AS text FROM pairs),
{vectors_sql('bv', 'bench_', 'chunk_id')}, {vectors_sql('pv', 'pq', 'query_id')},
near AS (SELECT query_id, chunk_id, round(sum(pv.v * bv.v), 6) AS score FROM pv JOIN bv USING (b) GROUP BY query_id, chunk_id),
best AS (SELECT query_id, max(score) AS best FROM near GROUP BY query_id)"""


@query(
    "moderate_pairs_domain",
    f"""WITH bench_ AS (SELECT item_id AS chunk_id, text FROM benchmark), {_DOMAIN_SQL},
{pair_gate_sql(f"(SELECT best FROM best WHERE best.query_id = p.conv_id || '-' || p.turn) < {DOMAIN_THRESHOLD}")}
SELECT conv_id, turn, stage FROM verdicts""",
)
def moderate_pairs_domain(spark, sf):
    """Guardrail with the relevance check against ``benchmark`` as knowledge base."""
    rows = pairs(spark, sf)
    asked = EMBEDDER.attach(
        rows.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("user_message").alias("text")),
        "text", "vector",
    )
    corpus = EMBEDDER.attach(table(spark, sf, "benchmark"), "text", "vector")
    corpus = corpus.select(F.col("item_id").alias("chunk_id"), "vector")
    relevant = R.relevance_gate(asked, corpus, DOMAIN_THRESHOLD).select(
        F.split_part("query_id", F.lit("-"), F.lit(1)).cast("bigint").alias("conv_id"),
        F.split_part("query_id", F.lit("-"), F.lit(2)).cast("bigint").alias("turn"),
        "is_relevant",
    )
    judged = gates.moderate_pairs(
        rows, ["conv_id", "turn"], "user_message", "assistant_response", fx.CHAT_GUARDRAIL, fx.CHAT_SCORER,
        relevance=relevant,
    )
    return judged.select("conv_id", "turn", "stage")


BENCH_SERVICE = gates.ServiceLists(high=["hein", "lyoren"], secondary=["whesou"])

_BENCH_GATE_SQL = f"""{_RESULT_SQL.replace(ranked_sql('bm', 3), 'SELECT * FROM hy').replace(BM25_SQL, HYBRID_SQL)},
{q.sentence_ctes('benchmark', 'item_id', 'text', fx.CHAT_LEXICON)}, {q.flags_cte('f', 'service', 'benchmark', 'item_id')},
bg AS (SELECT b.item_id, b.text, CASE WHEN {q.any_of(q.noise_match('b.text', w) for w in BENCH_SERVICE.high)} THEN 'high_keyword'
 WHEN f.flag = 0 THEN 'sentence_model' WHEN f.flag = 2 AND {q.noise_match('b.text', BENCH_SERVICE.secondary[0])} THEN 'secondary_keyword'
 WHEN f.flag = 2 THEN 'passed_grey' ELSE 'passed' END AS stage FROM benchmark b JOIN f USING (item_id))"""


@query(
    "front_gate_with_context",
    f"""WITH {_BENCH_GATE_SQL} SELECT item_id, stage, stage IN ('passed', 'passed_grey') AND context IS NOT NULL AS rag_used,
 CASE WHEN stage IN ('passed', 'passed_grey') THEN context END AS rag_context FROM bg LEFT JOIN rt ON rt.query_id = bg.item_id""",
)
def front_gate_with_context(spark, sf):
    prompts = table(spark, sf, "benchmark").select("item_id", "text")
    return gates.front_gate_with_context(
        prompts, "item_id", "text", BENCH_SERVICE, fx.CHAT_SCORER, EMBEDDER, chunks(spark, sf), params=SERVICE_RETRIEVAL
    ).select("item_id", "stage", "rag_used", "rag_context")


@query(
    "context_applied",
    f"""WITH {_RESULT_SQL}, b AS (SELECT item_id AS query_id, text, item_id % 2 = 0 AS ctx FROM benchmark)
SELECT b.query_id, CASE WHEN rt.context IS NULL THEN 'user:earlier|user:' || b.text
 ELSE CASE WHEN ctx THEN 'user:earlier' ELSE 'system:{M.DEFAULT_SAFE_SYSTEM}' END || '|user:' || rt.context END AS sent FROM b LEFT JOIN rt USING (query_id)""",
)
def context_applied(spark, sf):
    """Retrieved text put into the messages: in place of the last one, or as a new pair."""
    rows = queries(spark, sf).join(result_text(spark, sf), "query_id", "left")
    earlier = F.array(M.message("user", F.lit("earlier")), M.message("user", F.col("text")))
    sent = M.apply_context_prompt(earlier, F.col("context"), F.col("query_id") % 2 == 0)
    said = F.transform(sent, lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return rows.select("query_id", F.array_join(said, "|").alias("sent"))
