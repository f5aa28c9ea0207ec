"""Keyword, sentence and window operators over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog import fixtures as fx
from wardline.catalog import sqltext as q
from wardline.catalog.registry import query, table
from wardline.config import GUARDRAIL, PAPER, SERVICE
from wardline.functions import text as T
from wardline.functions.patterns import keyword_pattern
from wardline.functions.rows import explode_positions, explode_structs, explode_values
from wardline.operators import keywords as kw
from wardline.operators import moderation as mod

ID = ["doc_id"]


def _docs(spark, sf, *cols):
    return table(spark, sf, "documents").select("doc_id", *(cols or ("text",)))


def _hits_sql(words, match, name="keyword"):
    return "\nUNION ALL ".join(
        f"SELECT doc_id, '{w}' AS {name} FROM documents WHERE {match('text', w)}" for w in words
    )


# ---------------------------------------------------------------- keywords


@query("keyword_hits", _hits_sql(fx.SEVERE + ["trash idiot"], q.word_match))
def keyword_hits(spark, sf):
    words = kw.keyword_frame(spark, fx.SEVERE + ["trash idiot"])
    return kw.keyword_hits(_docs(spark, sf), words.select("keyword"), ID)


@query("keyword_hits_ci", _hits_sql(fx.MODERATE, q.noise_match))
def keyword_hits_ci(spark, sf):
    words = kw.keyword_frame(spark, fx.MODERATE)
    return kw.keyword_hits(_docs(spark, sf), words.select("keyword"), ID, "text", "characters", True)


@query(
    "keyword_sets",
    "SELECT doc_id, string_agg(keyword, ',' ORDER BY keyword) AS matched, count(*) AS n FROM ("
    + _hits_sql(fx.SEVERE, q.word_match) + ") GROUP BY doc_id",
)
def keyword_sets(spark, sf):
    m = kw.attach_keywords(_docs(spark, sf), fx.SEVERE, ID, "text", "m").where(F.size("m") > 0)
    return m.select("doc_id", F.array_join("m", ",").alias("matched"), F.size("m").cast("bigint").alias("n"))


@query(
    "category_hits",
    "\nUNION ALL ".join(
        f"SELECT doc_id, '{c}' AS category FROM documents WHERE "
        + q.any_of(q.noise_match("text", w) for w in subs)
        for c, subs in fx.BLACKLIST.items()
    ),
)
def category_hits(spark, sf):
    rows = [(c, w) for c, subs in fx.BLACKLIST.items() for w in subs]
    blacklist = spark.createDataFrame(rows, "category string, sub_keyword string")
    return kw.category_hits(_docs(spark, sf), blacklist, ID)


@query(
    "category_sets",
    "SELECT doc_id, string_agg(category, ',' ORDER BY category) AS categories FROM ("
    + "\nUNION ALL ".join(
        f"SELECT doc_id, '{c}' AS category FROM documents WHERE "
        + q.any_of(q.noise_match("text", w) for w in subs)
        for c, subs in fx.BLACKLIST.items()
    )
    + ") GROUP BY doc_id",
)
def category_sets(spark, sf):
    m = _docs(spark, sf).withColumn("c", kw.matched_categories_column(F.col("text"), fx.BLACKLIST))
    return m.where(F.size("c") > 0).select("doc_id", F.array_join("c", ",").alias("categories"))


def _benchmark_words(spark, sf):
    """A keyword table that grows with the data: the distinct words of ``benchmark``."""
    return explode_values(table(spark, sf, "benchmark"), [], T.tokens(F.col("text")), "keyword").distinct()


_WORDS_SQL = f"SELECT DISTINCT keyword FROM (SELECT unnest({q.tokens('text')}) AS keyword FROM benchmark)"
_TABLE_HITS_SQL = f"""WITH k AS ({_WORDS_SQL}), t AS (SELECT doc_id, unnest(list_distinct({q.tokens('text')})) AS keyword FROM documents)
SELECT t.doc_id, t.keyword FROM t JOIN k USING (keyword)"""


@query("keyword_table_hits", _TABLE_HITS_SQL)
def keyword_table_hits(spark, sf):
    return kw.keyword_hits(_docs(spark, sf), _benchmark_words(spark, sf), ID)


@query("keyword_table_hits_anchors", _TABLE_HITS_SQL)
def keyword_table_hits_anchors(spark, sf):
    """The same by anchors, the keyword table broadcast."""
    return kw.keyword_hits(_docs(spark, sf), _benchmark_words(spark, sf), ID, use_automaton=False)


@query("keyword_table_hits_joined", _TABLE_HITS_SQL)
def keyword_table_hits_joined(spark, sf):
    """The same by anchors, as a list too long to broadcast is joined."""
    return kw.keyword_hits(_docs(spark, sf), _benchmark_words(spark, sf), ID, broadcast_rows=0, use_automaton=False)


@query(
    "keyword_table_noise_counts",
    f"""WITH k AS ({_WORDS_SQL}),
f AS (SELECT doc_id, lower(regexp_replace(text, '{q.OTHER}+', '', 'g')) AS folded FROM documents)
SELECT k.keyword, count(*) AS documents FROM k JOIN f ON contains(f.folded, lower(k.keyword)) GROUP BY k.keyword""",
)
def keyword_table_noise_counts(spark, sf):
    hits = kw.keyword_hits(_docs(spark, sf), _benchmark_words(spark, sf), ID, "text", "characters", True)
    return hits.groupBy("keyword").agg(F.count("*").alias("documents"))


@query(
    "keyword_patterns",
    f"""WITH k AS ({_WORDS_SQL})
SELECT keyword, '(?<!{q.WORD})' || keyword || '(?!{q.WORD})' AS word_pattern,
 '(?iu)' || array_to_string(list_filter(string_split(keyword, ''), lambda c: c <> ''), '{q.OTHER}*') AS noise_pattern FROM k""",
)
def keyword_patterns(spark, sf):
    k = F.col("keyword")
    return _benchmark_words(spark, sf).select(
        "keyword",
        keyword_pattern(k, "auto").alias("word_pattern"),
        keyword_pattern(k, "characters", True).alias("noise_pattern"),
    )


@query(
    "cjk_flags",
    "SELECT doc_id, regexp_matches(text, '[一-鿿]') AS has_cjk, "
    "length(translate(text, '*#', '')) AS clean_length FROM documents",
)
def cjk_flags(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id", T.has_cjk(t).alias("has_cjk"), F.length(T.drop_noise(t)).cast("bigint").alias("clean_length")
    )


# ---------------------------------------------------------------- sentences

_SENT = q.sentence_ctes("documents", "doc_id", "text", fx.DOC_LEXICON)


def _judged(spark, sf, thresholds=GUARDRAIL):
    return mod.attach_sentences(_docs(spark, sf), ID, "text", fx.DOC_SCORER, thresholds).select("doc_id", "judged")


@query(
    "sentence_split",
    f"WITH {_SENT} SELECT doc_id, pos, sentence FROM sent",
)
def sentence_split(spark, sf):
    return explode_positions(_docs(spark, sf), ID, T.sentences(F.col("text")), "pos", "sentence")


@query(
    "sentence_scores",
    f"WITH {_SENT} SELECT doc_id, pos, label, round(score, 6) AS score, round(p, 6) AS p FROM sent",
)
def sentence_scores(spark, sf):
    rows = mod.sentence_rows(_judged(spark, sf), ID)
    return rows.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "label",
        F.round("score", 6).alias("score"), F.round("p", 6).alias("p"),
    )


def _tri_state_sql(rule):
    return f"""WITH {_SENT}
SELECT doc_id, pos, {q.STATE[rule]} AS state FROM sent"""


def _tri_state(spark, sf, thresholds):
    rows = mod.sentence_rows(_judged(spark, sf, thresholds), ID)
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("state").cast("int").alias("state"))


for _name, _t in (("guardrail", GUARDRAIL), ("service", SERVICE), ("paper", PAPER)):
    query(f"tri_state_{_name}", _tri_state_sql(_name))(lambda spark, sf, t=_t: _tri_state(spark, sf, t))


def _flags_sql(rule):
    return f"""WITH {_SENT}, {q.flags_cte('f', rule, 'documents', 'doc_id')}
SELECT doc_id, flag, CASE flag WHEN 0 THEN 'UNSAFE' WHEN 2 THEN 'UNCERTAIN' ELSE 'SAFE' END AS level FROM f"""


def _flags(spark, sf, thresholds):
    flag = mod.judged_flag(F.col("judged"))
    return _judged(spark, sf, thresholds).select(
        "doc_id", flag.cast("int").alias("flag"), mod.flag_name(flag).alias("level")
    )


for _name, _t in (("guardrail", GUARDRAIL), ("service", SERVICE), ("paper", PAPER)):
    query(f"text_flags_{_name}", _flags_sql(_name))(lambda spark, sf, t=_t: _flags(spark, sf, t))


@query(
    "signed_scores",
    f"""WITH {_SENT}
SELECT doc_id, bool_or(label = 'LABEL_0') AS blocked,
 round(sum(CASE WHEN label = 'LABEL_1' THEN score ELSE -score END), 4) AS signed_sum,
 round(min(CASE WHEN label = 'LABEL_1' THEN score ELSE -score END), 6) AS lowest FROM sent GROUP BY doc_id""",
)
def signed_scores(spark, sf):
    s = F.transform("judged", lambda x: mod.signed_score(x["label"], x["score"]))
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    return _judged(spark, sf).where(F.size("judged") > 0).select(
        "doc_id",
        F.exists("judged", lambda x: x["label"] == "LABEL_0").alias("blocked"),
        F.round(total, 4).alias("signed_sum"),
        F.round(F.array_min(s), 6).alias("lowest"),
    )


@query(
    "bad_sentences",
    f"""WITH {_SENT}
SELECT doc_id, string_agg(sentence, '|' ORDER BY pos) AS sentences,
 string_agg(CAST(CAST(round(p * 1000000) AS BIGINT) AS VARCHAR), '|' ORDER BY pos) AS micro_p
FROM sent WHERE {q.STATE['guardrail']} = 0 GROUP BY doc_id""",
)
def bad_sentences(spark, sf):
    bad = _judged(spark, sf).select("doc_id", mod.bad_sentences(F.col("judged")).alias("bad")).where(F.size("bad") > 0)
    return bad.select(
        "doc_id",
        F.array_join(F.transform("bad", lambda x: x["sentence"]), "|").alias("sentences"),
        F.array_join(
            F.transform("bad", lambda x: F.round(x["p"] * 1000000).cast("bigint").cast("string")), "|"
        ).alias("micro_p"),
    )


@query(
    "max_pool",
    f"WITH {_SENT} SELECT doc_id, round(max(p), 6) AS risk FROM sent GROUP BY doc_id",
)
def max_pool(spark, sf):
    worst = F.array_max(F.transform("judged", lambda x: x["p"]))
    return _judged(spark, sf).select("doc_id", F.round(worst, 6).alias("risk")).where("risk is not null")


@query(
    "sentence_score_map",
    f"WITH {_SENT} SELECT doc_id, sentence, round(arg_max(p, pos), 2) AS score FROM sent GROUP BY doc_id, sentence",
)
def sentence_score_map(spark, sf):
    scored = mod.attach_sentence_scores(_judged(spark, sf), "judged", "scores")
    return explode_structs(scored, ID, "scores", "sentence")


@query(
    "post_sentence_audit",
    f"""WITH {_SENT}
SELECT d.doc_id, count(s.pos) = 0 AS is_safe, count(s.pos) AS bad FROM documents d
LEFT JOIN (SELECT * FROM sent WHERE label = 'LABEL_0' AND score >= 0.5) s USING (doc_id) GROUP BY d.doc_id""",
)
def post_sentence_audit(spark, sf):
    return _judged(spark, sf).select(
        "doc_id",
        mod.post_flag(F.col("judged")).alias("is_safe"),
        F.size(mod.post_bad_sentences(F.col("judged"))).cast("bigint").alias("bad"),
    )


# ---------------------------------------------------------------- windows

_WIN = q.window_ctes("documents", "doc_id", "text", fx.DOC_LEXICON)


@query(
    "answer_windows",
    f"""WITH {_WIN}
SELECT doc_id, window_no, start, least(510, n - start) AS n_tokens FROM
 (SELECT doc_id, n, window_no, window_no * 256 AS start FROM win2)""",
)
def answer_windows(spark, sf):
    n = _docs(spark, sf).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"))
    rows = explode_positions(n, ["doc_id", "n"], T.window_starts(F.col("n")), "window_no", "start")
    return rows.select(
        "doc_id",
        "window_no",
        F.col("start").cast("bigint").alias("start"),
        F.least(F.lit(510), F.col("n") - F.col("start")).cast("bigint").alias("n_tokens"),
    )


def _windows(spark, sf):
    return mod.attach_window_scores(_docs(spark, sf), ID, "text", fx.DOC_SCORER, every_score=False)


@query(
    "window_audit",
    f"""WITH {_WIN}
SELECT d.doc_id, count(b.window_no) = 0 AS is_safe, round(arg_min(b.p, b.window_no), 6) AS bad_score
FROM documents d LEFT JOIN (SELECT * FROM win WHERE p >= 0.5) b USING (doc_id) GROUP BY d.doc_id""",
)
def window_audit(spark, sf):
    bad = mod.first_bad_window(F.col("windows"))
    return _windows(spark, sf).select(
        "doc_id", bad.isNull().alias("is_safe"), F.round(bad["p"], 6).alias("bad_score")
    )


@query(
    "window_audit_max",
    f"""WITH {_WIN}, stop AS (SELECT doc_id, min(window_no) AS w0 FROM win WHERE p >= 0.5 GROUP BY doc_id),
seen AS (SELECT win.doc_id, max(win.p) AS top FROM win LEFT JOIN stop USING (doc_id)
         WHERE stop.w0 IS NULL OR win.window_no <= stop.w0 GROUP BY win.doc_id)
SELECT d.doc_id, stop.w0 IS NULL AS is_safe, round(coalesce(seen.top, 0.0), 6) AS top_score
FROM documents d LEFT JOIN stop USING (doc_id) LEFT JOIN seen USING (doc_id)""",
)
def window_audit_max(spark, sf):
    return _windows(spark, sf).select(
        "doc_id",
        mod.first_bad_window(F.col("windows")).isNull().alias("is_safe"),
        F.round(mod.highest_until_bad(F.col("windows")), 6).alias("top_score"),
    )


@query(
    "char_windows",
    f"""WITH c AS (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 512.0) AS BIGINT))) AS piece_no FROM documents),
p AS (SELECT doc_id, piece_no, substring(text, piece_no * 512 + 1, 512) AS piece FROM c)
SELECT doc_id, piece_no, length(piece) AS n_chars, {q.p(q.weight('piece', fx.DOC_LEXICON))} >= 0.5 AS bad FROM p""",
)
def char_windows(spark, sf):
    cut = mod.attach_character_windows(_docs(spark, sf), ID, "text", fx.DOC_SCORER)
    return explode_structs(cut, ID, "pieces", "piece_no").select(
        "doc_id",
        F.col("piece_no").cast("bigint").alias("piece_no"),
        F.col("length").cast("bigint").alias("n_chars"),
        (F.col("label") == "LABEL_0").alias("bad"),
    )
