"""The staged gates over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog import fixtures as fx
from wardline.catalog import sqltext as q
from wardline.catalog.chats import PAIRS_SQL, TURNS_SQL, pairs, turns
from wardline.catalog.registry import query, table
from wardline.config import STANDARD_REFUSAL
from wardline.functions import messages as M
from wardline.operators import keys as K
from wardline.operators import quality as Q
from wardline.plans import chat, gates

DOC_GATE_SQL = f"""{q.sentence_ctes('documents', 'doc_id', q.strip('text'), fx.DOC_LEXICON)},
{q.flags_cte('f', 'service', 'documents', 'doc_id')},
gate AS (SELECT d.doc_id, d.lang,
 CASE WHEN length({q.strip('d.text')}) = 0 THEN 'input'
      WHEN {q.any_of(q.noise_match('d.text', w) for w in fx.DOC_HIGH)} THEN 'high_keyword'
      WHEN f.flag = 0 THEN 'sentence_model'
      WHEN f.flag = 2 AND {q.any_of(q.noise_match('d.text', w) for w in fx.BLACKLIST_WORDS)} THEN 'secondary_keyword'
      WHEN f.flag = 2 THEN 'passed_grey' ELSE 'passed' END AS stage, f.flag AS raw_flag
 FROM documents d JOIN f ON f.doc_id = d.doc_id)"""


def _doc_gate(spark, sf, detail=False):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return gates.front_gate(docs, ["doc_id"], "text", fx.DOC_SERVICE, fx.DOC_SCORER, detail=detail)


@query(
    "front_gate_counts",
    f"""WITH {DOC_GATE_SQL} SELECT lang, stage, stage IN ('passed', 'passed_grey') AS is_safe, count(*) AS documents
FROM gate GROUP BY lang, stage""",
)
def front_gate_counts(spark, sf):
    return _doc_gate(spark, sf).groupBy("lang", "stage", "is_safe").agg(F.count("*").alias("documents"))


@query(
    "front_gate",
    f"""WITH {DOC_GATE_SQL} SELECT doc_id, stage, stage IN ('passed', 'passed_grey') AS is_safe,
 CASE WHEN stage = 'high_keyword' THEN NULL ELSE raw_flag END AS flag FROM gate""",
)
def front_gate(spark, sf):
    return _doc_gate(spark, sf).select("doc_id", "stage", "is_safe", F.col("flag").cast("int").alias("flag"))


@query(
    "front_gate_detail",
    f"""WITH {DOC_GATE_SQL}, m AS ({' UNION ALL '.join(
        f"SELECT doc_id, '{w}' AS k, {w in fx.DOC_HIGH} AS high FROM documents WHERE {q.noise_match('text', w)}"
        for w in sorted(set(fx.DOC_HIGH) | set(fx.BLACKLIST_WORDS)))}),
bad AS (SELECT doc_id, string_agg(sentence, '|' ORDER BY pos) AS bad FROM sent WHERE {q.STATE['service']} = 0 GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT sentence) AS n FROM sent GROUP BY doc_id)
SELECT g.doc_id, g.stage,
 coalesce(CASE WHEN stage = 'high_keyword' THEN (SELECT string_agg(k, ',' ORDER BY k) FROM m WHERE m.doc_id = g.doc_id AND high)
  WHEN stage IN ('secondary_keyword') THEN (SELECT string_agg(k, ',' ORDER BY k) FROM m WHERE m.doc_id = g.doc_id) END, '') AS matched,
 CASE WHEN stage = 'high_keyword' THEN '' ELSE coalesce(bad.bad, '') END AS bad,
 CASE WHEN stage = 'high_keyword' THEN 0 ELSE coalesce(n.n, 0) END AS scored_sentences
FROM gate g LEFT JOIN bad ON bad.doc_id = g.doc_id LEFT JOIN n ON n.doc_id = g.doc_id""",
)
def front_gate_detail(spark, sf):
    return _doc_gate(spark, sf, detail=True).select(
        "doc_id",
        "stage",
        F.array_join("matched_keywords", ",").alias("matched"),
        F.array_join(F.transform("bad_sentences", lambda x: x["sentence"]), "|").alias("bad"),
        F.size("sentence_scores").cast("bigint").alias("scored_sentences"),
    )


@query(
    "gate_vs_labels",
    f"""WITH {DOC_GATE_SQL} SELECT l.toxic, count(*) AS documents,
 count(*) FILTER (g.stage NOT IN ('passed', 'passed_grey')) AS blocked FROM labels l JOIN gate g USING (doc_id) GROUP BY l.toxic""",
)
def gate_vs_labels(spark, sf):
    verdicts = _doc_gate(spark, sf).select("doc_id", "is_safe")
    return (
        table(spark, sf, "labels").select("doc_id", "toxic").join(verdicts, "doc_id").groupBy("toxic")
        .agg(F.count("*").alias("documents"), F.count_if(~F.col("is_safe")).alias("blocked"))
    )


_ANSWERS = "answers AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')"
POST_SQL = f"""{_ANSWERS}, {q.sentence_ctes('answers', 'conv_id, turn', 'text', fx.CHAT_LEXICON)},
bad AS (SELECT conv_id, turn, string_agg(sentence, '|' ORDER BY pos) AS bad FROM sent
 WHERE label = 'LABEL_0' AND score >= 0.5 GROUP BY conv_id, turn)"""


@query(
    "post_gate",
    f"""WITH {POST_SQL} SELECT a.conv_id, a.turn, bad.bad IS NULL AS is_safe FROM answers a
 LEFT JOIN bad ON bad.conv_id = a.conv_id AND bad.turn = a.turn""",
)
def post_gate(spark, sf):
    answers = table(spark, sf, "conversations").where("role = 'assistant'")
    gated = gates.post_gate(answers, ["conv_id", "turn"], "text", fx.CHAT_SCORER)
    return gated.select("conv_id", "turn", "is_safe")


@query(
    "post_gate_detail",
    f"""WITH {POST_SQL}, m AS (SELECT conv_id, turn, sentence, arg_max(score, pos) AS score FROM sent GROUP BY ALL)
SELECT a.conv_id, a.turn, bad.bad IS NULL AS is_safe, coalesce(bad.bad, '') AS bad,
 coalesce((SELECT CAST(sum(round(round(score, 2) * 100)) AS BIGINT) FROM m WHERE m.conv_id = a.conv_id AND m.turn = a.turn), 0) AS score_cents
FROM answers a LEFT JOIN bad ON bad.conv_id = a.conv_id AND bad.turn = a.turn""",
)
def post_gate_detail(spark, sf):
    answers = table(spark, sf, "conversations").where("role = 'assistant'")
    gated = gates.post_gate(answers, ["conv_id", "turn"], "text", fx.CHAT_SCORER, detail=True)
    cents = F.aggregate(
        "sentence_scores", F.lit(0).cast("bigint"), lambda a, x: a + F.round(x["score"] * 100).cast("bigint")
    )
    return gated.select(
        "conv_id", "turn", "is_safe",
        F.array_join(F.transform("bad_sentences", lambda x: x["sentence"]), "|").alias("bad"),
        cents.alias("score_cents"),
    )


def pair_gate_sql(out_of_domain: str = "FALSE") -> str:
    return f"""{q.sentence_ctes('pairs', 'conv_id, turn', 'user_message', fx.CHAT_LEXICON)},
{q.flags_cte('f', 'guardrail', 'pairs', 'conv_id, turn')},
{q.window_ctes('pairs', 'conv_id, turn', 'assistant_response', fx.CHAT_LEXICON)},
badw AS (SELECT DISTINCT conv_id, turn FROM win WHERE p >= 0.5),
verdicts AS (SELECT p.conv_id, p.turn, f.flag,
 CASE WHEN {q.any_of(q.word_match('p.user_message', w) for w in fx.CHAT_HIGH)} THEN 'severe_keyword'
  WHEN f.flag = 0 THEN 'sentence_model'
  WHEN f.flag = 2 AND {q.any_of(q.word_match('p.user_message', w) for w in fx.CHAT_SECONDARY)} THEN 'moderate_keyword'
  WHEN f.flag = 2 AND {out_of_domain} THEN 'out_of_domain'
  WHEN b.conv_id IS NOT NULL THEN 'answer_audit' ELSE 'passed' END AS stage
 FROM pairs p JOIN f ON f.conv_id = p.conv_id AND f.turn = p.turn
 LEFT JOIN badw b ON b.conv_id = p.conv_id AND b.turn = p.turn)"""


@query(
    "moderate_pairs",
    f"""WITH {PAIRS_SQL}, {pair_gate_sql()}
SELECT conv_id, turn, stage, CASE WHEN stage = 'passed' THEN 'safe' ELSE 'unsafe' END AS verdict,
 CASE WHEN stage = 'severe_keyword' THEN NULL ELSE flag END AS flag FROM verdicts""",
)
def moderate_pairs(spark, sf):
    judged = gates.moderate_pairs(
        pairs(spark, sf), ["conv_id", "turn"], "user_message", "assistant_response", fx.CHAT_GUARDRAIL, fx.CHAT_SCORER
    )
    return judged.select("conv_id", "turn", "stage", "verdict", F.col("flag").cast("int").alias("flag"))


# ---------------------------------------------------------------- the request path


def chat_requests(spark, sf):
    """Every answered user message as a chat request; users, keys and context switches vary."""
    t, n = turns(spark, sf), F.col("session_id")
    return t.select(
        "request_id",
        "ts",
        F.concat(F.lit("key-"), (n % 5).cast("string")).alias("api_key"),
        F.lit("chat").alias("model"),
        F.when(n % 10 == 5, F.lit("")).otherwise(F.col("user_id")).alias("user_id"),
        F.lit(None).cast("string").alias("user"),
        n.cast("string").alias("session_id"),
        (n % 3 != 0).alias("enable_context"),
        F.lit(2).alias("max_context_turns"),
        F.when(n % 11 == 10, 2.5).otherwise(0.7).alias("temperature"),
        F.array(M.message("user", F.col("user_message"))).alias("messages"),
    )


def chat_responses(spark, sf):
    return turns(spark, sf).select(
        "request_id",
        F.col("assistant_response").alias("response_content"),
        "tokens_used",
        F.lit("stop").alias("finish_reason"),
        (F.length("assistant_response") / 100.0).alias("response_time"),
    )


def chat_registry(spark, sf):
    return chat_requests(spark, sf).groupBy(F.col("api_key").alias("key")).agg(
        (F.max("api_key") != "key-3").alias("enabled")
    )


def run_chat(spark, sf):
    return chat.moderate_chat(
        chat_requests(spark, sf), chat_responses(spark, sf), fx.CHAT_SERVICE, fx.CHAT_SCORER,
        registry=chat_registry(spark, sf),
    )


_NOISY_HIGH = q.any_of(q.noise_match("t.user_message", w) for w in fx.CHAT_HIGH)
_NOISY_SECOND = q.any_of(q.noise_match("t.user_message", w) for w in fx.CHAT_SECONDARY)
CHAT_SQL = f"""{TURNS_SQL}, tq AS (SELECT *, 1 AS one FROM turns),
{q.sentence_ctes('tq', 'request_id', 'user_message', fx.CHAT_LEXICON)},
{q.flags_cte('f', 'service', 'tq', 'request_id')},
{q.sentence_ctes('tq', 'request_id', 'assistant_response', fx.CHAT_LEXICON).replace('sent', 'ans')},
bad AS (SELECT DISTINCT request_id FROM ans WHERE label = 'LABEL_0' AND score >= 0.5),
v AS (SELECT t.session_id, t.ts, t.request_id, t.user_message, t.assistant_response, t.tokens_used,
 CASE WHEN t.session_id % 10 = 5 THEN 'anonymous' ELSE t.user_id END AS who, t.session_id % 3 <> 0 AS ctx,
 CASE WHEN {_NOISY_HIGH} THEN 'high_keyword' WHEN f.flag = 0 THEN 'sentence_model'
  WHEN f.flag = 2 AND {_NOISY_SECOND} THEN 'secondary_keyword' WHEN f.flag = 2 THEN 'passed_grey' ELSE 'passed' END AS front_stage,
 b.request_id IS NOT NULL AS bad_answer
 FROM turns t JOIN f USING (request_id) LEFT JOIN bad b ON b.request_id = t.request_id WHERE t.session_id % 11 <> 10 AND t.session_id % 5 <> 3),
w AS (SELECT *, front_stage IN ('passed', 'passed_grey') AS front_ok FROM v),
rec AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, request_id) AS rn FROM w WHERE front_ok AND NOT bad_answer AND ctx AND who <> 'anonymous'),
cx AS (SELECT w.request_id, least(2, count(r.rn)) AS n FROM w LEFT JOIN rec r ON r.session_id = w.session_id AND (r.ts, r.request_id) < (w.ts, w.request_id)
 AND w.front_ok AND w.ctx AND w.who <> 'anonymous' GROUP BY w.request_id),
chat_log AS (SELECT w.*, 2 * cx.n AS context_messages, CASE WHEN NOT front_ok OR bad_answer THEN 'content_filter' ELSE 'stop' END AS finish_reason,
 CASE WHEN NOT front_ok THEN 'front' WHEN bad_answer THEN 'post' ELSE 'answered' END AS stage FROM w JOIN cx USING (request_id))"""


@query(
    "moderate_chat",
    f"""WITH {CHAT_SQL} SELECT request_id, who AS user_id, front_stage, finish_reason, stage = 'answered' AS answered,
 CASE WHEN front_ok THEN tokens_used ELSE length('{STANDARD_REFUSAL}') END AS tokens_used, context_messages, ctx AND context_messages > 0 AS with_context FROM chat_log""",
)
def moderate_chat(spark, sf):
    return run_chat(spark, sf).log.select(
        "request_id", "user_id", "front_stage", "finish_reason", F.col("error").isNull().alias("answered"),
        "tokens_used", "context_messages", "with_context",
    )


@query(
    "chat_turns",
    f"WITH {CHAT_SQL} SELECT request_id, CAST(session_id AS VARCHAR) AS session_id, who AS user_id, tokens_used FROM rec",
)
def chat_turns(spark, sf):
    return run_chat(spark, sf).turns.select("request_id", "session_id", "user_id", "tokens_used")


@query(
    "chat_sent_messages",
    f"""WITH {CHAT_SQL}, pr AS (SELECT w.request_id, r.user_message AS um, r.assistant_response AS am, r.rn,
 row_number() OVER (PARTITION BY w.request_id ORDER BY r.rn DESC) AS back FROM w JOIN rec r ON r.session_id = w.session_id AND (r.ts, r.request_id) < (w.ts, w.request_id)
 WHERE w.front_ok AND w.ctx AND w.who <> 'anonymous')
SELECT w.request_id, coalesce(string_agg('user:' || um || '|assistant:' || am, '|' ORDER BY rn) || '|', '') || 'user:' || any_value(w.user_message) AS sent
FROM w LEFT JOIN pr ON pr.request_id = w.request_id AND back <= 2 WHERE w.front_ok GROUP BY w.request_id""",
)
def chat_sent_messages(spark, sf):
    sent = run_chat(spark, sf).log.where(F.col("sent_messages").isNotNull())
    said = F.transform("sent_messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return sent.select("request_id", F.array_join(said, "|").alias("sent"))


@query(
    "chat_rejected",
    f"""WITH {TURNS_SQL} SELECT CASE WHEN session_id % 11 = 10 THEN 'temperature' ELSE 'api_key disabled' END AS reason, count(*) AS requests
FROM turns WHERE session_id % 11 = 10 OR session_id % 5 = 3 GROUP BY 1""",
)
def chat_rejected(spark, sf):
    return run_chat(spark, sf).rejected.groupBy("reason").agg(F.count("*").alias("requests"))


@query("outcome_counts", f"WITH {CHAT_SQL} SELECT stage, finish_reason, count(*) AS requests FROM chat_log GROUP BY ALL")
def outcome_counts(spark, sf):
    return K.outcome_counts(run_chat(spark, sf).log)


@query(
    "safety_replies",
    f"""WITH {CHAT_SQL} SELECT request_id, CASE WHEN stage = 'answered' THEN assistant_response ELSE
 '{STANDARD_REFUSAL}' END AS content, finish_reason FROM chat_log""",
)
def safety_replies(spark, sf):
    return run_chat(spark, sf).replies


# ---------------------------------------------------------------- validation and quality


def event_requests(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id",
        (F.col("value") / 10).alias("temperature"),
        (k / 80.0).alias("top_p"),
        (k - 3).alias("max_tokens"),
        (k / 20.0 - 2.5).alias("presence_penalty"),
        (F.col("value") / 8 - 3).alias("frequency_penalty"),
        (k % 25).alias("max_context_turns"),
        F.when(F.col("event_type") != "click", F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_type").isin("click", "view").alias("enable_context"),
    )


@query(
    "request_validation",
    """WITH r AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, concat_ws(',', CASE WHEN value / 10 < 0 OR value / 10 > 2 THEN 'temperature' END,
 CASE WHEN k / 80.0::DOUBLE < 0 OR k / 80.0::DOUBLE > 1 THEN 'top_p' END, CASE WHEN k - 3 < 1 THEN 'max_tokens' END,
 CASE WHEN k / 20.0::DOUBLE - 2.5::DOUBLE < -2 OR k / 20.0::DOUBLE - 2.5::DOUBLE > 2 THEN 'presence_penalty' END,
 CASE WHEN value / 8 - 3 < -2 OR value / 8 - 3 > 2 THEN 'frequency_penalty' END,
 CASE WHEN k % 25 < 1 OR k % 25 > 20 THEN 'max_context_turns' END,
 CASE WHEN event_type = 'click' THEN 'session_id' END) AS violations FROM r""",
)
def request_validation(spark, sf):
    r = event_requests(spark, sf)
    return r.select("event_id", F.array_join(Q.violations(columns=r.columns), ",").alias("violations"))


def _checks(spark, sf):
    docs = table(spark, sf, "documents")
    events = table(spark, sf, "events")
    users = events.select(F.col("user_id").cast("string").alias("key"))
    return Q.all_checks(
        Q.check(docs, "documents_blank", F.length(F.trim("text")) == 0),
        Q.check(docs, "documents_length", F.length("text") != F.col("n_chars")),
        Q.duplicates(docs.select(F.md5("text").alias("digest")), ["digest"], "documents_repeated"),
        Q.check(users, "users_blank", F.length("key") == 0),
        Q.check(events, "events_errors", F.col("event_type") == "error", "warning"),
        Q.check(events.join(docs.select(F.col("doc_id").alias("event_id")), "event_id", "left_anti"), "events_orphans", None),
    )


_CHECKS_SQL = """c AS (SELECT 'documents_blank' AS name, count(*) AS n_rows, count(*) FILTER (length(trim(text)) = 0) AS n_bad, 'error' AS sev FROM documents
UNION ALL SELECT 'documents_length', count(*), count(*) FILTER (length(text) <> n_chars), 'error' FROM documents
UNION ALL SELECT 'documents_repeated', count(*), count(*) FILTER (n > 1), 'warning' FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)
UNION ALL SELECT 'users_blank', count(*), 0, 'error' FROM events
UNION ALL SELECT 'events_errors', count(*), count(*) FILTER (event_type = 'error'), 'warning' FROM events
UNION ALL SELECT 'events_orphans', count(*), 0, 'error' FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents)),
s AS (SELECT name, n_rows, n_bad, CASE WHEN n_bad > 0 THEN sev WHEN n_rows = 0 THEN 'warning' ELSE 'pass' END AS status FROM c)"""


@query("quality_checks", f"WITH {_CHECKS_SQL} SELECT * FROM s")
def quality_checks(spark, sf):
    return _checks(spark, sf)


@query(
    "quality_summary",
    f"""WITH {_CHECKS_SQL} SELECT count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'warning') AS n_warning,
 count(*) FILTER (status = 'error') AS n_error, CASE max(CASE status WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'pass' END AS overall FROM s""",
)
def quality_summary(spark, sf):
    return Q.quality_summary(_checks(spark, sf))
