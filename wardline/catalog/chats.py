"""Sessions, users, history and context over ``conversations`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog import sqltext as q
from wardline.catalog.registry import query, table
from wardline.functions import messages as M
from wardline.functions import text as T
from wardline.operators import conversations as conv

PAIRS_SQL = """pairs AS (SELECT u.conv_id, u.turn, u.text AS user_message, a.text AS assistant_response
 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
 WHERE u.role = 'user')"""


def tokens_sql(x: str) -> str:
    words = f"len(regexp_extract_all({x}, '[^\\t-\\r\\x{{1c}}-\\x{{20}}\\x{{85}}\\p{{Z}}]+'))"
    return (
        f"CAST(CASE WHEN regexp_matches({x}, '[一-鿿]') THEN length({x}) "
        f"ELSE floor({words} * 1.3::DOUBLE) END AS BIGINT)"
    )


TURNS_SQL = f"""{PAIRS_SQL}, turns AS (SELECT conv_id AS session_id, 'user-' || ((conv_id + turn) % 20) AS user_id,
 TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts, conv_id || '-' || turn AS request_id,
 user_message, assistant_response, {tokens_sql('assistant_response')} AS tokens_used FROM pairs)"""

SESSIONS_SQL = """first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, request_id) AS rn
 FROM turns) WHERE rn = 1),
sessions AS (SELECT t.session_id, any_value(f.user_id) AS user_id, min(t.ts) AS created_at, max(t.ts) AS last_active,
 count(*) AS total_turns, CAST(sum(t.tokens_used) AS BIGINT) AS total_tokens, least(count(*), 50) AS retained_turns,
 any_value(f.request_id) AS first_request_id
 FROM turns t JOIN first f ON f.session_id = t.session_id GROUP BY t.session_id)"""

USERS_SQL = """owned AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, first_request_id) AS rn FROM sessions),
since AS (SELECT user_id, created_at AS ts, first_request_id AS request_id FROM owned WHERE rn = 1),
counted AS (SELECT t.* FROM turns t JOIN since s ON s.user_id = t.user_id
 WHERE t.ts > s.ts OR (t.ts = s.ts AND t.request_id >= s.request_id)),
tt AS (SELECT user_id, count(*) AS total_turns, CAST(sum(tokens_used) AS BIGINT) AS total_tokens, max(ts) AS last_turn FROM counted GROUP BY user_id),
users AS (SELECT o.user_id, count(*) AS total_sessions, coalesce(any_value(tt.total_turns), 0) AS total_turns,
 coalesce(any_value(tt.total_tokens), 0) AS total_tokens, greatest(max(o.created_at), any_value(tt.last_turn)) AS last_active
 FROM owned o LEFT JOIN tt ON tt.user_id = o.user_id GROUP BY o.user_id)"""


def pairs(spark, sf):
    return conv.turn_pairs(table(spark, sf, "conversations"))


def turns(spark, sf):
    """The turn table derived from ``conversations``; sessions have changing users."""
    minutes = F.col("conv_id") * 60 + F.col("turn")
    return pairs(spark, sf).select(
        F.col("conv_id").alias("session_id"),
        F.concat(F.lit("user-"), ((F.col("conv_id") + F.col("turn")) % 20).cast("string")).alias("user_id"),
        F.timestamp_seconds(F.lit(1704067200) + minutes * 60).alias("ts"),
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        "user_message",
        "assistant_response",
        T.token_estimate(F.col("assistant_response")).alias("tokens_used"),
    )


def event_turns(spark, sf):
    """``events`` as a turn table: one long-running session per user."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("user_message"),
        F.col("props").alias("assistant_response"),
        F.length("props").cast("bigint").alias("tokens_used"),
    )


@query("turn_pairs", f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def turn_pairs(spark, sf):
    return pairs(spark, sf)


@query(
    "token_estimate",
    f"SELECT conv_id, turn, {tokens_sql('text')} AS tokens FROM conversations",
)
def token_estimate(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens")
    )


@query("session_rollup", f"WITH {TURNS_SQL}, {SESSIONS_SQL} SELECT * EXCLUDE (first_request_id) FROM sessions")
def session_rollup(spark, sf):
    return conv.session_rollup(turns(spark, sf)).drop("first_request_id")


@query(
    "session_rollup_with_touches",
    f"""WITH {TURNS_SQL}, touch AS (SELECT conv_id AS session_id, 'user-' || ((conv_id + turn) % 20) AS user_id,
 TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts, conv_id || '-' || turn AS request_id
 FROM conversations WHERE role = 'user'),
al AS (SELECT session_id, user_id, ts, request_id, tokens_used, 1 AS n FROM turns
 UNION ALL SELECT session_id, user_id, ts, request_id, 0, 0 FROM touch)
SELECT session_id, arg_min(user_id, ts) AS user_id, min(ts) AS created_at, max(ts) AS last_active,
 CAST(sum(n) AS BIGINT) AS total_turns, CAST(sum(tokens_used) AS BIGINT) AS total_tokens,
 CAST(least(sum(n), 50) AS BIGINT) AS retained_turns FROM al GROUP BY session_id""",
)
def session_rollup_with_touches(spark, sf):
    """Every user message opens its session, answered or not."""
    minutes = F.col("conv_id") * 60 + F.col("turn")
    touches = table(spark, sf, "conversations").where("role = 'user'").select(
        F.col("conv_id").alias("session_id"),
        F.concat(F.lit("user-"), ((F.col("conv_id") + F.col("turn")) % 20).cast("string")).alias("user_id"),
        F.timestamp_seconds(F.lit(1704067200) + minutes * 60).alias("ts"),
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
    )
    return conv.session_rollup(turns(spark, sf), touches).drop("first_request_id")


@query("user_rollup", f"WITH {TURNS_SQL}, {SESSIONS_SQL}, {USERS_SQL} SELECT * FROM users")
def user_rollup(spark, sf):
    return conv.user_rollup(turns(spark, sf))


@query(
    "user_sessions",
    f"WITH {TURNS_SQL}, {SESSIONS_SQL} SELECT user_id, session_id, created_at FROM sessions",
)
def user_sessions(spark, sf):
    return conv.user_sessions(turns(spark, sf))


@query(
    "retained_turns",
    """SELECT session_id, request_id FROM (SELECT user_id AS session_id, event_id AS request_id,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50""",
)
def retained_turns(spark, sf):
    return conv.retained_turns(event_turns(spark, sf)).select("session_id", "request_id")


@query(
    "history_last_n",
    f"""WITH {TURNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, request_id DESC) AS rn FROM turns)
SELECT session_id, string_agg('user:' || user_message || '|assistant:' || assistant_response, '|' ORDER BY ts, request_id) AS history,
 count(*) * 2 AS n_messages FROM r WHERE rn <= 2 GROUP BY session_id""",
)
def history_last_n(spark, sf):
    h = conv.session_history(turns(spark, sf), 2)
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return h.select(
        "session_id", F.array_join(said, "|").alias("history"), F.size("messages").cast("bigint").alias("n_messages")
    )


@query(
    "history_rows",
    f"""WITH {TURNS_SQL} SELECT session_id, ts, request_id, 0 AS part, 'user' AS role, user_message AS content FROM turns
UNION ALL SELECT session_id, ts, request_id, 1, 'assistant', assistant_response FROM turns""",
)
def history_rows(spark, sf):
    return conv.history_rows(turns(spark, sf), 0)


@query(
    "context_messages",
    f"""WITH {TURNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, request_id) AS rn FROM turns)
SELECT a.session_id, a.request_id, count(b.rn) AS context_turns, count(b.rn) * 2 AS context_messages,
 coalesce(string_agg('user:' || b.user_message || '|assistant:' || b.assistant_response, '|' ORDER BY b.rn) || '|', '')
 || 'user:' || any_value(a.user_message) AS context
FROM r a LEFT JOIN r b ON b.session_id = a.session_id AND b.rn >= a.rn - 2 AND b.rn < a.rn GROUP BY a.session_id, a.request_id""",
)
def context_messages(spark, sf):
    c = conv.with_context(turns(spark, sf), 2)
    said = F.transform("context", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return c.select(
        "session_id", "request_id", "context_turns", "context_messages", F.array_join(said, "|").alias("context")
    )


@query(
    "event_context",
    """SELECT event_id AS request_id, count(*) OVER w AS context_turns,
 coalesce(CAST(sum(length(props)) OVER w AS BIGINT), 0) AS context_chars
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def event_context(spark, sf):
    """Context of long sessions."""
    c = conv.with_context(event_turns(spark, sf), 5)
    answers = F.filter("context", lambda m: m["role"] == "assistant")
    chars = F.aggregate(answers, F.lit(0).cast("bigint"), lambda a, m: a + F.length(m["content"]))
    return c.select("request_id", "context_turns", chars.alias("context_chars"))


_IDLE = "SELECT user_id AS session_id, max(ts) AS last_active FROM events GROUP BY user_id"


@query(
    "expired_sessions",
    f"SELECT * FROM ({_IDLE}) WHERE last_active < TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR",
)
def expired_sessions(spark, sf):
    sessions = conv.session_rollup(event_turns(spark, sf))
    return conv.expired_sessions(sessions, "2024-01-31", 1.5).select("session_id", "last_active")


@query(
    "live_user_sessions",
    f"""WITH {TURNS_SQL}, {SESSIONS_SQL}
SELECT user_id, count(*) AS total_sessions,
 count(*) FILTER (NOT (last_active < TIMESTAMP '2024-01-04')) AS live_sessions FROM sessions GROUP BY user_id""",
)
def live_user_sessions(spark, sf):
    """Active sessions per user after the clean-up, next to the unaffected total."""
    sessions = conv.session_rollup(turns(spark, sf))
    live = conv.live_sessions(sessions, "2024-02-03", 30).groupBy("user_id").agg(F.count("*").alias("live_sessions"))
    total = sessions.groupBy("user_id").agg(F.count("*").alias("total_sessions"))
    return total.join(live, "user_id", "left").withColumn(
        "live_sessions", F.coalesce("live_sessions", F.lit(0)).cast("bigint")
    )


@query(
    "log_with_stats",
    f"""WITH {TURNS_SQL}, {SESSIONS_SQL}, {USERS_SQL}
SELECT t.request_id, coalesce(u.total_turns, 0) AS total_user_turns, coalesce(u.total_tokens, 0) AS total_user_tokens,
 coalesce(u.total_sessions, 0) AS total_user_sessions, coalesce(s.total_turns, 0) AS session_turns,
 coalesce(s.total_tokens, 0) AS session_tokens, s.created_at AS session_created_at
FROM turns t LEFT JOIN users u ON u.user_id = t.user_id LEFT JOIN sessions s ON s.session_id = t.session_id""",
)
def log_with_stats(spark, sf):
    t = turns(spark, sf)
    log = t.select("request_id", "user_id", "session_id")
    return conv.attach_stats(log, conv.user_rollup(t), conv.session_rollup(t)).drop("user_id", "session_id")


@query(
    "user_resolution",
    """SELECT event_id, coalesce(nullif(CASE WHEN event_type = 'click' THEN '' ELSE CAST(user_id AS VARCHAR) END, ''),
 nullif(CASE WHEN user_id % 3 = 0 THEN '' ELSE event_type END, ''), 'anonymous') AS who FROM events""",
)
def user_resolution(spark, sf):
    user_id = F.when(F.col("event_type") == "click", "").otherwise(F.col("user_id").cast("string"))
    user = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", M.request_user(user_id, user).alias("who"))


@query(
    "edge_user_messages",
    f"""WITH {TURNS_SQL} SELECT request_id, user_message AS last_user,
 coalesce(lag(user_message, 2) OVER w, lag(user_message, 1) OVER w, user_message) AS first_user
FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY ts, request_id)""",
)
def edge_user_messages(spark, sf):
    """First and last user message of each request, sent with two turns of context."""
    requests = conv.with_context(turns(spark, sf), 2)
    return requests.select(
        "request_id",
        M.last_user_message(F.col("context")).alias("last_user"),
        M.first_user_message(F.col("context")).alias("first_user"),
    )


@query(
    "message_json",
    """SELECT conv_id, turn, '{"role":"' || role || '","content":' || CAST(to_json(text) AS VARCHAR) || '}' AS line FROM conversations""",
)
def message_json(spark, sf):
    absent = F.lit(None).cast("string").alias("name")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", M.compact_json(F.struct("role", F.col("text").alias("content"), absent)).alias("line")
    )
