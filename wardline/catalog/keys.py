"""Key registry, usage and transcripts, with ``events`` as the stream of key uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.chats import TURNS_SQL, turns
from wardline.catalog.registry import query, table
from wardline.functions.messages import message
from wardline.operators import keys as K

KEYS_SQL = """keys AS (SELECT DISTINCT 'key-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, user_id FROM events),
reg AS (SELECT key, TIMESTAMP '2023-12-31' AS created_at, user_id % 7 <> 0 AS enabled, user_id % 5 AS usage_count FROM keys),
uses AS (SELECT 'key-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, ts FROM events),
usage AS (SELECT r.key, r.enabled, r.usage_count + count(u.ts) AS usage_count, max(u.ts) AS last_used
 FROM reg r LEFT JOIN uses u ON u.key = r.key GROUP BY r.key, r.enabled, r.usage_count)"""


def _key(user="user_id"):
    return F.concat(F.lit("key-"), F.lpad(F.col(user).cast("string"), 6, "0"))


def uses(spark, sf):
    return table(spark, sf, "events").select(
        _key().alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id"
    )


def registry(spark, sf):
    """A registry over the users seen in ``events``."""
    users = table(spark, sf, "events").select("user_id").distinct()
    return users.select(
        _key().alias("key"),
        F.lit("2023-12-31").cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_used"),
        (F.col("user_id") % 5).alias("usage_count"),
        F.lit("").alias("description"),
        (F.col("user_id") % 7 != 0).alias("enabled"),
    )


def used_registry(spark, sf):
    return K.record_usage(registry(spark, sf), uses(spark, sf))


@query("key_usage", f"WITH {KEYS_SQL} SELECT key, enabled, usage_count, last_used FROM usage")
def key_usage(spark, sf):
    return used_registry(spark, sf).select("key", "enabled", "usage_count", "last_used")


@query(
    "key_summary",
    f"""WITH {KEYS_SQL} SELECT count(*) AS total_keys, count(*) FILTER (enabled) AS enabled_keys,
 count(*) FILTER (NOT enabled) AS disabled_keys, CAST(sum(usage_count) AS BIGINT) AS total_usage FROM usage""",
)
def key_summary(spark, sf):
    return K.key_summary(used_registry(spark, sf))


@query(
    "recent_keys",
    f"""WITH {KEYS_SQL} SELECT CASE WHEN length(key) > 8 THEN left(key, 8) || '...' ELSE key END AS key, last_used, usage_count
FROM (SELECT * FROM usage WHERE last_used IS NOT NULL ORDER BY last_used DESC, key LIMIT 5)""",
)
def recent_keys(spark, sf):
    return K.recent_keys(used_registry(spark, sf))


@query(
    "key_verify",
    f"""WITH {KEYS_SQL}, r AS (SELECT event_id, trim(CASE event_type WHEN 'click' THEN '  ' WHEN 'view' THEN 'guest-' || user_id ELSE 'key-' || lpad(CAST(user_id AS VARCHAR), 6, '0') || ' ' END) AS k FROM events),
v AS (SELECT r.event_id, CASE WHEN k = '' THEN 'missing' WHEN k = 'key-000001' OR reg.enabled THEN NULL
 WHEN reg.key IS NULL THEN 'unknown' ELSE 'disabled' END AS why FROM r LEFT JOIN reg ON reg.key = r.k)
SELECT coalesce(why, 'accepted') AS outcome, count(*) AS requests FROM v GROUP BY 1""",
)
def key_verify(spark, sf):
    kind = F.col("event_type")
    guest = F.concat(F.lit("guest-"), F.col("user_id").cast("string"))
    sent = F.when(kind == "click", F.lit("  ")).when(kind == "view", guest).otherwise(F.concat(_key(), F.lit(" ")))
    requests = table(spark, sf, "events").select("event_id", sent.alias("api_key"))
    checked = K.verify_keys(requests, registry(spark, sf), global_key="key-000001")
    return checked.groupBy(F.coalesce("rejected_because", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("requests")
    )


@query(
    "key_changes",
    f"""WITH {KEYS_SQL}, ops AS (SELECT CASE WHEN value < 20 THEN 'key-' ELSE 'new-' END || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, list(CASE event_type WHEN 'signup' THEN 'add'
  WHEN 'click' THEN 'remove' WHEN 'error' THEN 'disable' ELSE 'enable' END ORDER BY ts, event_id) AS ops FROM events GROUP BY 1),
s AS (SELECT o.key, list_reduce(list_prepend(CASE WHEN r.key IS NULL THEN 'absent' WHEN r.enabled THEN 'on' ELSE 'off' END, o.ops),
 lambda st, op: CASE WHEN op = 'remove' THEN 'absent' WHEN op = 'add' THEN CASE WHEN st = 'absent' THEN 'on' ELSE st END
  WHEN st = 'absent' THEN st WHEN op = 'enable' THEN 'on' ELSE 'off' END) AS st FROM ops o LEFT JOIN reg r ON r.key = o.key)
SELECT key, st = 'on' AS enabled FROM s WHERE st <> 'absent'""",
)
def key_changes(spark, sf):
    op = (
        F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "click", "remove")
        .when(F.col("event_type") == "error", "disable").otherwise("enable")
    )
    family = F.when(F.col("value") < 20, "key-").otherwise("new-")
    changes = table(spark, sf, "events").select(
        F.concat(family, F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), op.alias("op"), F.col("props").alias("description"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("change_id")
    )
    return K.apply_changes(registry(spark, sf), changes).select("key", "enabled")


LOG_SQL = f"""{TURNS_SQL}, log AS (SELECT 'key-' || (session_id % 5) AS api_key, ts, request_id, user_message, assistant_response FROM turns)"""


def request_log(spark, sf):
    return turns(spark, sf).select(
        F.concat(F.lit("key-"), (F.col("session_id") % 5).cast("string")).alias("api_key"),
        "ts",
        "request_id",
        F.array(message("system", F.lit("be kind")), message("user", F.col("user_message"))).alias("messages"),
        F.col("assistant_response").alias("response_content"),
    )


@query(
    "transcripts_by_key",
    f"""WITH {LOG_SQL} SELECT api_key, ts, request_id, user_message AS user_question, assistant_response AS model_answer
FROM log WHERE api_key IN ('key-0', 'key-1', 'key-3')""",
)
def transcripts_by_key(spark, sf):
    return K.transcripts(request_log(spark, sf), ["key-0", "key-1", "key-3"])


@query("transcript_counts", f"WITH {LOG_SQL} SELECT api_key, count(*) AS conversations FROM log GROUP BY api_key")
def transcript_counts(spark, sf):
    return K.transcript_counts(K.transcripts(request_log(spark, sf)))
