"""Sources and sinks, over files made from the tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog import sqltext as q
from wardline.catalog.chats import PAIRS_SQL, SESSIONS_SQL, TURNS_SQL, USERS_SQL, pairs, turns
from wardline.catalog.keys import KEYS_SQL, LOG_SQL, request_log, used_registry
from wardline.catalog.registry import query, table
from wardline.functions import text as TX
from wardline.operators import conversations as conv
from wardline.operators import keys as K
from wardline.operators import quality as Q
from wardline.operators import training as T
from wardline.session import scratch_path
from wardline.sources import readers as R
from wardline.sources import writers as W


@query(
    "file_knowledge_base",
    f"""WITH t AS (SELECT unnest(list_transform(string_split(text, chr(10)), lambda s: {q.strip('s')})) AS chunk FROM documents)
SELECT chunk, count(*) AS n FROM t WHERE length(chunk) > 10 GROUP BY chunk""",
)
def file_knowledge_base(spark, sf):
    path = scratch_path(spark, "kb")
    table(spark, sf, "documents").select("text").write.text(path)
    return R.knowledge_base(spark, path).groupBy("chunk").agg(F.count("*").alias("n"))


_KIND = "doc_id % 5"


@query(
    "file_jsonl_corpus",
    f"""SELECT CASE {_KIND} WHEN 1 THEN '[' || doc_id || ']' ELSE text END AS text,
 CASE {_KIND} WHEN 0 THEN lang || '/' || n_chars ELSE '' END AS metadata, count(*) AS n
FROM documents WHERE {_KIND} <> 2 GROUP BY ALL""",
)
def file_jsonl_corpus(spark, sf):
    """Objects, bare strings, other JSON and malformed lines, by document."""
    kind, text = F.col("doc_id") % 5, F.col("text")
    nested = F.struct(F.col("source").alias("origin"))
    line = (
        F.when(kind == 0, F.to_json(F.struct("text", "lang", "n_chars", nested.alias("nested"))))
        .when(kind == 1, F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]")))
        .when(kind == 2, F.concat(F.lit('{"text": '), F.col("doc_id").cast("string")))
        .when(kind == 3, F.to_json(F.struct("text")))
        .otherwise(F.regexp_extract(F.to_json(F.struct("text")), r"(?s)^\{\"text\":(.*)\}$", 1))
    )
    path = scratch_path(spark, "corpus")
    table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    m = F.col("metadata")
    known = F.concat_ws("/", m["lang"], m["n_chars"])
    return R.jsonl_corpus(spark, path).groupBy("text", known.alias("metadata")).agg(F.count("*").alias("n"))


LINES_PER_FILE = 20_000


@query(
    "file_line_numbers",
    "SELECT count(*) AS n_lines, 0 AS files_with_gaps FROM documents",
)
def file_line_numbers(spark, sf):
    """Line numbers of every file run from 1 without gaps."""
    path = scratch_path(spark, "numbered")
    lines = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("text")).alias("value"))
    files = max(4, -(-lines.count() // LINES_PER_FILE))  # one task numbers a file
    lines.repartition(files, "doc_id").select("value").write.text(path)
    per_file = R.jsonl_corpus(spark, path).groupBy("source").agg(
        F.count("*").alias("n"), F.max("line_number").alias("last"), F.sum("line_number").alias("total")
    )
    gap = (F.col("last") != F.col("n")) | (F.col("total") != F.col("n") * (F.col("n") + 1) / 2)
    return per_file.agg(F.sum("n").cast("bigint").alias("n_lines"), F.count_if(gap).cast("int").alias("files_with_gaps"))


@query(
    "file_request_log",
    f"""WITH {LOG_SQL} SELECT 'row' AS kind, api_key, request_id, user_message AS user_question, assistant_response AS response FROM log
UNION ALL SELECT 'malformed', NULL, NULL, NULL, '{{"request_id": "' || request_id FROM log""",
)
def file_request_log(spark, sf):
    """A log with a malformed and a blank line after every row."""
    log = request_log(spark, sf)
    good = F.to_json(F.struct(F.col("ts").alias("timestamp"), "api_key", "request_id", "messages", "response_content"))
    bad = F.concat(F.lit('{"request_id": "'), "request_id")
    path = scratch_path(spark, "log")
    log.select(F.explode(F.array(good, bad, F.lit("  "))).alias("value")).write.text(path)
    rows, malformed = R.request_log(spark, path)
    none = F.lit(None).cast("string")
    said = K.first_user_message(F.col("messages"))
    return rows.select(
        F.lit("row").alias("kind"), "api_key", "request_id", said.alias("user_question"), F.col("response_content").alias("response")
    ).unionByName(
        malformed.select(
            F.lit("malformed").alias("kind"), none.alias("api_key"), none.alias("request_id"),
            none.alias("user_question"), F.col("line").alias("response"),
        )
    )


@query(
    "file_log_sink",
    f"WITH {LOG_SQL} SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS requests FROM log GROUP BY 1",
)
def file_log_sink(spark, sf):
    path = scratch_path(spark, "log-sink")
    W.append_request_log(request_log(spark, sf), path)
    back = spark.read.schema("request_id string, date string").json(path)
    return back.groupBy("date").agg(F.count("request_id").alias("requests"))


@query(
    "file_snapshot",
    f"""WITH {TURNS_SQL}, {SESSIONS_SQL}, {USERS_SQL} SELECT 'turns' AS part, count(*) AS n, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM turns
UNION ALL SELECT 'sessions', count(*), CAST(sum(total_tokens) AS BIGINT) FROM sessions
UNION ALL SELECT 'users', count(*), CAST(sum(total_tokens) AS BIGINT) FROM users""",
)
def file_snapshot(spark, sf):
    t, path = turns(spark, sf), scratch_path(spark, "snapshot")
    W.save_snapshot({"turns": t, "sessions": conv.session_rollup(t), "users": conv.user_rollup(t)}, path)
    back = W.load_snapshot(spark, path)
    out = None
    for part, column in (("turns", "tokens_used"), ("sessions", "total_tokens"), ("users", "total_tokens")):
        one = back[part].agg(F.count("*").alias("n"), F.sum(column).cast("bigint").alias("tokens"))
        one = one.select(F.lit(part).alias("part"), "n", "tokens")
        out = one if out is None else out.unionByName(one)
    return out


@query("file_registry", f"WITH {KEYS_SQL} SELECT key, enabled, usage_count FROM usage")
def file_registry(spark, sf):
    path = scratch_path(spark, "registry")
    W.save_registry(used_registry(spark, sf), path)
    return R.saved_registry(spark, path).select("key", "enabled", "usage_count")


@query(
    "file_transcripts",
    f"WITH {LOG_SQL} SELECT api_key, user_message AS user_question, assistant_response AS model_answer FROM log",
)
def file_transcripts(spark, sf):
    path = scratch_path(spark, "transcripts")
    W.save_transcripts(K.transcripts(request_log(spark, sf)), path)
    return spark.read.schema("user_question string, model_answer string, api_key string").json(path)


@query(
    "file_sft_rows",
    f"WITH {PAIRS_SQL} SELECT {q.strip('user_message')} AS question, {q.strip('assistant_response')} AS answer FROM pairs",
)
def file_sft_rows(spark, sf):
    """Question/answer files to chat rows, saved and read again."""
    source, sink = scratch_path(spark, "qa"), scratch_path(spark, "sft")
    pairs(spark, sf).select(F.col("user_message").alias("question"), F.col("assistant_response").alias("answer")).write.json(source)
    W.save_chat_rows(T.sft_rows(R.question_answer_folder(spark, source, "*.json")), sink)
    back = spark.read.schema("messages array<struct<role:string,content:string>>").json(sink)
    return back.select(
        F.get("messages", F.lit(0))["content"].alias("question"), F.get("messages", F.lit(1))["content"].alias("answer")
    )


@query(
    "file_labelled_texts",
    "SELECT toxic AS label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY toxic",
)
def file_labelled_texts(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    both = table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id")
    paths = {}
    for value in (0, 1):
        paths[value] = scratch_path(spark, f"labelled-{value}")
        both.where(F.col("toxic") == value).select("text").write.json(paths[value])
    read = R.labelled_texts(spark, paths[1], paths[0])
    return read.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


# ---------------------------------------------------------------- word lists and registries of the kinds people keep


def _json_file(df, value, name):
    """One JSON document in a folder of its own, as the readers expect."""
    path = scratch_path(df.sparkSession, name)
    df.select(value.alias("value")).coalesce(1).write.text(path)
    return path


_WORD_FILE_SQL = f"""words AS (SELECT DISTINCT keyword FROM (SELECT unnest({q.tokens('text')}) AS keyword FROM benchmark)
 UNION ALL SELECT repeat(' ', CAST(item_id + 1 AS INT)) FROM benchmark WHERE item_id % 10 = 0)"""


def keyword_file(spark, sf) -> str:
    """The words of ``benchmark`` as a JSON list, every word of every passage, with blank ones among them."""
    items = table(spark, sf, "benchmark")
    words = items.select(F.explode(TX.tokens(F.col("text"))).alias("w"))
    blank = items.where("item_id % 10 = 0").select(F.expr("repeat(' ', cast(item_id + 1 AS int))").alias("w"))
    return _json_file(words.unionByName(blank).agg(F.collect_list("w").alias("w")), F.to_json("w"), "keywords")


@query("file_keywords", f"WITH {_WORD_FILE_SQL} SELECT 'severe' AS list_name, keyword FROM words")
def file_keywords(spark, sf):
    return R.keyword_list(spark, keyword_file(spark, sf), "severe")


@query("file_keywords_wrapped", f"WITH {_WORD_FILE_SQL} SELECT 'severe' AS list_name, keyword FROM words")
def file_keywords_wrapped(spark, sf):
    """The same list as an object with a ``keywords`` field."""
    read = spark.read.text(keyword_file(spark, sf)).select(F.from_json("value", "array<string>").alias("keywords"))
    return R.keyword_list(spark, _json_file(read, F.to_json(F.struct("keywords")), "wrapped"), "severe")


_BLACKLIST_SQL = f"""cats AS (SELECT 'item-' || (item_id % 7) AS category, unnest(list_distinct({q.tokens('text')})) AS sub_keyword FROM benchmark WHERE item_id % 7 > 0)"""


def blacklist_file(spark, sf) -> str:
    """Passages as entries of a category blacklist; some have no name and are skipped."""
    named = F.when(F.col("item_id") % 7 > 0, F.concat(F.lit("item-"), (F.col("item_id") % 7).cast("string")))
    entry = F.struct(named.alias("keyword"), F.array_distinct(TX.tokens(F.col("text"))).alias("sub_keywords"))
    return _json_file(table(spark, sf, "benchmark").agg(F.collect_list(entry).alias("e")), F.to_json("e"), "blacklist")


@query("file_blacklist", f"WITH {_BLACKLIST_SQL} SELECT category, sub_keyword, count(*) AS n FROM cats GROUP BY ALL")
def file_blacklist(spark, sf):
    entries = R.category_blacklist(spark, blacklist_file(spark, sf))
    return entries.groupBy("category", "sub_keyword").agg(F.count("*").alias("n"))


_REGISTRY_SQL = """users AS (SELECT user_id, count(*) AS n, max(ts) AS last_used FROM events GROUP BY user_id),
known AS (SELECT 'user-' || user_id AS key, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2023-12-31' END AS created_at,
 CASE WHEN user_id % 4 > 0 THEN last_used END AS last_used, CASE WHEN user_id % 5 = 0 THEN 0 WHEN user_id % 11 = 0 THEN -n ELSE n END AS usage_count,
 user_id % 7 > 0 AS enabled FROM users)"""


def registry_file(spark, sf) -> str:
    """The users of ``events`` as an API-key file: an object of attributes by key, some left out, with
    blanks around keys, negative counts and keys that are nothing but blanks."""
    users = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("t"))
    u, stamp = F.col("user_id"), "yyyy-MM-dd HH:mm:ss.SSSSSS"
    attributes = F.struct(
        F.when(u % 3 > 0, F.lit("2023-12-31 00:00:00")).alias("created_at"),
        F.when(u % 4 > 0, F.date_format(F.col("t").cast("timestamp"), stamp)).alias("last_used"),
        F.when(u % 5 > 0, F.when(u % 11 == 0, -F.col("n")).otherwise(F.col("n"))).alias("usage_count"),
        F.when(u % 7 == 0, F.lit(False)).alias("enabled"),
    )
    key = F.concat(F.when(u % 2 == 0, F.lit(" ")).otherwise(F.lit("")), F.lit("user-"), u.cast("string"))
    one = users.agg(F.map_from_entries(F.collect_list(F.struct(key.alias("key"), attributes.alias("value")))).alias("m"))
    return _json_file(one, F.to_json("m"), "registry")


@query("file_key_registry", f"WITH {_REGISTRY_SQL} SELECT key, created_at, last_used, usage_count, enabled FROM known")
def file_key_registry(spark, sf):
    found = R.key_registry(spark, registry_file(spark, sf), "2024-06-01")
    return found.select("key", "created_at", "last_used", "usage_count", "enabled")


KEYWORD_RULES = [Q.Constraint("blank", "length(trim(keyword)) = 0"), Q.Constraint("short", "length(trim(keyword)) BETWEEN 1 AND 2", "warning")]
BLACKLIST_RULES = [Q.Constraint("blank", "length(trim(sub_keyword)) = 0"), Q.Constraint("short", "length(sub_keyword) < 3", "warning")]
REGISTRY_RULES = [
    Q.Constraint("negative", "usage_count < 0"), Q.Constraint("never_used", "usage_count > 0 AND last_used IS NULL", "warning"),
    Q.Constraint("created_late", "created_at > last_used"), Q.Constraint("disabled", "NOT enabled", "warning"),
]
DOCUMENT_RULES = [
    Q.Constraint("blank", "length(trim(text)) = 0"), Q.Constraint("length", "length(text) <> n_chars"), Q.Constraint("no_language", "lang IS NULL"),
]


def _source_sql(source, name, table_, bad, severity):
    return f"SELECT '{source}' AS source, '{name}' AS name, count(*) AS n_rows, count(*) FILTER ({bad}) AS n_bad, '{severity}' AS sev FROM {table_}"


_SOURCES_SQL = "\nUNION ALL ".join(
    [_source_sql("keywords", c.name, "words", c.bad, c.severity) for c in KEYWORD_RULES]
    + [_source_sql("blacklist", c.name, "cats", c.bad, c.severity) for c in BLACKLIST_RULES]
    + ["SELECT 'blacklist', 'repeated', sum(n), count(*) FILTER (n > 1), 'warning' FROM (SELECT count(*) AS n FROM cats GROUP BY category, sub_keyword)"]
    + [_source_sql("registry", c.name, "known", c.bad, c.severity) for c in REGISTRY_RULES]
    + [_source_sql("documents", c.name, "documents", c.bad, c.severity) for c in DOCUMENT_RULES]
    + ["SELECT 'documents', 'repeated', sum(n), count(*) FILTER (n > 1), 'warning' FROM (SELECT count(*) AS n FROM documents GROUP BY text)"]
)


@query(
    "source_quality",
    f"""WITH {_WORD_FILE_SQL}, {_BLACKLIST_SQL}, {_REGISTRY_SQL}, c AS ({_SOURCES_SQL})
SELECT source, name, CAST(n_rows AS BIGINT) AS n_rows, n_bad, CASE WHEN n_bad > 0 THEN sev WHEN n_rows = 0 THEN 'warning' ELSE 'pass' END AS status FROM c""",
)
def source_quality(spark, sf):
    """Checks of word lists, blacklist, registry and texts, each able to fail: the files have planted faults."""
    docs = table(spark, sf, "documents").select("text", "n_chars", "lang", F.md5("text").alias("digest"))
    return Q.all_checks(
        Q.source_checks(R.keyword_list(spark, keyword_file(spark, sf)), "keywords", KEYWORD_RULES),
        Q.source_checks(R.category_blacklist(spark, blacklist_file(spark, sf)), "blacklist", BLACKLIST_RULES, ["category", "sub_keyword"]),
        Q.source_checks(R.key_registry(spark, registry_file(spark, sf), "2024-06-01"), "registry", REGISTRY_RULES),
        Q.source_checks(docs, "documents", DOCUMENT_RULES, ["digest"]),
    )
