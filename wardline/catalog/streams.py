"""The streaming operators, run over all available input of files made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog import fixtures as fx
from wardline.catalog.chats import TURNS_SQL, event_turns, tokens_sql, turns
from wardline.catalog.gates import DOC_GATE_SQL, POST_SQL
from wardline.catalog.keys import KEYS_SQL, registry
from wardline.catalog.registry import query, table
from wardline.config import STANDARD_REFUSAL
from wardline.plans import gates
from wardline.session import scratch_path
from wardline.streaming import gate as G
from wardline.streaming import lines as L
from wardline.streaming import runs as R

#: Files of a stream's input: at least ``FILES``, and more when they would have over ``FILE_ROWS``
#: table rows, so that a batch - half of the files - has work for all cores at any size.
FILES, FILE_ROWS = 8, 10_000


def file_count(rows) -> int:
    return max(FILES, -(-rows.count() // FILE_ROWS))


#: Of these conversations answers end with an error line, or have a line behind their end.
FAULTY, TRAILING = "conv_id % 5 = 0", "conv_id % 3 = 0"
BEHIND = 7


def line_files(spark, sf, faults: bool = False) -> tuple[str, int]:
    """Every assistant message as stream lines; a part of the lines arrives twice, and the
    files mix requests and positions. ``faults``: with errors, and lines behind the end. The folder
    and how many files it has."""
    answers = table(spark, sf, "conversations").where("role = 'assistant'").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), "text"
    )
    rows = L.answer_lines(answers, ["request_id"], "text")
    if faults:
        conv_id = F.split_part("request_id", F.lit("-"), F.lit(1)).cast("bigint").alias("conv_id")
        rows = rows.select("*", conv_id)
        ended = F.contains(F.col("line"), F.lit('"finish_reason":"stop"'))
        failed = L.PREFIX + '{"error": {"message": "backend down"}}'
        more = rows.where(f"line = '{L.PREFIX + L.DONE}' AND {TRAILING}").withColumns(
            {"seq": F.col("seq") + BEHIND, "line": F.lit(L.PREFIX + '{"choices": [{"delta": {"content": "late"}}]}')}
        )
        rows = rows.withColumn("line", F.when(ended & F.expr(FAULTY), F.lit(failed)).otherwise(F.col("line")))
        rows = rows.unionByName(more).drop("conv_id")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("seq")))
    copies = F.when(F.pmod(F.xxhash64("request_id", "seq"), F.lit(5)) == 0, 2).otherwise(1)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    path = scratch_path(spark, "lines")
    files = file_count(answers)
    rows.repartition(files, F.xxhash64("request_id", "seq", "_copy")).drop("_copy").write.json(path)
    return path, files


def _stream(spark, sf, faults: bool = False):
    path, files = line_files(spark, sf, faults)
    return R.read_lines(spark, path, files // 2)


def _finish(spark, stream, name):
    out = scratch_path(spark, name)
    R.run_to_parquet(stream, out, scratch_path(spark, f"{name}-checkpoint"))
    return R.stored(spark, out, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields))


_REQUEST = "conv_id || '-' || turn AS request_id"
_PIECES = "CAST(ceil(length(text) / 40.0) AS BIGINT)"


@query(
    "stream_lines",
    f"""WITH a AS (SELECT {_REQUEST}, {_PIECES} AS n FROM conversations WHERE role = 'assistant')
SELECT request_id, n AS deltas, 1 AS finishes, 1 AS ends FROM a""",
)
def stream_lines(spark, sf):
    """Parsed lines, copies removed."""
    parsed = L.parse_lines(_finish(spark, _stream(spark, sf), "lines-read").dropDuplicates(["request_id", "seq"]))
    return parsed.groupBy("request_id").agg(
        F.count_if((F.col("kind") == "delta") & (F.length("content") > 0)).alias("deltas"),
        F.count_if(F.col("finish_reason").isNotNull()).cast("int").alias("finishes"),
        F.count_if(F.col("kind") == "done").cast("int").alias("ends"),
    )


@query(
    "stream_assemble",
    f"""SELECT {_REQUEST}, text AS content, 'stop' AS finish_reason, 'complete' AS status, {_PIECES} + 1 AS n_lines
FROM conversations WHERE role = 'assistant'""",
)
def stream_assemble(spark, sf):
    rows = _finish(spark, G.assemble_stream(_stream(spark, sf)), "answers")
    return rows.select("request_id", "content", "finish_reason", "status", F.col("n_lines").cast("bigint").alias("n_lines"))


@query(
    "batch_assemble",
    f"""SELECT {_REQUEST}, text AS content, 'stop' AS finish_reason, 'complete' AS status, {_PIECES} + 1 AS n_lines
FROM conversations WHERE role = 'assistant'""",
)
def batch_assemble(spark, sf):
    rows = G.assemble_batch(spark.read.schema("request_id string, seq int, line string, ts timestamp").json(line_files(spark, sf)[0]))
    return rows.select("request_id", "content", "finish_reason", "status", F.col("n_lines").cast("bigint").alias("n_lines"))


@query(
    "stream_gate",
    f"""WITH {POST_SQL} SELECT a.conv_id || '-' || a.turn AS request_id, bad.bad IS NULL AS is_safe,
 CASE WHEN bad.bad IS NULL THEN CAST(ceil(length(a.text) / 40.0) AS BIGINT) + 2 ELSE length('{STANDARD_REFUSAL}') + 3 END AS released_lines
FROM answers a LEFT JOIN bad ON bad.conv_id = a.conv_id AND bad.turn = a.turn""",
)
def stream_gate(spark, sf):
    rows = _finish(spark, G.stream_gate(_stream(spark, sf), fx.CHAT_SCORER), "gated")
    return rows.select("request_id", "is_safe", F.size("released").cast("bigint").alias("released_lines"))


@query(
    "stream_released_text",
    f"""WITH {POST_SQL} SELECT a.conv_id || '-' || a.turn AS request_id,
 CASE WHEN bad.bad IS NULL THEN a.text ELSE '{STANDARD_REFUSAL}' END AS received,
 CASE WHEN bad.bad IS NULL THEN 'stop' ELSE 'content_filter' END AS finish_reason
FROM answers a LEFT JOIN bad ON bad.conv_id = a.conv_id AND bad.turn = a.turn""",
)
def stream_released_text(spark, sf):
    """What a reader of the released lines puts together again."""
    gated = _finish(spark, G.stream_gate(_stream(spark, sf), fx.CHAT_SCORER), "gated")
    sent = G.released_rows(gated).select(
        "request_id", F.col("pos").cast("int").alias("seq"), "line", F.lit("2024-01-01").cast("timestamp").alias("ts")
    )
    read = G.assemble_batch(sent)
    return read.select("request_id", F.col("content").alias("received"), "finish_reason")


@query(
    "stream_completion_log",
    f"""WITH {POST_SQL} SELECT a.conv_id || '-' || a.turn AS request_id, {tokens_sql('a.text')} AS tokens_used,
 CAST(ceil(length(a.text) / 40.0) AS DOUBLE) AS response_time, CASE WHEN bad.bad IS NULL THEN 'stop' ELSE 'content_filter' END AS finish_reason
FROM answers a LEFT JOIN bad ON bad.conv_id = a.conv_id AND bad.turn = a.turn""",
)
def stream_completion_log(spark, sf):
    """Finish time is that of the finish line; the end mark may come later."""
    log = G.completion_log(G.stream_gate(_stream(spark, sf), fx.CHAT_SCORER), "finish_ts")
    return _finish(spark, log, "log").select("request_id", "tokens_used", "response_time", "finish_reason")


@query(
    "stream_fault_log",
    f"""WITH {POST_SQL}, x AS (SELECT a.conv_id, a.turn, a.text, bad.bad, a.{FAULTY} AS faulty
 FROM answers a LEFT JOIN bad ON bad.conv_id = a.conv_id AND bad.turn = a.turn)
SELECT conv_id || '-' || turn AS request_id, CASE WHEN faulty THEN '' ELSE text END AS response_content,
 CASE WHEN faulty THEN 0 ELSE {tokens_sql('text')} END AS tokens_used, CASE WHEN faulty THEN 'backend down' END AS error,
 CASE WHEN bad IS NOT NULL THEN 'content_filter' WHEN NOT faulty THEN 'stop' END AS finish_reason FROM x""",
)
def stream_fault_log(spark, sf):
    """The log of a stream in which some answers end with an error and some go on behind their end."""
    log = G.completion_log(G.stream_gate(_stream(spark, sf, True), fx.CHAT_SCORER), "finish_ts")
    return _finish(spark, log, "log").select("request_id", "response_content", "tokens_used", "error", "finish_reason")


@query(
    "stream_lines_behind",
    f"""SELECT {_REQUEST}, CAST({_PIECES} + 1 + {BEHIND} AS INT) AS seq FROM conversations WHERE role = 'assistant' AND {TRAILING}""",
)
def stream_lines_behind(spark, sf):
    """Lines behind the end of their answer, each once, from the stream's side output."""
    dropped = _finish(spark, G.dropped_lines(_stream(spark, sf, True)), "dropped")
    return dropped.where("what = 'behind'").select("request_id", "seq").distinct()


def _turn_files(spark, df):
    path = scratch_path(spark, "turns")
    df.repartition(FILES, F.xxhash64("request_id")).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


@query(
    "stream_session_totals",
    f"""WITH {TURNS_SQL} SELECT session_id, count(*) AS total_turns, CAST(sum(tokens_used) AS BIGINT) AS total_tokens, max(ts) AS last_active
FROM turns GROUP BY session_id""",
)
def stream_session_totals(spark, sf):
    stream = _turn_files(spark, turns(spark, sf).select("session_id", "user_id", "ts", "request_id", "tokens_used"))
    out = scratch_path(spark, "totals")
    R.write_updates(R.running_totals(stream, "session_id"), out, scratch_path(spark, "totals-checkpoint")).awaitTermination()
    return R.latest_totals(spark, out, "session_id")


@query(
    "stream_expired_sessions",
    """WITH g AS (SELECT user_id, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
 (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 12 HOUR AS gap FROM events)),
w AS (SELECT user_id AS session_id, s, count(*) AS total_turns, max(ts) AS last_active FROM g GROUP BY user_id, s)
SELECT session_id, total_turns, last_active FROM w WHERE last_active + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stream_expired_sessions(spark, sf):
    """Visits of ``events`` that ended by 12 idle hours, as a stream reports them."""
    df = event_turns(spark, sf).select("session_id", "ts", "request_id", "tokens_used")
    path = scratch_path(spark, "visits")
    df.repartitionByRange(FILES, "ts").write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    return _finish(spark, R.expiring_sessions(stream, "12 hours", "1 hour"), "expired").drop("total_tokens")


@query("stream_front_gate", f"WITH {DOC_GATE_SQL} SELECT doc_id, stage FROM gate")
def stream_front_gate(spark, sf):
    """The prompt gate on a stream of texts: the same expressions, no state."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = scratch_path(spark, "prompts")
    files = file_count(docs)
    docs.repartition(files).write.parquet(path)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files // 2).parquet(path)
    gated = gates.front_gate(stream, ["doc_id"], "text", fx.DOC_SERVICE, fx.DOC_SCORER)
    return _finish(spark, gated.select("doc_id", "stage"), "prompts-gated")


@query(
    "stream_key_check",
    f"""WITH {KEYS_SQL} SELECT e.event_id, r.enabled AS accepted FROM events e
 JOIN reg r ON r.key = 'key-' || lpad(CAST(e.user_id AS VARCHAR), 6, '0')""",
)
def stream_key_check(spark, sf):
    """Key checks on a request stream with a registry that is loaded again when old."""
    df = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("key-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("api_key")
    )
    path, out = scratch_path(spark, "requests"), scratch_path(spark, "checked")
    df.repartition(FILES).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 6).parquet(path)

    def save(batch, batch_id):
        batch.select("event_id", "accepted").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    R.with_registry(
        stream, lambda: registry(spark, sf), save, scratch_path(spark, "checked-checkpoint"), refresh_seconds=0
    ).awaitTermination()
    return spark.read.parquet(out).select("event_id", "accepted")
