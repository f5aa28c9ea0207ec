"""The whole chat request path as a batch job, and reports over its log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.config import (
    CONTEXT_DEFAULT,
    FRONT_BLOCK_PREFIX,
    POST_BLOCK_PREFIX,
    SERVICE,
    STANDARD_REFUSAL,
    RequestLimits,
    Thresholds,
)
from wardline.functions import messages as M
from wardline.operators import conversations as conv
from wardline.operators import keys as K
from wardline.operators.quality import split_valid
from wardline.operators.scoring import Scorer
from wardline.operators.sequences import HOT_ROWS, running_sum
from wardline.plans.gates import ServiceLists, front_gate, front_reason, post_gate
from wardline.session import materialise

PARAMETERS = (
    "temperature", "top_p", "max_tokens", "stream", "stop", "presence_penalty", "frequency_penalty",
    "enable_context", "max_context_turns", "user_id",
)


@dataclass(frozen=True)
class ChatResult:
    """Tables a chat batch leaves behind."""

    log: DataFrame  # one row per answered or blocked request
    turns: DataFrame  # turns added to sessions
    replies: DataFrame  # what each caller receives
    rejected: DataFrame  # invalid requests and refused keys, with the reason


def session_context(
    requests: DataFrame, recorded: Column, max_turns: Column, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(request_id, history): the last recorded turns of the session before each request.

    Recorded turns are numbered per session; a request then asks for its few predecessors
    by number, so the grouping key is the request and never a whole session.
    """
    base = requests.withColumn("_recorded", recorded).withColumn("_max", max_turns)
    counted = running_sum(
        base.select("session_id", "ts", "request_id", "user_message", "response_content", "_recorded", "_max"),
        ["session_id"], ["ts", "request_id"], F.col("_recorded").cast("int"), "_no", hot_rows,
    )
    seen = F.col("_no") - F.col("_recorded").cast("int")
    first = F.greatest(seen - F.col("_max") + 1, F.lit(1))
    wanted = counted.where(seen > 0).select("session_id", "request_id", F.explode(F.sequence(first, seen)).alias("_no"))
    stored = counted.where("_recorded").select(
        "session_id", "_no", "user_message", F.col("response_content").alias("assistant_response")
    )
    row = F.struct("_no", "user_message", "assistant_response")
    found = wanted.join(stored, ["session_id", "_no"]).groupBy("request_id").agg(
        F.array_sort(F.collect_list(row)).alias("_turns")
    )
    return found.select("request_id", M.turn_messages(F.col("_turns")).alias("history"))


def moderate_chat(
    requests: DataFrame,
    responses: DataFrame,
    lists: ServiceLists,
    scorer: Scorer,
    answer_scorer: Scorer | None = None,
    registry: DataFrame | None = None,
    retrieved: DataFrame | None = None,
    thresholds: Thresholds = SERVICE,
    limits: RequestLimits = RequestLimits(),
    hot_rows: int = HOT_ROWS,
) -> ChatResult:
    """Key check, validation, prompt gate, session context, retrieval prompt, answer gate,
    log and turns for a batch of requests and the backend's responses to them.

    A verdict depends on the request's own texts only, so all gates run first; the history
    of a request is then the earlier requests that came through both. ``retrieved`` holds
    (request_id, rag_context); a failed retrieval is a NULL and lets the request pass.
    """
    valid, invalid = split_valid(requests, limits)
    rejected = invalid.select("request_id", F.concat_ws(",", "violations").alias("reason"))
    if registry is not None:
        checked = K.verify_keys(valid, registry)
        refused = checked.where(~F.col("accepted"))
        rejected = rejected.unionByName(
            refused.select("request_id", F.concat(F.lit("api_key "), "rejected_because").alias("reason"))
        )
        valid = checked.where("accepted").drop("accepted", "rejected_because")
    resolved = (
        valid.withColumn("_user", M.request_user(F.col("user_id"), F.col("user")))
        .withColumn("user_message", M.last_user_message(F.col("messages")))
        .withColumn("_with", F.coalesce("enable_context", F.lit(False)))
        .withColumn("_turns", F.coalesce("max_context_turns", F.lit(CONTEXT_DEFAULT)))
    )
    gated = front_gate(resolved, ["request_id"], "user_message", lists, scorer, thresholds)
    front_ok = F.col("is_safe") | (F.length("user_message") == 0)  # nothing to check, nothing to block
    gated = gated.withColumn("_front_ok", front_ok).withColumnRenamed("stage", "front_stage").drop("is_safe", "flag")

    answered = gated.join(responses, "request_id", "left")
    answered = post_gate(answered, ["request_id"], "response_content", answer_scorer or scorer)
    has_answer = F.length(F.coalesce("response_content", F.lit(""))) > 0
    answered = answered.withColumn("_post_ok", F.col("is_safe") | ~has_answer).drop("is_safe")
    # Log, turns, replies and histories all start from the verdicts: judge once, write down.
    answered = materialise(answered, "verdicts")

    in_session = F.col("_with") & (F.coalesce(F.col("session_id").cast("string"), F.lit("")) != "") & (F.col("_user") != "anonymous")
    recorded = F.col("_front_ok") & F.col("_post_ok") & has_answer
    eligible = answered.where(in_session & F.col("_front_ok"))
    history = session_context(eligible, recorded, F.col("_turns"), hot_rows)
    joined = answered.join(history, "request_id", "left").withColumn(
        "history", F.when(F.col("_front_ok"), F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")))
    )
    context_messages = F.coalesce(F.size("history"), F.lit(0)).cast("bigint")
    joined = joined.withColumn("context_messages", F.greatest(context_messages, F.lit(0)).cast("bigint"))
    plain = F.transform("messages", lambda m: M.message(m["role"], m["content"]))
    sent = F.when(F.col("_front_ok"), F.concat("history", plain))
    if retrieved is not None:
        joined = joined.join(retrieved.select("request_id", "rag_context"), "request_id", "left")
        prompt = F.when(
            F.length("rag_context") > 0, M.safe_prompt(F.col("user_message"), F.col("rag_context"))
        )
        sent = F.when(F.col("_front_ok"), M.apply_context_prompt(sent, prompt, F.col("_with")))
    joined = joined.withColumn("sent_messages", sent)

    blocked = ~F.col("_front_ok")
    stopped = ~blocked & ~F.col("_post_ok")
    reply = M.safety_response()
    error = (
        F.when(blocked, F.concat(F.lit(f"{FRONT_BLOCK_PREFIX}: "), front_reason(F.col("front_stage"))))
        .when(stopped, F.lit(f"{POST_BLOCK_PREFIX}: a sentence is over the threshold"))
    )
    rows = (
        joined.withColumn("error", error)
        .withColumn("finish_reason", F.when(blocked | stopped, "content_filter").otherwise(F.col("finish_reason")))
        .withColumn("_reply", F.when(blocked | stopped, F.lit(STANDARD_REFUSAL)).otherwise(F.col("response_content")))
        .withColumn("response_content", F.when(blocked, F.lit(STANDARD_REFUSAL)).otherwise(F.col("response_content")))
        .withColumn("tokens_used", F.when(blocked, reply["total_tokens"]).otherwise(F.col("tokens_used")))
    )
    log = rows.select(
        "ts", F.col("_user").alias("user_id"), "session_id", "request_id", "model", "messages",
        request_parameters(requests.columns).alias("parameters"), "api_key", "response_time", "tokens_used",
        "response_content", "finish_reason", "error", "front_stage",
        (F.col("_with") & (F.col("context_messages") > 0)).alias("with_context"),
        "context_messages", (F.col("context_messages") / 2).cast("bigint").alias("context_turns"), "sent_messages",
    )
    turns = rows.where(in_session & F.col("error").isNull() & has_answer).select(
        "session_id", F.col("_user").alias("user_id"), "ts", "request_id", "user_message",
        F.col("response_content").alias("assistant_response"), "model",
        F.coalesce("tokens_used", F.lit(0)).cast("bigint").alias("tokens_used"), "response_time",
        F.coalesce("finish_reason", F.lit("unknown")).alias("finish_reason"),
    )
    replies = rows.select("request_id", F.col("_reply").alias("content"), "finish_reason")
    return ChatResult(log, turns, replies, rejected)


def request_parameters(columns: Sequence[str]) -> Column:
    """The logged request parameters that the table has."""
    return F.struct(*[F.col(c) for c in PARAMETERS if c in columns])


def conversation_analytics(turns: DataFrame, as_of: str | None = None, days: float = 30) -> dict[str, DataFrame]:
    """Sessions, users, sessions by user and retained turns of a turn table."""
    sessions = conv.session_rollup(turns)
    return {
        "sessions": sessions if as_of is None else conv.live_sessions(sessions, as_of, days),
        "users": conv.user_rollup(turns),
        "user_sessions": conv.user_sessions(turns),
        "retained_turns": conv.retained_turns(turns),
    }


def key_usage_report(log: DataFrame, registry: DataFrame, recent: int = 5) -> dict[str, DataFrame]:
    """Usage, summary, recently used keys and transcripts of accepted requests."""
    accepted = K.verify_keys(log, registry).where("accepted")
    used = K.record_usage(registry, accepted.select(F.col("api_key").alias("key"), "ts"))
    transcripts = K.transcripts(accepted)
    return {
        "registry": used,
        "summary": K.key_summary(used),
        "recent": K.recent_keys(used, recent),
        "transcripts": transcripts,
        "transcript_counts": K.transcript_counts(transcripts),
    }
