"""Turns, sessions and users.

A turn table has session_id, user_id, ts, request_id, user_message, assistant_response
and tokens_used; (ts, request_id) orders it. Roll-ups are derived from the append-only
turns instead of being kept as mutable state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.config import CONTEXT_DEFAULT, HISTORY_DEFAULT, MAX_HISTORY_TURNS, SESSION_TTL_DAYS
from wardline.functions.messages import message, turn_messages
from wardline.operators.sequences import HOT_ROWS, with_previous
from wardline.operators.skew import SALTS, salted_join


def turn_pairs(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """User messages with the assistant message right after them; unanswered ones are left out."""
    said = messages.where(F.col("role") == "user").select(conv, turn, F.col("text").alias("user_message"))
    replied = messages.where(F.col("role") == "assistant").select(
        conv, (F.col(turn) - 1).alias(turn), F.col("text").alias("assistant_response")
    )
    return said.join(replied, [conv, turn])


def _at() -> Column:
    return F.struct("ts", "request_id")


def _touches(turns: DataFrame, touches: DataFrame | None) -> DataFrame:
    cols = ["session_id", "user_id", "ts", "request_id"]
    log = turns.select(*cols, "tokens_used", F.lit(1).alias("is_turn"))
    if touches is None:
        return log
    return log.unionByName(
        touches.select(*cols, F.lit(0).cast("bigint").alias("tokens_used"), F.lit(0).alias("is_turn"))
    )


def session_rollup(
    turns: DataFrame, touches: DataFrame | None = None, keep: int = MAX_HISTORY_TURNS
) -> DataFrame:
    """One row per session: first user as owner, activity span, totals, retained turns.

    ``touches`` are requests that open a session without (yet) adding a turn.
    """
    log = _touches(turns, touches)
    return (
        log.groupBy("session_id")
        .agg(
            F.min(F.struct("ts", "request_id", "user_id")).alias("_first"),
            F.max("ts").alias("last_active"),
            F.sum("is_turn").cast("bigint").alias("total_turns"),
            F.sum("tokens_used").cast("bigint").alias("total_tokens"),
        )
        .select(
            "session_id",
            F.col("_first.user_id").alias("user_id"),
            F.col("_first.ts").alias("created_at"),
            F.col("_first.request_id").alias("first_request_id"),
            "last_active",
            "total_turns",
            "total_tokens",
            F.least("total_turns", F.lit(keep)).cast("bigint").alias("retained_turns"),
        )
    )


def user_sessions(turns: DataFrame, touches: DataFrame | None = None) -> DataFrame:
    """Sessions of each owner in long form, ordered by ``created_at`` - no per-user array,
    so a user with very many sessions is no special case."""
    return session_rollup(turns, touches).select("user_id", "session_id", "created_at")


def user_rollup(
    turns: DataFrame, touches: DataFrame | None = None, count_guests: bool = False, salts: int = SALTS
) -> DataFrame:
    """One row per session owner. A user's turns count from the moment they own a session
    on; turns before that - as guest in sessions of others - only with ``count_guests``.

    The comparison with the ownership time is salted, so one very active user is spread
    over ``salts`` tasks before the totals are combined.
    """
    owned = session_rollup(turns, touches).groupBy("user_id").agg(
        F.count("*").alias("total_sessions"),
        F.min(F.struct(F.col("created_at").alias("ts"), F.col("first_request_id").alias("request_id"))).alias("since"),
        F.max("created_at").alias("_last_created"),
    )
    spoken = turns.select("user_id", "ts", "request_id", "tokens_used")
    counted = salted_join(spoken, owned.select("user_id", "since"), ["user_id"], ["request_id"], salts)
    if not count_guests:
        counted = counted.where(_at() >= F.col("since"))
    totals = counted.groupBy("user_id").agg(
        F.count("*").alias("total_turns"),
        F.sum("tokens_used").cast("bigint").alias("total_tokens"),
        F.max("ts").alias("_last_turn"),
    )
    return owned.join(totals, "user_id", "left").select(
        "user_id",
        "total_sessions",
        F.coalesce("total_turns", F.lit(0)).cast("bigint").alias("total_turns"),
        F.coalesce("total_tokens", F.lit(0)).cast("bigint").alias("total_tokens"),
        F.greatest("_last_created", "_last_turn").alias("last_active"),
    )


def retained_turns(turns: DataFrame, keep: int = MAX_HISTORY_TURNS) -> DataFrame:
    """The last ``keep`` turns of each session. Partitions drop surplus rows before the
    shuffle, so a long session sends at most ``keep`` rows per task."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("request_id"))
    return turns.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def history_rows(turns: DataFrame, n: int = HISTORY_DEFAULT) -> DataFrame:
    """Messages of the last ``n`` turns of each session, one row each; all turns if n <= 0."""
    recent = retained_turns(turns, n) if n > 0 else turns
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("user_message").alias("content")),
        F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("assistant_response").alias("content")),
    )
    return recent.select("session_id", "ts", "request_id", F.inline(parts))


def session_history(turns: DataFrame, n: int = HISTORY_DEFAULT) -> DataFrame:
    """Messages of the last ``n`` turns of each session as one array in time order."""
    if n <= 0:
        raise ValueError("an array needs a bound; use history_rows for whole sessions")
    row = F.struct("ts", "request_id", "user_message", "assistant_response")
    per_session = retained_turns(turns, n).groupBy("session_id").agg(F.array_sort(F.collect_list(row)).alias("_t"))
    return per_session.select("session_id", turn_messages(F.col("_t")).alias("messages"))


def with_context(
    turns: DataFrame, n: int = CONTEXT_DEFAULT, hot_rows: int = HOT_ROWS, block_rows: int = 100_000
) -> DataFrame:
    """For each turn the messages it was sent with: up to ``n`` earlier turns of its session
    plus the new user message, and how many messages and turns were added."""
    payload = F.struct("user_message", "assistant_response")
    looked = with_previous(
        turns, ["session_id"], ["ts", "request_id"], n, payload, "_previous", hot_rows, block_rows
    )
    return (
        looked.withColumn(
            "context",
            F.concat(turn_messages(F.col("_previous")), F.array(message("user", F.col("user_message")))),
        )
        .withColumn("context_turns", F.size("_previous").cast("bigint"))
        .withColumn("context_messages", F.col("context_turns") * 2)
        .drop("_previous")
    )


def _idle(as_of: str, days: float) -> Column:
    cutoff = F.expr(f"timestamp'{as_of}' - make_dt_interval(0, 0, 0, {days * 86400.0})")
    return F.coalesce(F.col("last_active") < cutoff, F.lit(False))


def expired_sessions(sessions: DataFrame, as_of: str, days: float = SESSION_TTL_DAYS) -> DataFrame:
    """Sessions idle for more than ``days`` before ``as_of``; an unknown date never expires."""
    return sessions.where(_idle(as_of, days))


def live_sessions(sessions: DataFrame, as_of: str, days: float = SESSION_TTL_DAYS) -> DataFrame:
    """What remains after the clean-up; users' ``total_sessions`` are not affected by it."""
    return sessions.where(~_idle(as_of, days))


def attach_stats(log: DataFrame, users: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add user and session totals to log rows; zero where nothing is known."""
    u = users.select(
        "user_id",
        F.col("total_turns").alias("total_user_turns"),
        F.col("total_tokens").alias("total_user_tokens"),
        F.col("total_sessions").alias("total_user_sessions"),
    )
    s = sessions.select(
        "session_id",
        F.col("total_turns").alias("session_turns"),
        F.col("total_tokens").alias("session_tokens"),
        F.col("created_at").alias("session_created_at"),
    )
    joined = log.join(u, "user_id", "left").join(s, "session_id", "left")
    for c in ("total_user_turns", "total_user_tokens", "total_user_sessions", "session_turns", "session_tokens"):
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)).cast("bigint"))
    return joined
