"""API-key registry: verification, usage, changes, transcripts.

A registry has key, created_at, last_used, usage_count, description and enabled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.config import FRONT_BLOCK_PREFIX, POST_BLOCK_PREFIX
from wardline.functions.messages import first_user_message, key_preview
from wardline.functions.text import strip
from wardline.operators.skew import salted_join
from wardline.session import broadcast_within

BROADCAST_KEYS = 500_000


def verify_keys(
    requests: DataFrame,
    registry: DataFrame,
    key: str = "api_key",
    global_key: str | None = None,
    use_registry: bool = True,
) -> DataFrame:
    """Add ``accepted`` and ``rejected_because``. A key passes when it is the global key or
    known and enabled; with neither configured every request passes."""
    if not use_registry and not global_key:
        return requests.withColumn("accepted", F.lit(True)).withColumn(
            "rejected_because", F.lit(None).cast("string")
        )
    df = requests.withColumn("_key", strip(F.col(key)))
    if use_registry:
        known = registry.select(F.col("key").alias("_key"), F.col("enabled").alias("_enabled"))
        df = df.join(broadcast_within(known, BROADCAST_KEYS), "_key", "left")
    else:
        df = df.withColumn("_enabled", F.lit(None).cast("boolean"))
    is_global = F.lit(False) if not global_key else F.coalesce(F.col("_key") == global_key.strip(), F.lit(False))
    reason = (
        F.when(F.col("_key").isNull() | (F.length("_key") == 0), "missing")
        .when(is_global | F.coalesce("_enabled", F.lit(False)), F.lit(None))
        .when(F.col("_enabled").isNull(), "unknown")
        .otherwise("disabled")
    )
    return (
        df.withColumn("rejected_because", reason)
        .withColumn("accepted", F.col("rejected_because").isNull())
        .drop("_key", "_enabled")
    )


def record_usage(registry: DataFrame, uses: DataFrame) -> DataFrame:
    """Add the uses (key, ts) to usage_count and last_used; unknown keys are ignored."""
    per_key = uses.groupBy("key").agg(F.count("*").alias("_n"), F.max("ts").alias("_last"))
    return (
        registry.join(per_key, "key", "left")
        .withColumn("usage_count", (F.col("usage_count") + F.coalesce("_n", F.lit(0))).cast("bigint"))
        .withColumn("last_used", F.greatest("last_used", "_last"))
        .drop("_n", "_last")
    )


def key_summary(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.count("*").alias("total_keys"),
        F.count_if("enabled").alias("enabled_keys"),
        F.count_if(~F.col("enabled")).alias("disabled_keys"),
        F.coalesce(F.sum("usage_count"), F.lit(0)).cast("bigint").alias("total_usage"),
    )


def recent_keys(registry: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most recently used keys, shortened for display."""
    used = registry.where(F.col("last_used").isNotNull())
    return used.orderBy(F.desc("last_used"), "key").limit(n).select(
        key_preview(F.col("key")).alias("key"), "last_used", "usage_count"
    )


def list_keys(registry: DataFrame) -> DataFrame:
    return registry.withColumn("key", key_preview(F.col("key")))


def apply_changes(registry: DataFrame, changes: DataFrame, order: Sequence[str] = ("ts", "change_id")) -> DataFrame:
    """Registry after a change log (key, op, description, order columns).

    Operations are add, remove, enable and disable; adding a present key and switching an
    absent one do nothing. Per key only three things matter: the last removal, the first
    addition after it, and the last switch while the key was present - so the log is
    aggregated, never replayed.
    """
    at = F.struct(*order)
    log = changes.withColumn("_at", at).select("key", "op", "description", "_at")
    removed = log.groupBy("key").agg(F.max(F.when(F.col("op") == "remove", F.col("_at"))).alias("_removed"))
    after = salted_join(log, removed, ["key"], ["_at"]).where(
        F.col("_removed").isNull() | (F.col("_at") > F.col("_removed"))
    )
    is_add = F.col("op") == "add"
    added = after.groupBy("key").agg(
        F.min(F.when(is_add, F.col("_at"))).alias("_added"),
        F.min_by(F.when(is_add, F.col("description")), F.when(is_add, F.col("_at"))).alias("_description"),
    )
    base = registry.withColumn("_known", F.lit(True))
    state = (
        base.join(removed.join(added, "key", "left"), "key", "full_outer")
        .withColumn("_kept", F.coalesce("_known", F.lit(False)) & F.col("_removed").isNull())
        .withColumn("_from", F.when(~F.col("_kept"), F.col("_added")))
        .where(F.col("_kept") | F.col("_added").isNotNull())
    )
    switches = log.where(F.col("op").isin("enable", "disable"))
    counted = salted_join(switches, state.select("key", "_kept", "_from"), ["key"], ["_at"]).where(
        F.col("_kept") | (F.col("_at") > F.col("_from"))
    )
    last = counted.groupBy("key").agg(F.max_by("op", "_at").alias("_switch"))
    kept = F.col("_kept")
    return state.join(last, "key", "left").select(
        "key",
        F.when(kept, F.col("created_at")).otherwise(F.col(f"_added.{order[0]}")).alias("created_at"),
        F.when(kept, F.col("last_used")).alias("last_used"),
        F.when(kept, F.col("usage_count")).otherwise(F.lit(0)).cast("bigint").alias("usage_count"),
        F.when(kept, F.col("description")).otherwise(F.coalesce("_description", F.lit(""))).alias("description"),
        F.coalesce(F.col("_switch") == "enable", F.when(kept, F.col("enabled")), F.lit(True)).alias("enabled"),
    )


def transcripts(log: DataFrame, keys: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """(api_key, ts, request_id, user_question, model_answer) for the given keys, one row per
    request - a key's transcript may be of any length, so it is not gathered into an array."""
    if isinstance(keys, DataFrame):
        log = log.join(broadcast_within(keys.select("api_key").distinct(), BROADCAST_KEYS), "api_key", "left_semi")
    elif keys is not None:
        log = log.where(F.col("api_key").isin(list(keys)))
    return log.select(
        "api_key",
        "ts",
        "request_id",
        first_user_message(F.col("messages")).alias("user_question"),
        F.coalesce("response_content", F.lit("")).alias("model_answer"),
    )


def transcript_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("api_key").agg(F.count("*").alias("conversations"))


def outcome_counts(log: DataFrame) -> DataFrame:
    """Requests by deciding stage and finish reason."""
    error = F.coalesce("error", F.lit(""))
    stage = (
        F.when(F.startswith(error, F.lit(FRONT_BLOCK_PREFIX)), "front")
        .when(F.startswith(error, F.lit(POST_BLOCK_PREFIX)), "post")
        .when(F.length(error) > 0, "error")
        .otherwise("answered")
    )
    return log.groupBy(stage.alias("stage"), "finish_reason").agg(F.count("*").alias("requests"))
