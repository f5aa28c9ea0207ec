"""Starting streams, running totals, expiry, snapshots and a refreshed registry."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.config import REGISTRY_REFRESH_SECONDS
from wardline.operators.keys import verify_keys
from wardline.schemas import STREAM_LINE


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream lines from JSON files; in production a Kafka topic takes this place."""
    return spark.readStream.schema(STREAM_LINE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything there is, append the result to parquet files, and stop."""
    q = (
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).format("parquet").start(path)
    )
    q.awaitTermination()


def running_totals(turns: DataFrame, key: str) -> DataFrame:
    """Turns, tokens and last activity per session or user, kept up to date by a stream."""
    return turns.groupBy(key).agg(
        F.count("*").alias("total_turns"),
        F.sum("tokens_used").cast("bigint").alias("total_tokens"),
        F.max("ts").alias("last_active"),
    )


def write_updates(totals: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write the totals changed by each batch to a folder of that batch. A repeated batch
    replaces its own folder, so a restart changes nothing. ``every`` (such as 2 seconds)
    gathers changes for that long; without it all available input is processed once."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    writer = totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def latest_totals(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Current totals: per key the values of the last batch that changed them."""
    changes = spark.read.parquet(path)
    values = [c for c in changes.columns if c not in (key, "batch")]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(key, "_v.*")


def compact_totals(spark: SparkSession, path: str, key: str, snapshot: str) -> None:
    """Write current totals as one snapshot table."""
    latest_totals(spark, path, key).write.mode("overwrite").parquet(snapshot)


def expiring_sessions(turns: DataFrame, idle: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """Sessions as they expire: closed once the watermark is ``idle`` past their last turn,
    when their state goes as well."""
    w = F.session_window("ts", idle)
    return turns.withWatermark("ts", delay).groupBy(w.alias("_w"), "session_id").agg(
        F.count("*").alias("total_turns"),
        F.sum("tokens_used").cast("bigint").alias("total_tokens"),
        F.max("ts").alias("last_active"),
    ).drop("_w")


def with_registry(
    requests: DataFrame,
    load_registry: Callable[[], DataFrame],
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    refresh_seconds: float = REGISTRY_REFRESH_SECONDS,
    clock: Callable[[], float] = time.monotonic,
) -> StreamingQuery:
    """Verify the keys of a request stream; the registry is loaded again when the one in use
    is older than ``refresh_seconds``."""
    held: dict = {}

    def check(batch: DataFrame, batch_id: int) -> None:
        if not held or clock() - held["at"] >= refresh_seconds:
            held.update(at=clock(), registry=load_registry())
        sink(verify_keys(batch, held["registry"]), batch_id)

    return (
        requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(check)
        .trigger(availableNow=True).start()
    )


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a parquet sink has written so far; empty before its first file."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
