"""Sinks. All of them write in parallel from where the rows are; none gathers first."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_request_log(log: DataFrame, path: str, ts: str = "ts") -> None:
    """Append log rows as JSON lines, one folder per day."""
    log.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").json(path)


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Replace the stored conversation tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))


def load_snapshot(spark, path: str, names=("turns", "sessions", "users")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(os.path.join(path, n)) for n in names}


def save_registry(registry: DataFrame, path: str) -> None:
    registry.write.mode("overwrite").json(path)


def save_chat_rows(rows: DataFrame, path: str, messages: str = "messages") -> None:
    """Conversations as JSON, one per line."""
    rows.select(messages).write.mode("overwrite").json(path)


def save_transcripts(rows: DataFrame, path: str) -> None:
    """One folder of JSON lines per key; a busy key simply has more files."""
    rows.write.mode("overwrite").partitionBy("api_key").json(path)
