"""Ordered positions and look-back inside groups that may hold a large share of all rows.

A window over such a group would put it into one task. Where a count shows a group too
large for that, rows are range-partitioned on (group, order), so that a large group
spreads over many partitions; the placement is written to the shared folder, which makes
it stable when executors are lost, and per-partition counts turn local positions into
global ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import materialise

HOT_ROWS = 500_000
BLOCK_ROWS = 100_000


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    counts = df.groupBy(*group).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def running_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group up to and including each row;
    ``order`` must be unique in a group."""
    if largest_group(df, group) <= hot_rows:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value.cast("bigint")).over(w))
    return _sum_by_ranges(df, group, order, value, out, hot_rows)


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "row_no", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the 1-based position of each row in its group."""
    return running_sum(df, group, order, F.lit(1), out, hot_rows)


def _sum_by_ranges(df, group, order, value, out, hot_rows) -> DataFrame:
    spark = df.sparkSession
    wanted = df.count() // hot_rows + 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)
    valued = df.withColumn("_value", value.cast("bigint"))
    placed = materialise(
        valued.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    sizes = placed.groupBy(*group, "_part").agg(F.sum("_value").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("_local", F.sum("_value").over(local)).alias("l")
    same = F.lit(True)
    for k in [*group, "_part"]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = numbered.join(offsets.alias("r"), same)
    return joined.select(*[f"l.{c}" for c in df.columns], (F.col("_before") + F.col("_local")).alias(out))


def with_previous(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    n: int,
    payload: Column,
    out: str = "previous",
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the payloads of up to ``n`` rows before each row of its group, oldest first.

    Large groups are cut into blocks of consecutive rows; the last ``n`` rows of a block
    are also handed to the next one, so every look-back is complete.
    """
    if largest_group(df, group) <= hot_rows:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-n, -1)
        return df.withColumn(out, F.collect_list(payload).over(w))
    block_rows = max(block_rows, n)
    numbered = number_rows(df, group, order, "_no", hot_rows)
    block = F.floor((F.col("_no") - 1) / block_rows)
    feeds_next = F.pmod(F.col("_no") - 1, F.lit(block_rows)) >= block_rows - n
    copies = numbered.withColumn("_home", block).withColumn(
        "_block", F.explode(F.when(feeds_next, F.array(block, block + 1)).otherwise(F.array(block)))
    )
    w = Window.partitionBy(*group, "_block").orderBy("_no").rowsBetween(-n, -1)
    looked = copies.withColumn(out, F.collect_list(payload).over(w))
    return looked.where(F.col("_home") == F.col("_block")).select(*df.columns, out)
