"""Gapless numbers and running sums inside groups of any size, as expressions and joins.

Rows carry an order key that looks random (a digest), so the leading bits of the key cut
every group, however large, into blocks of bounded size that need no sampling: a window
runs inside one block, and the blocks' sums, a small table, give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 5_000
KEY_BITS = 32


def order_key(*columns: Column) -> Column:
    """A number of ``KEY_BITS`` bits from an MD5 digest; nulls count as empty strings."""
    plain = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(plain), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def block_bits(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """Leading bits of the key that leave about ``block_rows`` rows of all data in a block."""
    return min(KEY_BITS - 2, max(0, (rows // block_rows).bit_length()))


def sums_before(
    df: DataFrame, group: Sequence[str], key: str, ties: Sequence[str], value: Column, out: str, bits: int
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group that come before each row in the
    order of (``key``, ``ties``); rows equal in all of these come in any order."""
    cut = df.withColumns({"_block": F.shiftright(F.col(key), KEY_BITS - bits), "_value": value.cast("bigint")})
    same = ["_block", *group]
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*same).agg(F.sum("_value").alias("_n"))
    offsets = blocks.select(*same, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*same).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    joined = local.join(offsets, same)
    return joined.withColumn(out, F.col("_offset") + F.col("_local")).select(*df.columns, out)
