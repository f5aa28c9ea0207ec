"""Exploding arrays into rows.

The plain generators make Catalyst infer a ``size(array) > 0`` filter, which is pushed
below the projection and computes the array a second time. The outer generators do not;
the one NULL row they leave for an empty array is filtered out afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_structs(df: DataFrame, ids: Sequence[str], column: str | Column, marker: str) -> DataFrame:
    """One row per struct of the array; ``marker`` is a field that is never NULL in it."""
    return df.select(*ids, F.inline_outer(column)).where(F.col(marker).isNotNull())


def explode_values(df: DataFrame, ids: Sequence[str], values: Column, name: str) -> DataFrame:
    """One row per non-NULL element of the array."""
    return df.select(*ids, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def explode_positions(
    df: DataFrame, ids: Sequence[str], values: Column, pos: str, name: str
) -> DataFrame:
    """One row per element with its 0-based position as a bigint."""
    rows = df.select(*ids, F.posexplode_outer(values).alias(pos, name)).where(F.col(pos).isNotNull())
    return rows.withColumn(pos, F.col(pos).cast("bigint"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also when the body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
