"""Joins whose result is aggregated on the same key again.

There the adaptive skew split would cost another shuffle and is not applied, so the rows
of a hot key are spread explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Sequence[str], salts: int = SALTS, how: str = "inner"
) -> DataFrame:
    """Join with each key of ``left`` spread over ``salts`` tasks; ``right`` is repeated for each."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
