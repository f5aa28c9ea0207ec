"""Intermediate tables in the shared folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from wardline.session import materialise


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again. Spark drops the shuffle files of
    plans nobody refers to any more when the driver's memory is cleaned; that is asked for
    here, so a chain of large steps keeps the files of one step on disk, not of all."""
    spark = df.sparkSession
    out = materialise(df, name)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out
