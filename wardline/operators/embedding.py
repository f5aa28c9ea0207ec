"""Pluggable embedders: a text column in, an ``array<double>`` column out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import lower_tokens


def vector_array(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow column of lists."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.astype("float64").ravel()))


class Embedder(Protocol):
    def attach(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class PrecomputedEmbedder:
    """Vectors that already are a column of the table."""

    def __init__(self, column: str = "embedding"):
        self.column = column

    def attach(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, F.col(self.column).cast("array<double>"))


class HashingEmbedder:
    """Counts of words hashed to ``dims`` buckets; deterministic and without a vocabulary."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def attach(self, df: DataFrame, text: str, out: str) -> DataFrame:
        dims = self.dims

        @F.arrow_udf("array<double>")
        def count_buckets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                # each distinct word of a batch is hashed once; nothing is kept from batch to batch
                coded = batch.flatten().dictionary_encode()
                places = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims for w in coded.dictionary.to_pylist()]
                bucket = np.array(places, dtype=np.int64)[coded.indices.to_numpy()]
                sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy()
                row = np.repeat(np.arange(len(batch)), sizes)
                yield vector_array(np.bincount(row * dims + bucket, minlength=len(batch) * dims).reshape(-1, dims))

        return df.withColumn(out, count_buckets(lower_tokens(F.col(text))))


class ModelEmbedder:
    """A model behind a Pandas UDF; ``load`` runs once per worker and returns a function
    from a list of texts to a 2-d array."""

    def __init__(self, load):
        self.load = load

    def attach(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load = self.load

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                yield pd.Series(list(np.asarray(model(batch.tolist()), dtype="float64")))

        return df.withColumn(out, embed(F.col(text)))


class TfIdfEmbedder:
    """Spark ML hashed term frequencies weighted by idf and normalised."""

    def __init__(self, dims: int = 256):
        self.dims = dims
        self.model = None

    def fit(self, corpus: DataFrame, text: str) -> "TfIdfEmbedder":
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import IDF, HashingTF, Normalizer

        stages = [
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=self.dims),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit"),
        ]
        self.model = Pipeline(stages=stages).fit(corpus.select(lower_tokens(F.col(text)).alias("_words")))
        return self

    def attach(self, df: DataFrame, text: str, out: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        fitted = self.model.transform(df.withColumn("_words", lower_tokens(F.col(text))))
        return fitted.withColumn(out, vector_to_array("_unit")).drop("_words", "_tf", "_idf", "_unit")
