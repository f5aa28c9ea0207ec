"""Training sets from question/answer tables and labelled texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.messages import DEFAULT_SYSTEM
from wardline.functions.text import strip
from wardline.operators import training as T


def prepare_sft(
    df: DataFrame, ids: Sequence[str], question: str, answer: str, max_len: int = 2048, system: str = DEFAULT_SYSTEM, clean=strip
) -> DataFrame:
    """(ids, n_chars, input_ids, labels, attention_mask), shortest conversations first."""
    rows = T.order_by_length(T.sft_rows(df, question, answer, clean), ids)
    done = T.tokenise_chats(rows, system=system, max_len=max_len)
    return done.select(*ids, "n_chars", "row.input_ids", "row.labels", "row.attention_mask")


def prepare_classifier(positives: DataFrame, negatives: DataFrame, key: str, clean=None) -> DataFrame:
    """Interleaved (round, source, label, split) rows of two labelled text tables."""
    first, second = T.classifier_rows(positives, negatives)
    mixed = T.hash_split(T.interleave(first, second, [key]), key)
    return mixed if clean is None else mixed.withColumn("text", clean(F.col("text")))
