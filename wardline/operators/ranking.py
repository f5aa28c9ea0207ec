"""The best k per query: among rows of a table, and while blocks of scores go by inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per query with their rank from 1. Each task keeps its own best first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    best = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.withColumn("rank", F.col("rank").cast("bigint"))


class Best:
    """Running k best (query number, chunk id, score); ties by chunk id."""

    def __init__(self, k: int):
        self.k = k
        self.q, self.ids, self.score = np.empty(0, dtype=np.int64), None, np.empty(0)

    def add(self, scores: np.ndarray, ids: np.ndarray, positive: bool = False) -> None:
        """Take in a (queries x chunks) block; with ``positive`` zero scores are no hits."""
        nth = min(self.k, scores.shape[1])
        bar = np.partition(scores, -nth, axis=1)[:, -nth]
        hit = scores >= bar[:, None]
        if positive:
            hit &= scores > 0
        qi, di = np.nonzero(hit)
        self.ids = ids[di] if self.ids is None else np.concatenate([self.ids, ids[di]])
        self.q, self.score = np.concatenate([self.q, qi]), np.concatenate([self.score, scores[qi, di]])
        order = np.lexsort((self.ids, -self.score, self.q))
        q = self.q[order]
        keep = order[np.arange(len(q)) - np.searchsorted(q, q, side="left") < self.k]
        self.q, self.ids, self.score = self.q[keep], self.ids[keep], self.score[keep]
