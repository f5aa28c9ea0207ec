"""Pluggable scorers: an array of texts in, an array of (label, score) out.

LABEL_0 is unsafe, LABEL_1 safe, and ``score`` is the confidence in the label.
Scoring works on the array inside its row, so no shuffle follows it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.patterns import contains_any
from wardline.functions.text import WORD

SCORE_TYPE = "array<struct<label:string,score:double>>"


class Scorer(Protocol):
    def attach(self, df: DataFrame, texts: str, out: str, ids: Sequence[str]) -> DataFrame:
        """Add column ``out`` of type ``SCORE_TYPE`` for the array column ``texts``."""

    def may_flag(self, text: Column) -> Column | None:
        """False only where every part of the text is certain to score as fully safe."""


class LexiconScorer:
    """Deterministic stand-in for a model: p = W / (W + 100) with W the summed weights
    of the lexicon words in the text. Built from expressions only."""

    def __init__(self, weights: Mapping[str, int]):
        self.by_weight: dict[int, list[str]] = {}
        for word, weight in sorted(weights.items()):
            self.by_weight.setdefault(int(weight), []).append(word.lower())
        self.words = sorted({w.lower() for w in weights})

    @staticmethod
    def _whole(words: Sequence[str]) -> Column:
        # words are plain text: what means something in a pattern is escaped
        plain = (re.sub(r"[^\w\s]", lambda m: "\\" + m[0], w) for w in words)
        return F.lit(f"(?<!{WORD})(?:{'|'.join(plain)})(?!{WORD})")

    def weight(self, text: Column) -> Column:
        low = F.lower(text)
        total = F.lit(0).cast("bigint")
        for weight, words in sorted(self.by_weight.items()):
            total = total + F.regexp_count(low, self._whole(words)).cast("bigint") * F.lit(weight).cast("bigint")
        # most texts hold no lexicon word: one search spares them the counting
        return F.when(F.regexp_like(low, self._whole(self.words)), total).otherwise(F.lit(0).cast("bigint"))

    def weights(self, texts: Column) -> Column:
        return F.transform(texts, self.weight)

    @staticmethod
    def verdicts(weights: Column) -> Column:
        def one(w: Column) -> Column:
            p = w / (w + F.lit(100.0))
            unsafe = p >= 0.5
            return F.struct(
                F.when(unsafe, F.lit("LABEL_0")).otherwise(F.lit("LABEL_1")).alias("label"),
                F.when(unsafe, p).otherwise(1 - p).alias("score"),
            )

        return F.transform(weights, one)

    def attach(self, df: DataFrame, texts: str, out: str, ids: Sequence[str]) -> DataFrame:
        return df.withColumn(out, self.verdicts(self.weights(F.col(texts))))

    def may_flag(self, text: Column) -> Column:
        low = F.lower(text)
        return contains_any(low, [F.lit(w) for w in self.words]) & F.regexp_like(low, self._whole(self.words))


def scored(model: Callable[[list[str]], list[tuple[str, float]]], texts: list[str]) -> list[tuple]:
    """One (label, score) per text. A call that fails or returns another number of results is
    halved down to single texts, so only texts that fail by themselves get (None, None)."""
    results: list[tuple] = []
    waiting = [texts] if texts else []
    while waiting:
        part = waiting.pop()
        try:
            found = [(label, score) for label, score in model(part)]
            if len(found) != len(part):
                raise ValueError(f"{len(found)} results for {len(part)} texts")
            results += found
        except Exception:  # the gate decides what an unscored text means
            if len(part) == 1:
                results.append((None, None))
            else:
                waiting += [part[len(part) // 2 :], part[: len(part) // 2]]
    return results


class PandasScorer:
    """A model behind a Pandas UDF. ``load`` runs once per worker and returns a function
    from a list of texts to a list of (label, score); all arrays of an Arrow batch are
    scored in one call. A text on which the model fails has a NULL score, which gates treat
    as blocked; the other texts of its batch are scored in smaller calls."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]):
        self.load = load

    def attach(self, df: DataFrame, texts: str, out: str, ids: Sequence[str]) -> DataFrame:
        load = self.load

        @F.pandas_udf(SCORE_TYPE)
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                flat = [t for row in batch for t in row]
                results = scored(model, flat)
                rows, at = [], 0
                for row in batch:
                    part = results[at : at + len(row)]
                    at += len(row)
                    rows.append([{"label": lab, "score": s} for lab, s in part])
                yield pd.Series(rows)

        return df.withColumn(out, scores(F.col(texts)))

    def may_flag(self, text: Column) -> None:
        return None


class PipelineScorer:
    """A fitted Spark ML pipeline with a ``probability`` output; class 1 is unsafe."""

    def __init__(self, model, text_col: str = "text"):
        self.model = model
        self.text_col = text_col

    def attach(self, df: DataFrame, texts: str, out: str, ids: Sequence[str]) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        parts = df.select(*ids, F.posexplode(texts).alias("_pos", self.text_col))
        p = vector_to_array("probability")[1]
        scored = self.model.transform(parts).select(
            *ids,
            "_pos",
            F.struct(
                F.when(p >= 0.5, F.lit("LABEL_0")).otherwise(F.lit("LABEL_1")).alias("label"),
                F.when(p >= 0.5, p).otherwise(1 - p).alias("score"),
            ).alias("_s"),
        )
        per_text = scored.groupBy(*ids).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_s"))), lambda x: x["_s"]).alias(out)
        )
        return df.join(per_text, list(ids), "left").withColumn(
            out, F.coalesce(out, F.array().cast(SCORE_TYPE))
        )

    def may_flag(self, text: Column) -> None:
        return None
