"""Sentence tri-state, text flags and windowed answer audit - all row-local.

The sentences of a text stay in an array in their row, so a verdict needs no shuffle
and a later stage of a cascade is skipped by handing the scorer an empty array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.config import POST_THRESHOLD, Thresholds, WindowParams
from wardline.functions.rows import explode_structs
from wardline.functions.text import character_windows, drop_noise, sentences, token_windows, tokens
from wardline.operators.scoring import Scorer

BLOCK, PASS, GREY = 0, 1, 2


def unsafe_probability(label: Column, score: Column) -> Column:
    return F.when(label == "LABEL_1", 1 - score).otherwise(score)


def signed_score(label: Column, score: Column) -> Column:
    return F.when(label == "LABEL_1", score).otherwise(-score)


def sentence_state(label: Column, score: Column, t: Thresholds) -> Column:
    """0 blocked, 1 passed, 2 grey."""
    p = unsafe_probability(label, score)
    if t.rule == "guardrail":
        state = F.when((label == "LABEL_0") & (p >= t.high), BLOCK).when(
            (label == "LABEL_1") & (p <= t.low), PASS
        ).otherwise(GREY)
    elif t.rule == "service":
        state = F.when((label == "LABEL_0") & (score >= t.high), BLOCK).when(
            (label == "LABEL_0") & (score > t.low), GREY
        ).otherwise(PASS)
    elif t.rule == "paper":
        state = F.when(p > t.high, BLOCK).when(p > t.low, GREY).otherwise(PASS)
    else:
        raise ValueError(f"unknown rule {t.rule}")
    return F.when(score.isNull(), BLOCK).otherwise(state)


def text_flag(states: Column) -> Column:
    """Any blocked sentence blocks, else any grey one makes the text grey, else it passes."""
    return (
        F.when(F.array_contains(states, F.lit(BLOCK)), BLOCK)
        .when(F.array_contains(states, F.lit(GREY)), GREY)
        .otherwise(PASS)
    )


def flag_name(flag: Column) -> Column:
    return F.when(flag == BLOCK, "UNSAFE").when(flag == GREY, "UNCERTAIN").otherwise("SAFE")


def _beside(texts: str, name: str, verdicts: str) -> Column:
    """Each text paired with its verdict as (name, verdict)."""
    return F.zip_with(texts, verdicts, lambda t, v: F.struct(t.alias(name), v.alias("verdict")))


def attach_sentences(
    df: DataFrame,
    ids: Sequence[str],
    text: str,
    scorer: Scorer,
    thresholds: Thresholds,
    out: str = "judged",
    only_if: Column | None = None,
    every_score: bool = True,
) -> DataFrame:
    """Add ``out``: array of (pos, sentence, label, score, p, state).

    Rows failing ``only_if`` get an empty array and cost the scorer nothing. With
    ``every_score=False`` texts the scorer is certain about are skipped as well.
    """
    keep = only_if
    certain = None if every_score else scorer.may_flag(drop_noise(F.col(text)))  # as sentences are cut
    if certain is not None:
        keep = certain if keep is None else keep & certain
    parts = sentences(F.col(text))
    if keep is not None:
        parts = F.when(keep, parts).otherwise(F.array().cast("array<string>"))
    scored = scorer.attach(df.withColumn("_sentences", parts), "_sentences", "_scored", ids)
    rows = F.transform(
        _beside("_sentences", "sentence", "_scored"),
        lambda x, i: F.struct(
            i.alias("pos"),
            x["sentence"].alias("sentence"),
            x["verdict"]["label"].alias("label"),
            x["verdict"]["score"].alias("score"),
            unsafe_probability(x["verdict"]["label"], x["verdict"]["score"]).alias("p"),
            sentence_state(x["verdict"]["label"], x["verdict"]["score"], thresholds).alias("state"),
        ),
    )
    return scored.withColumn(out, rows).drop("_sentences", "_scored")


def judged_flag(judged: Column) -> Column:
    return text_flag(F.transform(judged, lambda x: x["state"]))


def has_scoring_error(judged: Column) -> Column:
    return F.exists(judged, lambda x: x["score"].isNull())


def bad_sentences(judged: Column) -> Column:
    """Blocked sentences in text order as (sentence, p)."""
    bad = F.filter(judged, lambda x: x["state"] == BLOCK)
    return F.transform(bad, lambda x: F.struct(x["sentence"].alias("sentence"), x["p"].alias("p")))


def attach_sentence_scores(df: DataFrame, judged: str, out: str, value: str = "p") -> DataFrame:
    """Add (sentence, score rounded to 2) per distinct sentence; of duplicates the last counts.

    Sorting brings duplicates together, so the cost stays n log n for very long texts.
    """
    by_sentence = F.array_sort(
        F.transform(judged, lambda x: F.struct(x["sentence"].alias("sentence"), x["pos"], x[value].alias("score")))
    )
    last = F.filter(
        "_by_sentence",
        lambda x, i: ~x["sentence"].eqNullSafe(F.get(F.col("_by_sentence"), i + 1)["sentence"]),
    )
    scores = F.transform(
        last, lambda x: F.struct(x["sentence"].alias("sentence"), F.round(x["score"], 2).alias("score"))
    )
    return df.withColumn("_by_sentence", by_sentence).withColumn(out, scores).drop("_by_sentence")


def sentence_rows(judged: DataFrame, ids: Sequence[str], column: str = "judged") -> DataFrame:
    return explode_structs(judged, ids, column, "pos")


def last_per_sentence(rows: DataFrame, ids: Sequence[str], value: str) -> DataFrame:
    """``sentence_scores`` in long form: duplicates resolved by aggregation."""
    return (
        rows.groupBy(*ids, "sentence")
        .agg(F.max_by(value, "pos").alias("score"))
        .withColumn("score", F.round("score", 2))
    )


def post_flag(judged: Column, threshold: float = POST_THRESHOLD) -> Column:
    """True when no sentence is LABEL_0 at or over the threshold, and all were scored."""
    return ~F.exists(judged, lambda x: _post_bad(x, threshold))


def _post_bad(x: Column, threshold: float) -> Column:
    return x["score"].isNull() | ((x["label"] == "LABEL_0") & (x["score"] >= threshold))


def post_bad_sentences(judged: Column, threshold: float = POST_THRESHOLD) -> Column:
    bad = F.filter(judged, lambda x: _post_bad(x, threshold))
    return F.transform(bad, lambda x: F.struct(x["sentence"].alias("sentence"), x["score"].alias("score")))


def attach_window_scores(
    df: DataFrame,
    ids: Sequence[str],
    text: str,
    scorer: Scorer,
    params: WindowParams = WindowParams(),
    out: str = "windows",
    only_if: Column | None = None,
    every_score: bool = True,
    tokenizer=tokens,
) -> DataFrame:
    """Add ``out``: array of (window_no, p) over the non-blank token windows of the text."""
    keep = only_if
    certain = None if every_score else scorer.may_flag(F.col(text))
    if certain is not None:
        keep = certain if keep is None else keep & certain
    toks = F.coalesce(tokenizer(F.col(text)), F.array().cast("array<string>"))
    if keep is not None:
        toks = F.when(keep, toks).otherwise(F.array().cast("array<string>"))
    cut = F.filter(
        token_windows(F.col("_tokens"), params.size, params.stride), lambda w: F.length(F.trim(w)) > 0
    )
    windowed = df.withColumn("_tokens", toks).withColumn("_window_texts", cut)
    scored = scorer.attach(windowed, "_window_texts", "_scored", ids)
    rows = F.transform(
        F.col("_scored"),
        lambda x, i: F.struct(i.alias("window_no"), unsafe_probability(x["label"], x["score"]).alias("p")),
    )
    return scored.withColumn(out, rows).drop("_tokens", "_window_texts", "_scored")


def first_bad_window(windows: Column, threshold: float = POST_THRESHOLD) -> Column:
    """The first window at or over the threshold or without a score; NULL when all pass."""
    return F.get(F.filter(windows, lambda w: w["p"].isNull() | (w["p"] >= threshold)), F.lit(0))


def highest_until_bad(windows: Column, threshold: float = POST_THRESHOLD) -> Column:
    """Highest score over the windows up to and including the first bad one; 0 without windows."""
    stop = first_bad_window(windows, threshold)["window_no"]
    seen = F.filter(windows, lambda w: stop.isNull() | (w["window_no"] <= stop))
    return F.coalesce(F.array_max(F.transform(seen, lambda w: w["p"])), F.lit(0.0))


def attach_character_windows(
    df: DataFrame, ids: Sequence[str], text: str, scorer: Scorer, size: int = 512, out: str = "pieces"
) -> DataFrame:
    """Add ``out``: array of (piece_no, length, label) over fixed, non-overlapping pieces."""
    cut = df.withColumn("_pieces", F.coalesce(character_windows(F.col(text), size), F.array().cast("array<string>")))
    scored = scorer.attach(cut, "_pieces", "_scored", ids)
    rows = F.transform(
        _beside("_pieces", "piece", "_scored"),
        lambda x, i: F.struct(
            i.alias("piece_no"), F.length(x["piece"]).alias("length"), x["verdict"]["label"].alias("label")
        ),
    )
    return scored.withColumn(out, rows).drop("_pieces", "_scored")


def pieces_pass(pieces: Column) -> Column:
    return ~F.exists(pieces, lambda x: x["label"].isNull() | (x["label"] == "LABEL_0"))
