"""Composite verdicts over tables of prompts and answers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.config import GUARDRAIL, SERVICE, RetrievalParams, Thresholds, WindowParams
from wardline.functions.messages import rag_messages, safe_prompt
from wardline.functions.text import strip
from wardline.operators import moderation as mod
from wardline.operators.embedding import Embedder
from wardline.operators.keywords import attach_keywords
from wardline.operators.scoring import Scorer
from wardline.plans.retrieval import hybrid_search, retrieved_text
from wardline.session import materialise


@dataclass(frozen=True)
class GuardrailLists:
    severe: Sequence[str]
    moderate: Sequence[str]


@dataclass(frozen=True)
class ServiceLists:
    high: Sequence[str]
    secondary: Sequence[str]


def secondary_keywords(blacklist: dict[str, Sequence[str]]) -> list[str]:
    """The distinct sub-keywords of a category blacklist."""
    return list(dict.fromkeys(k for subs in blacklist.values() for k in subs))


def _none() -> Column:
    return F.size("_matched_high") == 0


def moderate_pairs(
    pairs: DataFrame,
    ids: Sequence[str],
    question: str,
    answer: str,
    lists: GuardrailLists,
    scorer: Scorer,
    answer_scorer: Scorer | None = None,
    relevance: DataFrame | None = None,
    thresholds: Thresholds = GUARDRAIL,
    windows: WindowParams = WindowParams(),
) -> DataFrame:
    """Guardrail verdict of (question, answer) rows with the stage that decided.

    Severe keywords, then the sentence tri-state; grey questions face the moderate
    keywords and - when ``relevance`` (ids, is_relevant) is given - the relevance check;
    what is left has its answer audited. Each stage only works on rows still open.
    """
    df = attach_keywords(pairs, lists.severe, ids, question, "_matched_high")
    df = mod.attach_sentences(
        df, ids, question, scorer, thresholds, "_judged", only_if=_none(), every_score=False
    ).withColumn("_flag", mod.judged_flag(F.col("_judged")))
    grey = (F.size("_matched_high") == 0) & (F.col("_flag") == mod.GREY)
    df = df.withColumn("_grey_text", F.when(grey, F.col(question)).otherwise(F.lit("")))
    df = attach_keywords(df, lists.moderate, ids, "_grey_text", "_matched_moderate")
    if relevance is not None:
        df = df.join(relevance.select(*ids, F.col("is_relevant").alias("_relevant")), list(ids), "left")
    else:
        df = df.withColumn("_relevant", F.lit(True))
    stage = (
        F.when(F.size("_matched_high") > 0, "severe_keyword")
        .when(F.col("_flag") == mod.BLOCK, "sentence_model")
        .when(grey & (F.size("_matched_moderate") > 0), "moderate_keyword")
        .when(grey & ~F.coalesce("_relevant", F.lit(True)), "out_of_domain")
    )
    df = df.withColumn("_stage", stage)
    df = mod.attach_window_scores(
        df, ids, answer, answer_scorer or scorer, windows, "_windows",
        only_if=F.col("_stage").isNull(), every_score=False,
    )
    bad_answer = mod.first_bad_window(F.col("_windows"), windows.threshold).isNotNull()
    stage = F.when(F.col("_stage").isNull() & bad_answer, F.lit("answer_audit")).otherwise(F.col("_stage"))
    return (
        df.withColumn("stage", F.coalesce(stage, F.lit("passed")))
        .withColumn("verdict", F.when(F.col("stage") == "passed", "safe").otherwise("unsafe"))
        .withColumn("flag", F.when(F.size("_matched_high") == 0, F.col("_flag")))
        .drop("_matched_high", "_judged", "_flag", "_grey_text", "_matched_moderate", "_relevant", "_stage", "_windows")
    )


def front_gate(
    df: DataFrame,
    ids: Sequence[str],
    text: str,
    lists: ServiceLists,
    scorer: Scorer,
    thresholds: Thresholds = SERVICE,
    detail: bool = False,
) -> DataFrame:
    """Prompt gate: high-sensitivity keywords, sentence tri-state, and for grey texts the
    secondary keywords. Adds is_safe, stage and flag; ``detail`` adds matched keywords,
    bad sentences and the score of each sentence. Blank text is refused at stage ``input``."""
    df = df.withColumn("_clean", F.coalesce(strip(F.col(text)), F.lit("")))
    df = attach_keywords(df, lists.high, ids, "_clean", "_matched_high", "characters", True)
    df = mod.attach_sentences(
        df, ids, "_clean", scorer, thresholds, "_judged", only_if=_none(), every_score=detail
    ).withColumn("_flag", mod.judged_flag(F.col("_judged")))
    grey = (F.size("_matched_high") == 0) & (F.col("_flag") == mod.GREY)
    df = df.withColumn("_grey_text", F.when(grey, F.col("_clean")).otherwise(F.lit("")))
    df = attach_keywords(df, lists.secondary, ids, "_grey_text", "_matched_second", "characters", True)
    failed = mod.has_scoring_error(F.col("_judged"))
    stage = (
        F.when(F.length("_clean") == 0, "input")
        .when(F.size("_matched_high") > 0, "high_keyword")
        .when(failed, "gate_error")
        .when(F.col("_flag") == mod.BLOCK, "sentence_model")
        .when(grey & (F.size("_matched_second") > 0), "secondary_keyword")
        .when(grey, "passed_grey")
        .otherwise("passed")
    )
    df = (
        df.withColumn("stage", stage)
        .withColumn("is_safe", F.col("stage").isin("passed", "passed_grey"))
        .withColumn("flag", F.when(F.size("_matched_high") == 0, F.col("_flag")))
    )
    if detail:
        df = (
            df.withColumn("reason", front_reason(F.col("stage")))
            .withColumn(
                "matched_keywords",
                F.when(F.size("_matched_high") > 0, F.col("_matched_high")).otherwise(F.col("_matched_second")),
            )
            .withColumn("bad_sentences", mod.bad_sentences(F.col("_judged")))
        )
        df = mod.attach_sentence_scores(df, "_judged", "sentence_scores", "score")
    return df.drop("_clean", "_matched_high", "_judged", "_flag", "_grey_text", "_matched_second")


def front_reason(stage: Column) -> Column:
    """Readable reason of a front-gate stage."""
    return (
        F.when(stage == "input", "empty text")
        .when(stage == "high_keyword", "matched a high-sensitivity keyword")
        .when(stage == "gate_error", "a sentence could not be scored")
        .when(stage == "sentence_model", "a sentence is over the upper threshold")
        .when(stage == "secondary_keyword", "undecided, matched a secondary keyword")
        .when(stage == "passed_grey", "undecided, no secondary keyword")
        .otherwise("every sentence is under the lower threshold")
    )


def post_gate(
    df: DataFrame,
    ids: Sequence[str],
    text: str,
    scorer: Scorer,
    threshold: float = 0.5,
    detail: bool = False,
) -> DataFrame:
    """Answer gate: blocked when any sentence is LABEL_0 at or over the threshold."""
    df = df.withColumn("_clean", F.coalesce(strip(F.col(text)), F.lit("")))
    df = mod.attach_sentences(df, ids, "_clean", scorer, SERVICE, "_judged", every_score=detail)
    ok = (F.length("_clean") > 0) & mod.post_flag(F.col("_judged"), threshold)
    df = df.withColumn("is_safe", ok)
    if detail:
        df = df.withColumn("bad_sentences", mod.post_bad_sentences(F.col("_judged"), threshold))
        df = mod.attach_sentence_scores(df, "_judged", "sentence_scores", "score")
    return df.drop("_clean", "_judged")


def front_gate_with_context(
    df: DataFrame,
    key: str,
    text: str,
    lists: ServiceLists,
    scorer: Scorer,
    embedder: Embedder,
    chunks: DataFrame,
    index: dict[str, DataFrame] | None = None,
    params: RetrievalParams = RetrievalParams(),
    enabled: bool = True,
) -> DataFrame:
    """The prompt gate, then retrieval for what passed: adds rag_context, rag_used and
    prompt_messages. A prompt without any hit passes without context."""
    gated = front_gate(df, [key], text, lists, scorer)
    none = F.lit(None).cast("string")
    if not enabled:
        return gated.withColumn("rag_context", none).withColumn("rag_used", F.lit(False))
    gated = materialise(gated, "gated")  # retrieval must not judge the prompts again
    asked = gated.where("is_safe").select(F.col(key).alias("query_id"), F.col(text).alias("text"))
    hits = hybrid_search(asked, embedder, chunks if index is None else None, index, params)
    found = retrieved_text(hits, chunks if index is None else index["chunks"], asked)
    found = found.select(F.col("query_id").alias(key), F.col("context").alias("rag_context"))
    prompt = F.when(F.col("rag_used"), safe_prompt(F.col(text), F.col("rag_context")))
    return (
        gated.join(found, key, "left")
        .withColumn("rag_used", F.col("is_safe") & F.col("rag_context").isNotNull())
        .withColumn("prompt_messages", F.when(F.col("rag_used"), rag_messages(prompt)))
    )
