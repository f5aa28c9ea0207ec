"""Batch reward scoring from prompts to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import rewards as R


def score_rewards(
    df: DataFrame, question: str = "question", answer: str = "answer", output: str | None = None
) -> DataFrame:
    """Add prompt, action and reward to (question, answer, ground_truth) rows.

    With ``output`` the judge's replies are parsed; without, the offline rules decide.
    """
    df = df.withColumn("prompt", R.judge_prompt(F.col(question), F.col(answer)))
    if output is None:
        judged = F.struct(F.lit(True).alias("parsed"), R.rule_action(F.col(answer)).alias("action"))
    else:
        judged = R.judged_action(F.col(output))
    df = df.withColumn("_judged", judged)
    return (
        df.withColumn("action", F.col("_judged.action"))
        .withColumn("reward", R.reward(F.col("_judged"), F.col("ground_truth")))
        .drop("_judged")
    )
