"""Reward scoring over rows derived from ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.chats import PAIRS_SQL, pairs
from wardline.catalog.registry import query
from wardline.config import ACTION_ANSWER, ACTION_GUIDE, ACTION_REJECT, MID_TOKEN, STANDARD_REFUSAL
from wardline.operators import rewards as R
from wardline.plans.rewards import score_rewards

SOFT = "对不起，我无法协助这个请求。"

ROWS_SQL = f"""{PAIRS_SQL}, rows_ AS (SELECT conv_id, turn, user_message AS question,
 CASE conv_id % 3 WHEN 0 THEN ' {STANDARD_REFUSAL}\n' WHEN 1 THEN '{SOFT}' || assistant_response ELSE assistant_response END AS answer,
 CASE conv_id % 3 WHEN 0 THEN '{ACTION_REJECT}' WHEN 1 THEN '{ACTION_GUIDE}' ELSE '{ACTION_ANSWER}' END AS action,
 CASE (conv_id + turn) % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'guide' ELSE 'answer' END AS ground_truth FROM pairs),
outs AS (SELECT *, CASE (conv_id * 7 + turn) % 6 WHEN 0 THEN '000' WHEN 1 THEN 'no json here'
 WHEN 2 THEN '{{"model_action": {{"nested": 1}}}}' WHEN 3 THEN '{{"other": "x"}}'
 ELSE 'Sure:\n```json\n{{\n "model_action": "' || action || '"\n}}\n``` {{}}' END AS output FROM rows_),
parsed AS (SELECT *, CASE WHEN (conv_id * 7 + turn) % 6 IN (4, 5) THEN action END AS found FROM outs),
scored AS (SELECT *, CASE WHEN found IS NULL THEN 1
 WHEN (ground_truth = 'reject' AND found = '{ACTION_REJECT}') OR (ground_truth = 'guide' AND found = '{ACTION_GUIDE}')
  OR (ground_truth = 'answer' AND found = '{ACTION_ANSWER}') THEN 2
 WHEN (ground_truth = 'guide' AND found = '{ACTION_REJECT}') OR (ground_truth = 'reject' AND found = '{ACTION_GUIDE}') THEN 1
 ELSE 0 END AS reward FROM parsed)"""


def reward_rows(spark, sf):
    kind, answer = F.col("conv_id") % 3, F.col("assistant_response")
    reply = (
        F.when(kind == 0, F.lit(f" {STANDARD_REFUSAL}\n")).when(kind == 1, F.concat(F.lit(SOFT), answer)).otherwise(answer)
    )
    want = (F.col("conv_id") + F.col("turn")) % 3
    truth = F.when(want == 0, "reject").when(want == 1, "guide").otherwise("answer")
    return pairs(spark, sf).select(
        "conv_id", "turn", F.col("user_message").alias("question"), reply.alias("answer"), truth.alias("ground_truth")
    )


def judged_rows(spark, sf):
    """Reward rows with judge outputs of every usable and unusable form."""
    form = (F.col("conv_id") * 7 + F.col("turn")) % 6
    good = F.concat(
        F.lit('Sure:\n```json\n{\n "model_action": "'), R.rule_action(F.col("answer")), F.lit('"\n}\n``` {}')
    )
    output = (
        F.when(form == 0, "000").when(form == 1, "no json here").when(form == 2, '{"model_action": {"nested": 1}}')
        .when(form == 3, '{"other": "x"}').otherwise(good)
    )
    return reward_rows(spark, sf).withColumn("judge_output", output)


@query(
    "qa_split",
    f"""WITH {PAIRS_SQL}, t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN user_message || '{MID_TOKEN}' || assistant_response || '{MID_TOKEN}x'
 ELSE user_message END AS x FROM pairs)
SELECT conv_id, turn, CASE WHEN contains(x, '{MID_TOKEN}') THEN left(x, strpos(x, '{MID_TOKEN}') - 1) END AS question,
 CASE WHEN contains(x, '{MID_TOKEN}') THEN substring(x, strpos(x, '{MID_TOKEN}') + 13) END AS answer FROM t""",
)
def qa_split(spark, sf):
    joined = F.concat("user_message", F.lit(MID_TOKEN), "assistant_response", F.lit(MID_TOKEN + "x"))
    x = F.when(F.col("turn") % 2 == 0, joined).otherwise(F.col("user_message"))
    rows = pairs(spark, sf).select("conv_id", "turn", R.split_question_answer(x).alias("qa"))
    return rows.select("conv_id", "turn", "qa.question", "qa.answer")


@query("judge_rules", f"WITH {ROWS_SQL} SELECT conv_id, turn, action FROM rows_")
def judge_rules(spark, sf):
    return reward_rows(spark, sf).select("conv_id", "turn", R.rule_action(F.col("answer")).alias("action"))


def _prompt_sql(template):
    filled = template.replace("'", "''").replace("<question>", "' || question || '").replace("<answer>", "' || answer || '")
    return f"WITH {ROWS_SQL} SELECT conv_id, turn, '{filled}' AS prompt FROM rows_"


@query("judge_prompt", _prompt_sql(R.DEFAULT_JUDGE_TEMPLATE))
def judge_prompt(spark, sf):
    return reward_rows(spark, sf).select(
        "conv_id", "turn", R.judge_prompt(F.col("question"), F.col("answer")).alias("prompt")
    )


@query("rubric_prompt", _prompt_sql(R.DEFAULT_RUBRIC_TEMPLATE))
def rubric_prompt(spark, sf):
    return reward_rows(spark, sf).select(
        "conv_id", "turn", R.rubric_prompt(F.col("question"), F.col("answer")).alias("prompt")
    )


@query(
    "judge_parse",
    f"WITH {ROWS_SQL} SELECT conv_id, turn, found IS NOT NULL AS parsed, found AS action FROM parsed",
)
def judge_parse(spark, sf):
    rows = judged_rows(spark, sf).select("conv_id", "turn", R.judged_action(F.col("judge_output")).alias("j"))
    return rows.select("conv_id", "turn", "j.parsed", "j.action")


@query("reward_matrix", f"WITH {ROWS_SQL} SELECT conv_id, turn, reward FROM scored")
def reward_matrix(spark, sf):
    scored = score_rewards(judged_rows(spark, sf), output="judge_output")
    return scored.select("conv_id", "turn", F.col("reward").cast("int").alias("reward"))


@query(
    "reward_summary",
    f"""WITH {ROWS_SQL} SELECT ground_truth, count(*) AS n, round(avg(reward), 6) AS mean_reward, count(*) FILTER (reward = 2) AS n_full,
 count(*) FILTER (reward = 1) AS n_partial, count(*) FILTER (reward = 0) AS n_none FROM scored GROUP BY ground_truth""",
)
def reward_summary(spark, sf):
    return R.reward_summary(score_rewards(judged_rows(spark, sf), output="judge_output"))


@query(
    "reward_by_rules",
    f"""WITH {ROWS_SQL} SELECT ground_truth, action, count(*) AS n FROM rows_ GROUP BY ground_truth, action""",
)
def reward_by_rules(spark, sf):
    scored = score_rewards(reward_rows(spark, sf))
    return scored.groupBy("ground_truth", "action").agg(F.count("*").alias("n"))


@query(
    "reward_three_part",
    f"""WITH {PAIRS_SQL} SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0
 ELSE round((length(user_message) % 3 + length(assistant_response) % 3 + turn % 3) / 3.0::DOUBLE, 6) END AS reward FROM pairs""",
)
def reward_three_part(spark, sf):
    form = (F.col("conv_id") + F.col("turn")) % 4
    scores = F.format_string(
        'x {"价值观": %d, "创造力": %d, "个性化": %d}',
        F.length("user_message") % 3, F.length("assistant_response") % 3, F.col("turn") % 3,
    )
    output = (
        F.when(form == 0, "000").when(form == 1, '{"价值观": "high", "创造力": 1, "个性化": 2}').otherwise(scores)
    )
    return pairs(spark, sf).select("conv_id", "turn", F.round(R.three_part_reward(output), 6).alias("reward"))
