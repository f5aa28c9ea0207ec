import random

import pytest
from pyspark.sql import functions as F

from wardline.config import STANDARD_REFUSAL
from wardline.functions.messages import loss_labels, pad_and_cut, render_chat
from wardline.operators import rewards as R
from wardline.operators import training as T
from wardline.plans.rewards import score_rewards
from wardline.plans.training import prepare_classifier


@pytest.mark.parametrize(
    "answer, want",
    [
        (STANDARD_REFUSAL, "拒绝"), (f"  {STANDARD_REFUSAL}\n", "拒绝"), (STANDARD_REFUSAL + "更多", "直接回答"),
        ("对不起，我无法协助这个请求。请拨打110。", "正面引导"), ("对不起，我无法协助这个请求。", "直接回答"),
        ("抱歉，我不能提供这方面的信息。\n建议求助。", "正面引导"), ("好的，答案是 4。", "直接回答"), ("", "直接回答"),
    ],
)
def test_rule_judge(spark, answer, want):
    assert spark.range(1).select(R.rule_action(F.lit(answer))).first()[0] == want


@pytest.mark.parametrize(
    "output, parsed, action, three",
    [
        ("000", False, None, 1.0), ("111", False, None, 1.0), (None, False, None, 1.0), ("no json", False, None, 1.0),
        ('x {"model_action": "拒绝"} {"model_action": "直接回答"}', True, "拒绝", 1.0),
        ('{"model_action": null}', True, None, 1.0), ('{"other": 1}', False, None, 1.0), ('{"a": {"b": 1}}', False, None, 1.0),
        ('```json\n{"价值观": 2,\n"创造力": 1, "个性化": 0}\n```', False, None, 1.0), ('{"价值观": 2, "创造力": "x", "个性化": 0}', False, None, 0.0),
        ('{"价值观": 2, "创造力": 2, "个性化": 1}', False, None, 5 / 3), ('{"价值观": 2}', False, None, 1.0),
    ],
)
def test_judge_output(spark, output, parsed, action, three):
    df = spark.createDataFrame([(output,)], "o string")
    row = df.select(R.judged_action(F.col("o")).alias("j"), R.three_part_reward(F.col("o")).alias("t")).first()
    assert (row["j"]["parsed"], row["j"]["action"]) == (parsed, action)
    assert row["t"] == pytest.approx(three)


def test_reward_matrix(spark):
    actions = ["拒绝", "正面引导", "直接回答", "别的"]
    rows = [(e, a) for e in ("reject", "guide", "answer") for a in actions]
    df = spark.createDataFrame(rows, "e string, a string")
    got = [r[0] for r in df.select(R.reward(F.struct(F.lit(True).alias("parsed"), F.col("a").alias("action")), F.col("e"))).collect()]
    assert got == [2, 1, 0, 0, 1, 2, 0, 0, 0, 0, 2, 0]
    lost = F.struct(F.lit(False).alias("parsed"), F.lit(None).cast("string").alias("action"))
    assert df.select(R.reward(lost, F.col("e"))).first()[0] == 1


def test_missing_separator_gives_no_pair(spark):
    df = spark.createDataFrame([("q<|mid_token|>a<|mid_token|>b",), ("none",), ("<|mid_token|>",)], "t string")
    got = [r[0] for r in df.select(R.split_question_answer(F.col("t"))).collect()]
    assert [tuple(g) if g else None for g in got] == [("q", "a<|mid_token|>b"), None, ("", "")]


def test_external_judge_retries_failed_rows_only(spark, tmp_path):
    """Endpoint ``down`` always fails; a retry asks two endpoints at once and so succeeds."""
    calls = str(tmp_path)

    def make_client():
        import os
        import uuid

        def ask(prompt, endpoint, timeout):
            open(os.path.join(calls, f"{endpoint}-{prompt}-{uuid.uuid4().hex}"), "w").close()
            if endpoint == "down":
                raise ConnectionError("refused")
            return "000" if prompt == "p7" else '{"model_action": "拒绝"}'

        return ask

    df = spark.createDataFrame([(i, f"p{i}", "reject") for i in range(20)], "id int, prompt string, ground_truth string")
    out = R.judge_rows(df, ["id"], make_client, ["up", "down"], timeout=5, retry_timeout=5)
    rows = {r["id"]: r for r in out.collect()}
    assert len(rows) == 20 and {i for i, r in rows.items() if r["status"] == "failed"} == {7}
    assert {r["attempts"] for r in rows.values()} == {1, 2}
    scored = score_rewards(out.withColumn("question", F.lit("q")).withColumn("answer", F.lit("a")), output="judge_output")
    assert {r["id"]: r["reward"] for r in scored.collect()} == {i: 1 if i == 7 else 2 for i in range(20)}


def masked_by_rule(ids):
    """The mask restated: walk the message starts and note which stretches are not learned."""
    starts = [i for i in range(len(ids) - 1) if ids[i] == 151644 and ids[i + 1] != 77960]
    hidden = set()
    for n, at in enumerate(starts):
        if n < 2:
            hidden |= set(range(0, at + 3))
        elif n % 2 == 0:
            hidden |= set(range(starts[n - 1], at + 3))
    return [-100 if k in hidden else t for k, t in enumerate(ids)]


def test_loss_labels_of_random_ids(spark):
    rng = random.Random(9)
    rows = [[rng.choice([151644, 77960, 1, 2, 3]) for _ in range(rng.randrange(0, 30))] for _ in range(200)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, ids array<int>")
    got = [r[0] for r in df.select("i", loss_labels(F.col("ids")).alias("l")).orderBy("i").select("l").collect()]
    assert got == [masked_by_rule(r) for r in rows]


def test_padding_keeps_the_pad_as_label(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    row = df.select(pad_and_cut(F.col("ids"), F.col("ids"), 10).alias("r")).first()["r"]
    assert row["input_ids"] == row["labels"] == [1, 2, 3, 151643] and row["attention_mask"] == [1, 1, 1, 0] and row["aligned"]
    cut = df.select(pad_and_cut(F.col("ids"), F.col("ids"), 2).alias("r")).first()["r"]
    assert cut["input_ids"] == [1, 2] and cut["attention_mask"] == [1, 1]


def test_system_message_is_not_doubled(spark):
    df = spark.createDataFrame([([("system", "S"), ("user", "u")],), ([("user", "u")],)], "m array<struct<role:string,content:string>>")
    got = [r[0] for r in df.select(render_chat(F.col("m"), "D", True)).collect()]
    tail = "<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n"
    assert got == [f"<|im_start|>system\n{s}<|im_end|>\n{tail}" for s in "SD"]


@pytest.mark.parametrize("na, nb", [(7, 3), (3, 7), (4, 4), (1, 9)])
def test_interleaving_uses_up_both(spark, na, nb):
    frame = lambda n, tag: spark.createDataFrame([(f"{tag}{i}",) for i in range(n)], "id string")
    rows = T.interleave(frame(na, "a"), frame(nb, "b"), ["id"]).orderBy("round", "source").collect()
    m = max(na, nb)
    assert [r["id"] for r in rows] == [x for i in range(m) for x in (f"a{i % na}", f"b{i % nb}")]


def test_classifier_rows(spark):
    pos = spark.createDataFrame([(i, f"p {i}") for i in range(30)], "id int, text string")
    neg = spark.createDataFrame([(i + 100, f"n {i}") for i in range(10)], "id int, text string")
    rows = prepare_classifier(pos, neg, "id").collect()
    assert len(rows) == 60 and {r["split"] for r in rows} <= {"train", "validation", "test"}
    by_id = {}
    for r in rows:
        by_id.setdefault(r["id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by_id.values()), "repeats of a row share its split"
