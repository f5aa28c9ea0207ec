"""Sequences, sessions, users, keys and the chat batch."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.catalog import fixtures as fx
from wardline.operators import conversations as conv
from wardline.operators import keys as K
from wardline.operators.sequences import number_rows, running_sum, with_previous
from wardline.plans import chat
from wardline.plans.gates import ServiceLists

LISTS = ServiceLists(high=["zap"], secondary=["maybe"])


@pytest.fixture(scope="module")
def skewed(spark):
    """One session holds half of all turns, many of them at the same time."""
    rng = random.Random(3)
    rows = [(f"s{0 if rng.random() < 0.5 else rng.randrange(1, 9)}", rng.randrange(40), f"r{i:04d}", i % 3) for i in range(600)]
    return spark.createDataFrame(rows, "session string, t int, id string, v int")


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_large_groups_are_numbered_alike(skewed):
    plain = number_rows(skewed, ["session"], ["t", "id"], "n")
    split = number_rows(skewed, ["session"], ["t", "id"], "n", hot_rows=50)
    assert rows_of(plain) == rows_of(split)


def test_whole_table_is_numbered_without_a_group(skewed):
    got = number_rows(skewed, [], ["id"], "n", hot_rows=50).orderBy("id").collect()
    assert [r["n"] for r in got] == list(range(1, 601))


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, t int")
    for hot in (100, 1):
        got = {(r["g"], r["t"]): r["n"] for r in number_rows(df, ["g"], ["t"], "n", hot_rows=hot).collect()}
        assert got == {(None, 1): 1, (None, 2): 2, ("a", 3): 1}


def test_running_sums_agree(skewed):
    args = (["session"], ["t", "id"], F.col("v"), "s")
    assert rows_of(running_sum(skewed, *args)) == rows_of(running_sum(skewed, *args, hot_rows=50))


def test_look_back_crosses_blocks(skewed):
    payload = F.struct("t", "id")
    plain = with_previous(skewed, ["session"], ["t", "id"], 3, payload)
    for block in (3, 7, 100):
        split = with_previous(skewed, ["session"], ["t", "id"], 3, payload, hot_rows=50, block_rows=block)
        assert rows_of(plain) == rows_of(split)


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        ("s1", "ann", 1, "a", 10), ("s1", "bob", 2, "b", 20), ("s2", "bob", 3, "c", 30), ("s1", "bob", 4, "d", 40), ("s3", "cid", 5, "e", 0),
    ]
    df = spark.createDataFrame(rows, "session_id string, user_id string, m int, request_id string, tokens_used bigint")
    return df.select(
        "session_id", "user_id", F.timestamp_seconds(F.col("m") * 60).alias("ts"), "request_id", "tokens_used",
        F.concat(F.lit("q"), "request_id").alias("user_message"), F.concat(F.lit("a"), "request_id").alias("assistant_response"),
    )


def test_first_user_owns_and_guests_count_once_they_own(turns):
    users = {r["user_id"]: (r["total_sessions"], r["total_turns"], r["total_tokens"]) for r in conv.user_rollup(turns).collect()}
    assert users == {"ann": (1, 1, 10), "bob": (1, 2, 70), "cid": (1, 1, 0)}
    guests = {r["user_id"]: r["total_turns"] for r in conv.user_rollup(turns, count_guests=True).collect()}
    assert guests == {"ann": 1, "bob": 3, "cid": 1}


def test_touched_sessions_exist_without_turns(spark, turns):
    touch = spark.createDataFrame([("s9", "zoe", "z")], "session_id string, user_id string, request_id string").withColumn(
        "ts", F.timestamp_seconds(F.lit(600))
    )
    s = {r["session_id"]: r for r in conv.session_rollup(turns, touch).collect()}
    assert s["s9"]["total_turns"] == 0 and s["s9"]["user_id"] == "zoe" and s["s1"]["user_id"] == "ann"
    u = {r["user_id"]: r for r in conv.user_rollup(turns, touch).collect()}
    assert u["zoe"]["total_sessions"] == 1 and u["zoe"]["total_turns"] == 0


def test_history(turns):
    h = {r["session_id"]: [m["content"] for m in r["messages"]] for r in conv.session_history(turns, 2).collect()}
    assert h["s1"] == ["qb", "ab", "qd", "ad"]
    assert conv.history_rows(turns, 0).count() == 10
    with pytest.raises(ValueError):
        conv.session_history(turns, 0)


def test_unknown_last_activity_never_expires(spark):
    s = spark.createDataFrame([("a", "2024-01-01"), ("b", None), ("c", "2024-01-31")], "session_id string, d string").withColumn(
        "last_active", F.try_to_timestamp("d")
    )
    assert [r[0] for r in conv.expired_sessions(s, "2024-02-01", 30).select("session_id").collect()] == ["a"]
    assert sorted(r[0] for r in conv.live_sessions(s, "2024-02-01", 30).select("session_id").collect()) == ["b", "c"]


@pytest.fixture(scope="module")
def registry(spark):
    rows = [("k1", 3, True), ("k2", 0, False), ("k3", 1, True)]
    df = spark.createDataFrame(rows, "key string, usage_count bigint, enabled boolean")
    none = F.lit(None).cast("timestamp")
    return df.select("key", none.alias("created_at"), none.alias("last_used"), "usage_count", F.lit("old").alias("description"), "enabled")


def test_key_verification(spark, registry):
    sent = spark.createDataFrame([(" k1 ",), ("k2",), ("nope",), ("",), (None,), ("master",)], "api_key string")
    got = {r["api_key"]: r["rejected_because"] for r in K.verify_keys(sent, registry, global_key="master").collect()}
    assert got == {" k1 ": None, "k2": "disabled", "nope": "unknown", "": "missing", None: "missing", "master": None}
    assert K.verify_keys(sent, registry, use_registry=False).where("accepted").count() == 6
    only_global = K.verify_keys(sent, registry, global_key="master", use_registry=False)
    assert [r[0] for r in only_global.where("accepted").select("api_key").collect()] == ["master"]


def test_registry_changes_equal_replay(spark, registry):
    rng = random.Random(11)
    ops = [(f"k{rng.randrange(1, 7)}", rng.choice(["add", "remove", "enable", "disable"]), f"d{i}", i // 2, i) for i in range(200)]
    state = {r["key"]: [r["enabled"], r["description"], r["usage_count"]] for r in registry.collect()}
    for upto in (0, 1, 5, 17, 60, 200):
        replay = {k: list(v) for k, v in state.items()}
        for key, op, text, _, _ in ops[:upto]:
            if op == "add":
                replay.setdefault(key, [True, text, 0])
            elif op == "remove":
                replay.pop(key, None)
            elif key in replay:
                replay[key][0] = op == "enable"
        changes = spark.createDataFrame(ops[:upto], "key string, op string, description string, t int, change_id int").withColumn(
            "ts", F.timestamp_seconds("t")
        )
        got = {r["key"]: [r["enabled"], r["description"], r["usage_count"]] for r in K.apply_changes(registry, changes).collect()}
        assert got == replay


def test_usage_report(spark, registry):
    log = spark.createDataFrame(
        [("k1", "r1", 60, [("user", "hi")], "x"), ("k1", "r2", 120, [("system", "s")], None), ("k2", "r3", 9, [], "y")],
        "api_key string, request_id string, t int, messages array<struct<role:string,content:string>>, response_content string",
    ).withColumn("ts", F.timestamp_seconds("t"))
    report = chat.key_usage_report(log, registry)
    assert report["summary"].first().asDict() == {"total_keys": 3, "enabled_keys": 2, "disabled_keys": 1, "total_usage": 6}
    assert [tuple(r) for r in report["transcripts"].orderBy("ts").select("user_question", "model_answer").collect()] == [("hi", "x"), ("", "")]
    assert [r["key"] for r in report["recent"].collect()] == ["k1"]


def chat_tables(spark):
    rows = [
        # id, minute, key, user_id, user, session, context, turns, temperature, text, answer
        ("r1", 1, "k1", "u", None, "s", True, 5, 0.7, "first question here.", "first answer here."),
        ("r2", 2, "k1", "u", None, "s", True, 5, 0.7, "please zap now ok.", "never used."),
        ("r3", 3, "k1", "u", None, "s", True, 5, 0.7, "third question here.", "answer la la la with at."),
        ("r4", 4, "k1", "u", None, "s", True, 1, 0.7, "fourth question here.", "fourth answer here."),
        ("r5", 5, "k1", "u", None, "s", True, 1, 0.7, "fifth question here.", "fifth answer here."),
        ("r6", 6, "k1", "u", None, None, True, 5, 0.7, "no session given.", "lost."),
        ("r7", 7, "k2", "u", None, "s", True, 5, 0.7, "disabled key used.", "lost."),
        ("r8", 8, "k1", "", "", "s", True, 5, 0.7, "anonymous asks this.", "anonymous answer here."),
        ("r9", 9, "k1", "u", None, "s", False, 5, 0.7, "no context wanted.", "plain answer here."),
        ("r10", 10, "k1", "u", None, "s", True, None, None, "", "answer to nothing."),
        ("r11", 11, "k1", "u", None, "s", True, 5, 0.7, "backend fell silent.", None),
    ]
    df = spark.createDataFrame(
        rows,
        "request_id string, m int, api_key string, user_id string, user string, session_id string, enable_context boolean, "
        "max_context_turns int, temperature double, text string, answer string",
    ).withColumn("ts", F.timestamp_seconds(F.col("m") * 60))
    requests = df.drop("answer", "text", "m").join(
        df.select("request_id", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages")), "request_id"
    ).withColumn("model", F.lit("m"))
    responses = df.select(
        "request_id", F.col("answer").alias("response_content"), F.lit(7).cast("bigint").alias("tokens_used"),
        F.lit("stop").alias("finish_reason"), F.lit(0.5).alias("response_time"),
    )
    return requests, responses


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_chat_batch(spark, registry, hot_rows):
    requests, responses = chat_tables(spark)
    out = chat.moderate_chat(requests, responses, LISTS, fx.CHAT_SCORER, registry=registry, hot_rows=hot_rows)
    assert {r["request_id"]: r["reason"] for r in out.rejected.collect()} == {"r6": "session_id", "r7": "api_key disabled"}
    log = {r["request_id"]: r for r in out.log.collect()}
    assert set(log) == {"r1", "r2", "r3", "r4", "r5", "r8", "r9", "r10", "r11"}
    assert log["r2"]["error"].startswith("前拦截触发") and log["r2"]["context_messages"] == 0 and log["r2"]["tokens_used"] == 40
    assert log["r3"]["error"].startswith("后拦截触发") and log["r3"]["response_content"] == "answer la la la with at."
    assert log["r3"]["context_messages"] == 2 and log["r3"]["with_context"]
    assert [m["content"] for m in log["r4"]["sent_messages"]] == ["first question here.", "first answer here.", "fourth question here."]
    assert [m["content"] for m in log["r5"]["sent_messages"]] == ["fourth question here.", "fourth answer here.", "fifth question here."]
    assert log["r8"]["user_id"] == "anonymous" and log["r8"]["context_messages"] == 0
    assert log["r9"]["context_messages"] == 0 and not log["r9"]["with_context"]
    assert log["r10"]["context_messages"] == 6
    assert sorted(r["request_id"] for r in out.turns.collect()) == ["r1", "r10", "r4", "r5"]
    replies = {r["request_id"]: r["content"] for r in out.replies.collect()}
    assert replies["r3"] == replies["r2"] and replies["r1"] == "first answer here." and replies["r11"] is None


def test_chat_batch_with_retrieved_text(spark):
    requests, responses = chat_tables(spark)
    found = spark.createDataFrame([("r1", "fact"), ("r4", "fact"), ("r5", None)], "request_id string, rag_context string")
    out = chat.moderate_chat(requests, responses, LISTS, fx.CHAT_SCORER, retrieved=found)
    sent = {r["request_id"]: r["sent_messages"] for r in out.log.collect()}
    assert [m["role"] for m in sent["r1"]] == ["system", "user"] and "fact" in sent["r1"][1]["content"]
    assert len(sent["r4"]) == 3 and "fact" in sent["r4"][-1]["content"] and sent["r4"][0]["content"] == "first question here."
    assert sent["r5"][-1]["content"] == "fifth question here."
