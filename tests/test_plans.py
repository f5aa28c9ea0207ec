"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from wardline.catalog import QUERIES, fixtures as fx
from wardline.operators import conversations as conv
from wardline.operators import keywords as K
from wardline.plans import gates


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_front_gate_reads_two_columns_and_shuffles_nothing(documents):
    gated = gates.front_gate(documents, ["doc_id"], "text", fx.DOC_SERVICE, fx.DOC_SCORER).select("doc_id", "stage")
    p = plan(gated)
    assert "Exchange" not in p and "Python" not in p
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", p)


def test_front_gate_with_long_lists_shuffles_nothing(documents):
    many = [f"word{i}" for i in range(500)]
    gated = gates.front_gate(documents, ["doc_id"], "text", gates.ServiceLists(many, many), fx.DOC_SCORER)
    assert "Exchange" not in plan(gated)


def test_post_gate_and_pairs_shuffle_nothing(documents):
    assert "Exchange" not in plan(gates.post_gate(documents, ["doc_id"], "text", fx.DOC_SCORER))
    pairs = gates.moderate_pairs(documents, ["doc_id"], "text", "text", fx.DOC_GUARDRAIL, fx.DOC_SCORER)
    assert "Exchange" not in plan(pairs)


def test_role_filter_reaches_the_scan(spark, sf_dir):
    answers = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    p = plan(gates.post_gate(answers, ["conv_id", "turn"], "text", fx.CHAT_SCORER))
    assert "EqualTo(role,assistant)" in p


def test_long_sessions_are_cut_before_the_shuffle(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("request_id")
    )
    p = plan(conv.retained_turns(events, 50))
    assert p.index("Partial") > p.index("Exchange") and p.count("WindowGroupLimit") == 2


def test_long_keyword_lists_meet_texts_in_an_equi_join(spark, documents):
    words = spark.range(5000).select(F.concat(F.lit("word"), "id").alias("keyword"))
    for options in ({"use_automaton": False}, {"broadcast_rows": 10}):
        p = plan(K.keyword_hits(documents, words, ["doc_id"], **options))
        assert re.search("(BroadcastHash|SortMerge|ShuffledHash)Join", p) and "NestedLoop" not in p


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream", "file"))))
def test_no_query_compares_everything_with_everything(spark, sf_dir, name):
    p = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p
    assert "BatchEvalPython" not in p
