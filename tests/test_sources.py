import json

import pytest
from pyspark.sql import functions as F

from wardline.operators import keys as K
from wardline.sources import readers as R
from wardline.sources import writers as W


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "content, want",
    [
        (["b", "a", "b"], ["a", "b"]), ({"keywords": ["炸弹"]}, ["炸弹"]), ("{broken", []), ("[]", []), ({"other": 1}, []),
        ('[\n "a",\n "c"\n]', ["a", "c"]),
    ],
)
def test_keyword_list_shapes(spark, tmp_path, content, want):
    df = R.keyword_list(spark, put(tmp_path / "k.json", content), "severe")
    assert sorted(r["keyword"] for r in df.collect()) == want and df.columns == ["list_name", "keyword"]


def test_missing_files_are_empty(spark, tmp_path):
    gone = str(tmp_path / "none.json")
    for path in (gone, "", None):
        assert R.keyword_list(spark, path).count() == 0
        assert R.category_blacklist(spark, path).count() == 0
        assert R.request_log(spark, path)[0].count() == 0
        assert R.key_registry(spark, path, "2024-01-01").count() == 0
        assert R.conversation_store(spark, path)["sessions"].count() == 0


def test_blacklist_skips_incomplete_entries(spark, tmp_path):
    path = put(tmp_path / "b.json", [{"keyword": "x", "sub_keywords": ["1", "2"]}, {"keyword": "y"}, {"sub_keywords": ["3"]}, {"keyword": "z", "sub_keywords": []}])
    assert sorted(map(tuple, R.category_blacklist(spark, path).collect())) == [("x", "1"), ("x", "2")]


def test_knowledge_base_is_recursive_and_text_only(spark, tmp_path):
    put(tmp_path / "kb" / "a.txt", "  A line that is long enough  \nshort\n\n　another long enough line　")
    put(tmp_path / "kb" / "deep" / "b.txt", "a third line, long enough")
    put(tmp_path / "kb" / "c.md", "not a text file, although long")
    got = sorted(r["chunk"] for r in R.knowledge_base(spark, str(tmp_path / "kb")).collect())
    assert got == ["A line that is long enough", "a third line, long enough", "another long enough line"]


def test_jsonl_corpus_row_shapes(spark, tmp_path):
    lines = [
        '{"text": "one", "n": 3, "f": 1.5, "ok": true, "s": "{x", "list": [1], "nil": null, "o": {"a": 1}}', "", '"bare \\"string\\""',
        '{"title": "no text"}', "[1, 2]", "{broken", "   ", '{"text": "last"}',
    ]
    rows = {r["line_number"]: r for r in R.jsonl_corpus(spark, put(tmp_path / "c.jsonl", "\n".join(lines))).collect()}
    assert sorted(rows) == [1, 3, 4, 5, 8]
    assert rows[1]["text"] == "one" and rows[1]["metadata"] == {"n": "3", "f": "1.5", "ok": "true", "s": "{x"}
    assert rows[3]["text"] == 'bare "string"' and rows[5]["text"] == "[1, 2]" and rows[8]["text"] == "last"
    assert json.loads(rows[4]["text"]) == {"title": "no text"} and rows[4]["source"].endswith("c.jsonl")


def test_line_numbers_of_a_file_read_in_many_parts(spark, tmp_path):
    path = put(tmp_path / "big.jsonl", "\n".join(json.dumps({"text": f"line {i}", "i": i}) for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = R.jsonl_corpus(spark, path)
        assert df.where(F.col("line_number") != F.col("metadata")["i"].cast("bigint")).count() == 0 and df.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_plain_documents(spark, tmp_path):
    assert R.corpus(spark, put(tmp_path / "d.md", "a\nb")).first()["text"] == "a\nb"
    with pytest.raises(ValueError):
        R.corpus(spark, put(tmp_path / "d.pdf", "x"))


def test_request_log_sets_bad_lines_apart(spark, tmp_path):
    good = {"timestamp": "2024-01-01T10:00:00", "user_id": "u", "messages": [{"role": "user", "content": "你好"}], "parameters": {"stop": ["x"]}, "tokens_used": 3}
    path = put(tmp_path / "log", "\n".join([json.dumps(good, ensure_ascii=False), "", "{oops", "[1]", "  "]))
    rows, bad = R.request_log(spark, path)
    row = rows.first()
    assert rows.count() == 1 and row["messages"][0]["content"] == "你好" and row["parameters"]["stop"] == ["x"] and row["error"] is None
    assert sorted(r["line"] for r in bad.collect()) == ["[1]", "{oops"]


def test_conversation_store(spark, tmp_path):
    turn = {"timestamp": "2024-01-01T00:00:00", "request_id": "r", "user_message": "q", "assistant_response": "a", "tokens_used": 2}
    store = {
        "sessions": {"s": {"session_id": "s", "user_id": "u", "created_at": "2024-01-01T00:00:00", "last_active": "not a date", "total_turns": 1, "total_tokens": 2, "conversation_turns": [turn]}},
        "users": {"u": {"user_id": "u", "total_sessions": 1, "active_sessions": ["s"], "last_active": "2024-01-01T00:00:00"}},
    }
    got = R.conversation_store(spark, put(tmp_path / "store.json", store))
    session = got["sessions"].first()
    assert session["last_active"] is None and session["created_at"] is not None
    assert got["turns"].first()["user_message"] == "q" and got["users"].first()["active_sessions"] == ["s"]
    assert R.conversation_store(spark, put(tmp_path / "bad.json", "{"))["turns"].count() == 0


def test_registry_shapes(spark, tmp_path):
    listed = R.key_registry(spark, put(tmp_path / "l.json", [" k1 ", "", "k1", "k2"]), "2024-01-01").orderBy("key").collect()
    assert [(r["key"], r["usage_count"], r["enabled"], r["description"]) for r in listed] == [("k1", 0, True, ""), ("k2", 0, True, "")]
    assert str(listed[0]["created_at"]) == "2024-01-01 00:00:00"
    detail = {"k1": {"usage_count": 4, "enabled": False, "created_at": "2023-05-05T01:02:03", "last_used": None}, " ": {}, "k2": {}}
    rows = R.key_registry(spark, put(tmp_path / "d.json", detail), "2024-01-01").orderBy("key").collect()
    assert [(r["key"], r["usage_count"], r["enabled"]) for r in rows] == [("k1", 4, False), ("k2", 0, True)]
    assert str(rows[0]["created_at"]) == "2023-05-05 01:02:03"
    W.save_registry(spark.createDataFrame(rows, R.S.REGISTRY), str(tmp_path / "saved"))
    assert K.key_summary(R.saved_registry(spark, str(tmp_path / "saved"))).first()["total_usage"] == 4


def test_training_sources(spark, tmp_path):
    put(tmp_path / "qa" / "a.jsonl", '{"question": "q1", "answer": "a1"}\n{"question": "q2", "answer": "a2"}')
    put(tmp_path / "qa" / "deep" / "b.jsonl", '{"question": "no", "answer": "no"}')
    put(tmp_path / "qa" / "c.txt", "no")
    assert sorted(r["question"] for r in R.question_answer_folder(spark, str(tmp_path / "qa")).collect()) == ["q1", "q2"]
    put(tmp_path / "sft" / "1.json", [[{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]])
    put(tmp_path / "sft" / "2.json", "{broken")
    rows, unreadable = R.chat_training_folder(spark, str(tmp_path / "sft"))
    assert [len(r["messages"]) for r in rows.collect()] == [2] and unreadable.count() == 1
    pos, neg = put(tmp_path / "p.jsonl", '{"text": "good"}'), put(tmp_path / "n.jsonl", '{"text": "bad"}\n{"text": "worse"}')
    assert sorted(map(tuple, R.labelled_texts(spark, pos, neg).collect())) == [("bad", 0), ("good", 1), ("worse", 0)]
