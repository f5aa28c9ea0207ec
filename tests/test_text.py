import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.functions import messages as M
from wardline.functions import text as T


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


ODD = ["", " ", "\u3000全角\u3000", "\x1cx\x1f", "a\u00a0", "\u200bkept\u200b", "tab\t\n", "😀 a ", "plain"]


def test_strip_removes_what_python_strips(spark):
    assert column(spark, ODD, T.strip) == [x.strip() for x in ODD]


def test_cjk(spark):
    assert column(spark, ["abc", "炸", "か", "鿿", None], T.has_cjk) == [False, True, False, True, False]


def python_sentences(text):
    text = text.replace("*", "").replace("#", "")
    parts = [p.strip() for p in re.sub(r"([。.])", "\\1\0", text).split("\0")]
    return [p for p in parts if len(p) > 5]


CASES = [
    "第一句话很长。第二句也很长。短。", "No stop at all", "a.b.c.", "*#*#", "", "Wait... what is this. ",
    "\u3000\u3000开头有全角空格。  Then English.  ", "😀😀😀😀😀😀。tail",
]


def test_sentences(spark):
    assert column(spark, CASES, T.sentences) == [python_sentences(c) for c in CASES]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab 。.*#\n\u3000炸é😀_1", max_size=40), min_size=1, max_size=20))
def test_sentences_of_random_text(spark, texts):
    assert column(spark, texts, T.sentences) == [python_sentences(t) for t in texts]


def test_tokens_are_unicode_words(spark):
    got = column(spark, ["Été-où c'est l_x 12½ 炸弹"], T.tokens)[0]
    word = lambda c: c == "_" or unicodedata.category(c)[0] in "LN"
    want = [w for w in "".join(c if word(c) else " " for c in "Été-où c'est l_x 12½ 炸弹").split(" ") if w]
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 509, 510, 511, 766, 767, 1022, 1023, 5000])
def test_window_starts_follow_the_sliding_rule(spark, n):
    want, start = [], 0
    while start < n:
        want.append(start)
        if start + 510 >= n:
            break
        start += 256
    df = spark.range(1).select(T.window_starts(F.lit(n)).alias("s"))
    assert df.first()["s"] == want


def test_token_estimate(spark):
    values = ["", "one two three", "  a\u3000b ", "中文 abc", "x"]
    assert column(spark, values, T.token_estimate) == [0, 3, 2, 6, 1]


def test_fixed_length(spark):
    df = spark.createDataFrame([(["a"],), (list("abcdef"),)], "x array<string>")
    got = [r[0] for r in df.select(T.fixed_length(F.col("x"), 3)).collect()]
    assert sorted(got) == [["a", "[PAD]", "[PAD]"], ["a", "b", "c"]]


def test_clean_context(spark):
    values = ["", "a\n\n\n\nb\n a\nb\n\nc", "x" * 5000, "  \n ", "l1\nl1 \nl2"]
    cut = "x" * 4000 + "\n\n[检索结果过长，已截取前部分内容]"
    assert column(spark, values, M.clean_context) == ["暂无相关检索结果。", "a\n\nb\n\nc", cut, "", "l1\nl2"]


def test_result_text_takes_the_first_field_present(spark):
    fields = "content string, text string, document string, passage string, source string, url string, title string, score double, similarity double"
    rows = [[(None, "t", "d", None, None, "u", "x", None, 0.5), ("c", "t", None, None, "s", "u", None, 1.23456, None)]]
    df = spark.createDataFrame([rows], f"r array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    got = df.select(M.result_text(F.lit("q"), F.col("r"), F.create_map(F.lit("k"), F.lit("v"))).alias("t")).first()["t"]
    assert got == (
        "查询问题: q\n\n检索到2条相关信息:\n\n[结果1]\n内容: t\n链接: u\n相似度: 0.5000\n"
        "\n[结果2]\n内容: c\n来源: s\n相关度: 1.2346\n\n检索信息:\nk: v"
    )


def test_request_user_and_preview(spark):
    df = spark.createDataFrame([("u", "v"), ("", "v"), (None, "")], "a string, b string")
    assert [r[0] for r in df.select(M.request_user(F.col("a"), F.col("b"))).collect()] == ["u", "v", "anonymous"]
    assert column(spark, ["12345678", "123456789"], M.key_preview) == ["12345678", "12345678..."]


def test_safe_prompt_falls_back(spark):
    df = spark.createDataFrame([("q", "c", False), ("q", "c", True)], "q string, c string, failed boolean")
    got = [r[0] for r in df.select(M.safe_prompt(F.col("q"), F.col("c"), "<{context}|{query}>", "no {query}", F.col("failed"))).collect()]
    assert got == ["<c|q>", "no q"]


def test_apply_context_prompt(spark):
    df = spark.createDataFrame([([("user", "a")],), ([("user", "a"), ("user", "b")],)], "m array<struct<role:string,content:string>>")
    got = [[tuple(x) for x in r[0]] for r in df.select(M.apply_context_prompt(F.col("m"), F.lit("P"), F.lit(True), "S")).collect()]
    assert got == [[("system", "S"), ("user", "P")], [("user", "a"), ("user", "P")]]
    kept = df.select(M.apply_context_prompt(F.col("m"), F.lit(None).cast("string"), F.lit(True))).collect()
    assert [len(r[0]) for r in kept] == [1, 2]
