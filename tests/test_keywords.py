import re

import pytest
from pyspark.sql import functions as F

from wardline.functions.patterns import keyword_pattern
from wardline.operators import keywords as K

KEYWORDS = [
    "bomb", "Big Bang", "炸弹", "制造 毒品", "C++", "+x", "***", "no_go", "é", "ab", "a", "", "  ", "Σίγμας", "bomb", "x*y", "the best of", "stop", "kill",
]
TEXTS = [
    "a bomb here", "bombs away", "BOMB", "b-o-m-b", "big  bang", "Big\tBang!", "炸*弹", "炸 中 弹", "炸，弹。", "制造 毒品", "制造\u3000\u3000毒品",
    "C++ is", "C++x", "a+x", "q +x", "***", "* * *", "a***b", "no_go area", "no go", "café", "é", "ab", "a", "", "ΣΊΓΜΑΣ", "σίγμας",
    "x*y", "x y", "the  best\nof", "thebestof", "😀bomb😀", "übomb", "1bomb", "b_omb", "bo\u200bmb", "the Best of", "ſtop it", "S T O P", "KİLL", "kıll", "straße stop", "\u212aILL",
]


def python_pattern(keyword, style):
    if style == "auto" and not re.search("[一-鿿]", keyword):
        words = [re.escape(w) for w in keyword.split()]
        return r"\b" + r"\s+".join(words) + r"\b"
    return r"\W*".join(re.escape(c) for c in keyword)


def brute_force(style, ignore_case):
    flags = re.IGNORECASE if ignore_case else 0
    return {
        (i, k)
        for i, t in enumerate(TEXTS)
        for k in set(KEYWORDS)
        if k.strip() and re.search(python_pattern(k, style), t, flags)
    }


WAYS = {
    "inline": {},
    "automaton": {"inline_limit": 0},
    "anchors": {"inline_limit": 0, "use_automaton": False},
    "shuffled anchors": {"inline_limit": 0, "broadcast_rows": 3},
}


@pytest.fixture(scope="module")
def frames(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    return texts, spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("style, ignore_case", [("auto", False), ("characters", True), ("characters", False), ("auto", True)])
def test_hits_equal_brute_force(frames, way, style, ignore_case):
    texts, words = frames
    hits = K.keyword_hits(texts, words, ["id"], "text", style, ignore_case, **WAYS[way])
    rows = [(r["id"], r["keyword"]) for r in hits.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute_force(style, ignore_case)


@pytest.mark.parametrize("style, ignore_case", [("auto", False), ("characters", True)])
def test_row_local_matching_equals_brute_force(frames, style, ignore_case):
    texts, _ = frames
    m = texts.withColumn("m", K.matched_column(F.col("text"), KEYWORDS, style, ignore_case))
    want = brute_force(style, ignore_case)
    for r in m.collect():
        assert r["m"] == sorted(k for i, k in want if i == r["id"])


@pytest.mark.parametrize("style, ignore_case", [("auto", False), ("characters", True)])
def test_frequent_anchors_are_split(spark, frames, monkeypatch, style, ignore_case):
    """Every anchor that more than one in three texts of the sample has is dealt over parts."""
    texts, words = frames
    monkeypatch.setattr(K, "HOT_PARTS", 40)
    many = texts.unionByName(texts.withColumn("id", F.col("id") + 1000)).unionByName(
        spark.range(2000, 2060).select(F.col("id").cast("int"), F.lit("stop the bomb").alias("text"))
    )
    hits = K.keyword_hits(many, words, ["id"], "text", style, ignore_case, broadcast_rows=3, inline_limit=0)
    direct = K.keyword_hits(many, words, ["id"], "text", style, ignore_case)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, direct.collect()))


def test_keywords_are_filed_under_their_rarest_anchor(spark):
    texts = spark.createDataFrame([(i, "common words are common") for i in range(20)] + [(99, "common rarity")], "id int, text string")
    words = K.compile_keywords(spark.createDataFrame([("common rarity",), ("commonzzzz",)], "keyword string"), "characters", True)
    body = texts.select("id", F.col("text").alias("_text"), K.folded(F.col("text")).alias("_folded"))
    filed = K._filed(words, body, K.text_anchors(F.col("_text"), F.col("_folded"), K._anchor_kinds(words))).collect()
    assert {r["keyword"]: r["parts"] for r in filed} == {"common rarity": 4, "commonzzzz": 1}
    assert all(r["anchor"] not in ("g:comm", "g:ommo", "g:mmon") for r in filed)


def test_attach_agrees_for_long_lists(frames):
    texts, _ = frames
    short = K.attach_keywords(texts, KEYWORDS, ["id"], "text", "m").orderBy("id").collect()
    many = KEYWORDS + [f"unused{i}" for i in range(40)]
    for options in ({}, {"use_automaton": False}, {"broadcast_rows": 3}):
        longer = K.attach_keywords(texts, many, ["id"], "text", "m", **options).orderBy("id").collect()
        assert [r["m"] for r in short] == [r["m"] for r in longer]


def test_blank_keywords_have_no_pattern(spark):
    df = spark.createDataFrame([("",), ("  ",), ("a",)], "k string")
    assert [r[0] is None for r in df.select(keyword_pattern(F.col("k"))).collect()] == [True, True, False]


def test_no_keywords(frames):
    texts, words = frames
    assert K.keyword_hits(texts, words.limit(0), ["id"]).count() == 0
    assert K.attach_keywords(texts, [], ["id"], "text", "m").where(F.size("m") > 0).count() == 0


def test_categories(spark, frames):
    texts, _ = frames
    blacklist = {"arms": ["bomb", "炸弹"], "code": ["C++"]}
    rows = spark.createDataFrame([(c, s) for c, subs in blacklist.items() for s in subs], "category string, sub_keyword string")
    hits = {(r["id"], r["category"]) for r in K.category_hits(texts, rows, ["id"]).collect()}
    local = texts.withColumn("c", K.matched_categories_column(F.col("text"), blacklist)).collect()
    assert hits == {(r["id"], c) for r in local for c in r["c"]}
    assert (6, "arms") in hits and (11, "code") in hits


def test_settled_keywords_never_meet_the_text_again(spark):
    """Keywords that a token settles are joined on narrow rows, without patterns and texts."""
    body = spark.createDataFrame([(1, "one Two three"), (2, "two twofold"), (3, None), (4, "TWO one one")], "id int, text string")
    words = spark.createDataFrame([("one",), ("Two",), ("three",), ("absent",)], "keyword string")
    for limit in (100, 0):
        hits = K.keyword_hits(body, words, ["id"], inline_limit=0, broadcast_rows=limit, use_automaton=False)
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"RLIKE pattern#|Contains\(_folded", plan)
        assert sorted(map(tuple, hits.collect())) == [(1, "Two"), (1, "one"), (1, "three"), (4, "one")]


def test_automaton_takes_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(K, "TEXTS_AT_ONCE", 2)
    body = spark.createDataFrame([(i, f"one w{i % 3} x") for i in range(9)] + [(9, None)], "id int, text string").coalesce(1)
    words = spark.createDataFrame([("one",), ("w1",), ("none",)], "keyword string")
    hits = K.keyword_hits(body, words, ["id"], inline_limit=0)
    assert sorted(map(tuple, hits.collect())) == sorted([(i, "one") for i in range(9)] + [(i, "w1") for i in (1, 4, 7)])
