"""Scorers: failing model calls, words that mean something in a pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators.scoring import LexiconScorer, PandasScorer


def test_only_the_failing_text_of_a_batch_is_unscored(spark):
    def fragile_model():
        def model(texts):
            if any("poison" in t for t in texts):
                raise RuntimeError
            kept = [t for t in texts if t != "short"]  # a result is missing
            return [("LABEL_0" if "bad" in t else "LABEL_1", len(t) / 100) for t in kept]

        return model

    texts = [["ok", "bad one"], ["poison"], [], ["fine", "poison too", "last"], ["short"], ["x", "short"]] + [[f"t{i}"] for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, parts array<string>").coalesce(1)
    got = PandasScorer(fragile_model).attach(df, "parts", "s", ["id"]).select("id", F.col("s")).collect()
    want = {
        i: [(None, None) if "poison" in t or t == "short" else ("LABEL_0" if "bad" in t else "LABEL_1", len(t) / 100) for t in row]
        for i, row in enumerate(texts)
    }
    assert {r["id"]: [tuple(x) for x in r["s"]] for r in got} == want


def test_lexicon_words_are_plain_text(spark):
    scorer = LexiconScorer({"a.b": 100, "f**k": 200, "c++": 300, "(x": 400})
    texts = ["a.b", "axb", "f**k you", "fk", "ffk", "c++", "see (x here", "A.B and a.b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {texts[r["id"]]: r["w"] for r in df.select("id", scorer.weight(F.col("t")).alias("w")).collect()}
    assert got == {"a.b": 100, "axb": 0, "f**k you": 200, "fk": 0, "ffk": 0, "c++": 300, "see (x here": 400, "A.B and a.b": 200}
