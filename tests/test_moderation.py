import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from wardline.config import GUARDRAIL, PAPER, SERVICE, WindowParams
from wardline.operators import moderation as mod
from wardline.operators.scoring import LexiconScorer, PandasScorer
from wardline.plans import gates

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEXICON = {"evil": 4000, "odd": 100, "meh": 3}
TEXTS = [
    "An evil sentence here. A fine one follows.",
    "Only an odd remark here. Fine again.",
    "Completely fine text. Nothing else.",
    "meh meh meh, that is it.",
    "tiny.",
    "",
    None,
    "这是 evil 的句子。这句没有问题的。",
    "Same sentence. Same sentence.",
    "EV*#IL in disguise.",
]


def lexicon_model():
    """The lexicon scorer restated for plain strings, as a model would be plugged in."""
    import re

    def score(texts):
        out = []
        for t in texts:
            w = sum(LEXICON.get(x, 0) for x in re.findall(r"\w+", t.lower()))
            p = w / (w + 100.0)
            out.append(("LABEL_0", p) if p >= 0.5 else ("LABEL_1", 1 - p))
        return out

    return score


def failing_model():
    def score(texts):
        raise RuntimeError("out of memory")

    return score


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def flags(df):
    return [r[0] for r in df.select("id", mod.judged_flag(F.col("judged")).alias("f")).orderBy("id").select("f").collect()]


@pytest.mark.parametrize(
    "thresholds, want",
    [
        (GUARDRAIL, [0, 2, 1, 2, 1, 1, 1, 0, 1, 0]),
        (SERVICE, [0, 2, 1, 1, 1, 1, 1, 0, 1, 0]),
        (PAPER, [0, 2, 1, 2, 1, 1, 1, 0, 1, 0]),
    ],
)
def test_flags_by_rule(texts, thresholds, want):
    scorer = LexiconScorer(LEXICON)
    for every in (True, False):
        judged = mod.attach_sentences(texts, ["id"], "text", scorer, thresholds, every_score=every)
        assert flags(judged) == want


@pytest.mark.parametrize(
    "label, score, want",
    [
        ("LABEL_0", 0.97, (0, 0, 0)), ("LABEL_0", 0.969, (2, 2, 0)), ("LABEL_0", 0.00002, (2, 1, 1)), ("LABEL_0", 0.92, (2, 2, 2)),
        ("LABEL_1", 0.965, (1, 1, 1)), ("LABEL_1", 0.95, (2, 1, 2)), ("LABEL_1", 0.5, (2, 1, 2)), ("LABEL_2", 0.99, (2, 1, 0)),
        (None, None, (0, 0, 0)),
    ],
)
def test_state_at_the_thresholds(spark, label, score, want):
    df = spark.createDataFrame([(label, score)], "l string, s double")
    cols = [mod.sentence_state(F.col("l"), F.col("s"), t).alias(f"t{i}") for i, t in enumerate((GUARDRAIL, SERVICE, PAPER))]
    assert tuple(df.select(*cols).first()) == want


def test_model_behind_pandas_gives_the_same_verdicts(texts):
    lists = gates.ServiceLists(["zzz"], ["odd"])
    a = gates.front_gate(texts, ["id"], "text", lists, LexiconScorer(LEXICON), detail=True).orderBy("id").collect()
    b = gates.front_gate(texts, ["id"], "text", lists, PandasScorer(lexicon_model), detail=True).orderBy("id").collect()
    assert a == b
    assert [r["stage"] for r in a] == [
        "sentence_model", "secondary_keyword", "passed", "passed", "passed", "input", "input", "sentence_model", "passed", "sentence_model",
    ]


def test_scoring_failure_blocks(texts):
    lists = gates.ServiceLists(["fine"], [])
    rows = gates.front_gate(texts, ["id"], "text", lists, PandasScorer(failing_model)).orderBy("id").collect()
    assert [r["stage"] for r in rows] == [
        "high_keyword", "high_keyword", "high_keyword", "gate_error", "passed", "input", "input", "gate_error", "gate_error", "gate_error",
    ]
    assert not any(r["is_safe"] for r in gates.post_gate(texts.where("id = 2"), ["id"], "text", PandasScorer(failing_model)).collect())


def test_model_sees_open_rows_only(spark, texts):
    """Rows decided by a keyword reach the scorer with no sentences at all."""
    lists = gates.ServiceLists(["evil"], [])
    rows = gates.front_gate(texts, ["id"], "text", lists, PandasScorer(lexicon_model), detail=True)
    decided = rows.where("stage = 'high_keyword'").select(F.size("sentence_scores").alias("n")).collect()
    assert decided and all(r["n"] == 0 for r in decided)


def test_last_of_duplicate_sentences_counts(spark):
    judged = spark.createDataFrame(
        [(1, [(0, "s", "LABEL_1", 0.9, 0.1, 1), (1, "t", "LABEL_1", 0.8, 0.2, 1), (2, "s", "LABEL_1", 0.7, 0.345, 1)])],
        "id int, judged array<struct<pos:int,sentence:string,label:string,score:double,p:double,state:int>>",
    )
    got = mod.attach_sentence_scores(judged, "judged", "m").first()["m"]
    assert {r["sentence"]: r["score"] for r in got} == {"s": 0.35, "t": 0.2}


def test_windows_stop_at_the_first_bad_one(spark):
    words = ["w"] * 20
    words[7], words[15] = "odd", "evil"
    df = spark.createDataFrame([(1, " ".join(words)), (2, "w w"), (3, "")], "id int, text string")
    out = mod.attach_window_scores(df, ["id"], "text", LexiconScorer(LEXICON), WindowParams(size=6, stride=3)).orderBy("id")
    rows = out.select(
        F.size("windows").alias("n"), mod.first_bad_window(F.col("windows")).alias("bad"),
        mod.highest_until_bad(F.col("windows")).alias("top"),
    ).collect()
    assert rows[0]["n"] == 6 and rows[0]["bad"]["window_no"] == 1 and rows[0]["top"] == 0.5
    assert rows[1]["bad"] is None and rows[1]["top"] == 0.0
    assert rows[2]["n"] == 0 and rows[2]["top"] == 0.0


def test_pair_cascade_stages(spark):
    rows = [
        (1, "a bad word.", "fine"), (2, "quite an evil thing.", "fine"), (3, "an odd maybe thing.", "fine"),
        (4, "an odd but fine thing.", "evil"), (5, "simply fine question.", "fine"), (6, "an odd outside thing.", "fine"),
        (7, "fine question here.", ""), (8, "a BAD word in capitals.", "fine"),
    ]
    df = spark.createDataFrame(rows, "id int, q string, a string")
    relevant = spark.createDataFrame([(6, False), (4, True)], "id int, is_relevant boolean")
    lists = gates.GuardrailLists(["bad"], ["maybe"])
    out = gates.moderate_pairs(df, ["id"], "q", "a", lists, LexiconScorer(LEXICON), relevance=relevant).orderBy("id").collect()
    assert [r["stage"] for r in out] == [
        "severe_keyword", "sentence_model", "moderate_keyword", "answer_audit", "passed", "out_of_domain", "passed", "passed",
    ]
    assert [r["verdict"] for r in out] == ["unsafe"] * 4 + ["safe", "unsafe", "safe", "safe"]
    same = gates.moderate_pairs(df, ["id"], "q", "a", lists, PandasScorer(lexicon_model), relevance=relevant).orderBy("id").collect()
    assert out == same


def test_pipeline_scorer(spark):
    from wardline.operators.scoring import PipelineScorer
    from wardline.operators.training import train_classifier

    rows = spark.createDataFrame(
        [("evil bad thing", 1), ("evil act", 1), ("nice day", 0), ("good thing", 0)] * 3, "text string, label int"
    )
    scorer = PipelineScorer(train_classifier(rows, 256))
    df = spark.createDataFrame([(1, "evil bad thing. nice day today."), (2, "")], "id int, text string")
    judged = mod.attach_sentences(df, ["id"], "text", scorer, SERVICE).orderBy("id").collect()
    assert [x["label"] for x in judged[0]["judged"]] == ["LABEL_0", "LABEL_1"] and judged[1]["judged"] == []


def test_front_gate_with_long_lists_and_pieces(spark, texts):
    many = ["evil"] + [f"unused{i}" for i in range(40)]
    short = gates.front_gate(texts, ["id"], "text", gates.ServiceLists(["evil"], ["odd"]), LexiconScorer(LEXICON))
    long_ = gates.front_gate(texts, ["id"], "text", gates.ServiceLists(many, many + ["odd"]), LexiconScorer(LEXICON))
    key = lambda df: [(r["id"], r["stage"]) for r in df.orderBy("id").collect()]
    assert key(short) == key(long_)
    pieces = mod.attach_character_windows(texts, ["id"], "text", LexiconScorer(LEXICON), 8).orderBy("id")
    ok = [r[0] for r in pieces.select(mod.pieces_pass(F.col("pieces"))).collect()]
    assert ok[0] is False and ok[2] is True and ok[5] is True
