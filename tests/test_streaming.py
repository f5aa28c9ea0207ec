import json
import random

import pytest
from pyspark.sql import functions as F

from wardline.config import AUDIT_ERROR_MESSAGE, STANDARD_REFUSAL
from wardline.operators.scoring import LexiconScorer, PandasScorer
from wardline.schemas import STREAM_LINE
from wardline.streaming import gate as G
from wardline.streaming import lines as L
from wardline.streaming import runs as R

SCORER = LexiconScorer({"evil": 4000})


def delta(content=None, finish=None):
    d = {} if content is None else {"content": content}
    return "data: " + json.dumps({"choices": [{"delta": d, "finish_reason": finish}]})


ANSWERS = {
    "ok": [delta("A fine "), delta("answer here.")] + [delta(None, "stop"), "data: [DONE]"],
    "bad": [delta("Some ev"), delta("il words here."), delta(None, "stop"), "data: [DONE]"],
    "blank": [delta("  "), delta(None, "stop"), "data: [DONE]"],
    "noise": [delta("Clean text"), "data: {broken", ": comment", delta(" it is."), delta(None, "length")],
    "fault": [delta("Half an answer"), 'data: {"error": {"message": "backend down", "code": 500}}'],
    "cut": [delta("Never finished"), delta(" evil text.")],
}


def rows(names=ANSWERS, minute=0):
    return [(n, i, line, minute * 60 + i) for n in names for i, line in enumerate(ANSWERS[n]) if line.startswith("data: ")]


def frame(spark, data):
    df = spark.createDataFrame(data, "request_id string, seq int, line string, t int")
    return df.select("request_id", "seq", "line", F.timestamp_seconds(F.col("t") + 1704067200).alias("ts"))


class Feed:
    """A folder of line files and the stream reading it, one run per call."""

    def __init__(self, spark, root, build):
        self.spark, self.root, self.build = spark, root, build

    def run(self, *batches):
        for b in batches:
            frame(self.spark, b).coalesce(1).write.mode("append").json(f"{self.root}/in")
            stream = self.build(R.read_lines(self.spark, f"{self.root}/in", 1))
            self.schema = stream.schema
            R.run_to_parquet(stream, f"{self.root}/out", f"{self.root}/checkpoint")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        return R.stored(self.spark, f"{self.root}/out", columns).collect()


def renumbered(data):
    """Lines numbered without the ones that are no data lines."""
    seen, out = {}, []
    for n, _, line, t in data:
        seen[n] = seen.get(n, -1) + 1
        out.append((n, seen[n], line, t))
    return out


HEARTBEAT = [("late", 0, delta("x"), 3600)]


def test_out_of_order_repeated_and_restarted(spark, tmp_path):
    data = renumbered(rows())
    data += data[::2]
    random.Random(1).shuffle(data)
    third = len(data) // 3
    feed = Feed(spark, tmp_path, lambda s: G.assemble_stream(s, "1 minute", 120))
    feed.run(data[:third], data[third : 2 * third], data[2 * third :])
    again = feed.run(data[:third])  # copies after the end must not emit an answer again
    assert sorted(r["request_id"] for r in again) == ["bad", "blank", "fault", "noise", "ok"]
    final = {r["request_id"]: r for r in feed.run(HEARTBEAT)}
    assert len(final) == 6
    assert final["cut"]["status"] == "incomplete" and final["cut"]["content"] == "Never finished evil text."
    assert final["ok"]["content"] == "A fine answer here." and final["ok"]["finish_reason"] == "stop" and final["ok"]["status"] == "complete"
    assert final["noise"]["content"] == "Clean text it is." and final["noise"]["finish_reason"] == "length"
    assert final["fault"]["status"] == "error" and final["fault"]["error"] == "backend down"


def test_stream_equals_batch(spark, tmp_path):
    data = renumbered(rows(["ok", "bad", "blank", "noise", "fault"]))
    streamed = Feed(spark, tmp_path, lambda s: G.assemble_stream(s)).run(data)
    batch = G.assemble_batch(frame(spark, data + data[:5])).collect()
    pick = lambda r: (r["request_id"], r["content"], r["finish_reason"], r["error"], r["status"], r["n_lines"], r["lines"])
    assert sorted(map(pick, streamed), key=str) == sorted(map(pick, batch), key=str)


def awkward():
    """Lines behind the end, errors and other ends behind it, copies, and an end that comes early."""
    data = renumbered(rows(["ok", "bad", "noise", "fault"]))
    data += [("ok", 4, delta("too late", "length"), 4), ("ok", 5, 'data: {"error": {"message": "behind"}}', 5)]
    data += [("fault", 2, delta("more"), 2), ("fault", 3, delta(None, "stop"), 3), ("bad", 6, "data: [DONE]", 6)]
    return data + data[::3]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_one_result(spark, tmp_path, seed):
    data, pick = awkward(), lambda r: tuple(r[c] for c in ("request_id", "content", "finish_reason", "error", "status", "n_lines", "lines", "finish_ts"))
    batch = sorted(map(pick, G.assemble_batch(frame(spark, data)).collect()), key=str)
    assert [b[2:5] for b in batch] == [("stop", None, "complete"), (None, "backend down", "error"), ("length", None, "complete"), ("stop", None, "complete")]
    random.Random(seed).shuffle(data)
    cut = sorted(random.Random(seed).sample(range(1, len(data)), 2))
    feed = Feed(spark, tmp_path, lambda s: G.assemble_stream(s))
    got = feed.run(data[: cut[0]], data[cut[0] : cut[1]], data[cut[1] :])
    assert sorted(map(pick, got), key=str) == batch


def test_dropped_lines_are_told(spark, tmp_path):
    data = awkward()
    random.Random(7).shuffle(data)
    got = Feed(spark, tmp_path, lambda s: G.dropped_lines(s)).run(data[:9], data[9:])
    end = {"ok": 2, "bad": 2, "noise": 3, "fault": 1}
    numbers = {}
    for n, seq, line, _ in data:
        numbers.setdefault((n, seq), []).append(line)
    want = []
    for (n, seq), lines in numbers.items():
        behind = seq > end[n]
        want += [(n, seq, "behind")] * len([x for x in lines if x != "data: [DONE]"]) if behind else [(n, seq, "copy")] * (len(lines) - 1)
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_runs_of_numbers():
    assert G.merged_runs([], [3, 1, 0]) == [0, 1, 3, 3]
    assert G.merged_runs([0, 1, 3, 3], [2, 2, 9]) == [0, 3, 9, 9]


def read_back(lines):
    text, finish = "", None
    for line in lines:
        if line != "data: [DONE]":
            c = json.loads(line[6:])["choices"][0]
            text, finish = text + c["delta"].get("content", ""), c["finish_reason"] or finish
    assert lines[-1] == "data: [DONE]"
    return text, finish


def test_gate_releases_or_replaces(spark, tmp_path):
    got = {r["request_id"]: r for r in Feed(spark, tmp_path, lambda s: G.stream_gate(s, SCORER)).run(renumbered(rows(["ok", "bad", "blank"])))}
    assert read_back(got["ok"]["released"]) == ("A fine answer here.", "stop") and got["ok"]["is_safe"]
    assert got["ok"]["released"][:2] == ANSWERS["ok"][:2]
    assert read_back(got["bad"]["released"]) == (STANDARD_REFUSAL, "content_filter") and got["bad"]["blocked_because"] == "audit"
    assert got["blank"]["is_safe"]
    chunks = [json.loads(x[6:]) for x in got["bad"]["released"][:-1]]
    assert chunks[0]["choices"][0]["delta"] == {"role": "assistant", "content": ""} and chunks[-1]["choices"][0]["delta"] == {}
    assert len(chunks) == len(STANDARD_REFUSAL) + 2 and {c["model"] for c in chunks} == {"safety-filter"}


def test_gate_fails_closed(spark):
    def load():
        def score(texts):
            raise RuntimeError("no model")

        return score

    audited = G.audit_answers(G.assemble_batch(frame(spark, renumbered(rows(["ok"])))), PandasScorer(load)).first()
    assert audited["blocked_because"] == "audit_error" and read_back(audited["released"])[0] == AUDIT_ERROR_MESSAGE


def test_completion_log(spark):
    audited = G.audit_answers(G.assemble_batch(frame(spark, renumbered(rows(["ok", "fault", "bad"])))), SCORER)
    log = {r["request_id"]: r for r in G.completion_log(audited).collect()}
    assert log["ok"]["tokens_used"] == 5 and log["ok"]["error"] is None and log["ok"]["response_time"] == 3.0
    assert log["fault"]["tokens_used"] == 0 and log["fault"]["error"] == "backend down" and log["fault"]["response_content"] == ""
    assert log["bad"]["finish_reason"] == "content_filter"


def test_line_kinds(spark):
    lines = ["data: [DONE]", "data:  [DONE] ", "data: {x", "event: y", delta("c"), 'data: {"choices": []}', 'data: {"error": {"message": "m"}}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = [tuple(r) for r in L.parse_lines(df).orderBy("i").select("kind", "content", "error").collect()]
    assert got == [
        ("done", None, None), ("done", None, None), ("malformed", None, None), ("other", None, None), ("delta", "c", None),
        ("delta", "", None), ("error", None, "m"),
    ]


def turn_stream(spark, root, data):
    df = spark.createDataFrame(data, "session_id string, t int, tokens_used bigint").withColumn("ts", F.timestamp_seconds("t"))
    df.coalesce(1).write.mode("append").parquet(f"{root}/turns")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/turns")


def test_totals_survive_a_restart(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    for data in ([("a", 1, 5), ("b", 2, 1)], [("a", 9, 7)]):
        totals = R.running_totals(turn_stream(spark, tmp_path, data), "session_id")
        R.write_updates(totals, out, checkpoint).awaitTermination()
    got = {r["session_id"]: (r["total_turns"], r["total_tokens"]) for r in R.latest_totals(spark, out, "session_id").collect()}
    assert got == {"a": (2, 12), "b": (1, 1)}
    R.compact_totals(spark, out, "session_id", str(tmp_path / "snapshot"))
    assert spark.read.parquet(str(tmp_path / "snapshot")).count() == 2


def test_debounced_updates(spark, tmp_path):
    totals = R.running_totals(turn_stream(spark, tmp_path, [("a", 1, 5)]), "session_id")
    q = R.write_updates(totals, str(tmp_path / "out"), str(tmp_path / "c"), every="1 second")
    q.processAllAvailable()
    q.stop()
    assert R.latest_totals(spark, str(tmp_path / "out"), "session_id").first()["total_tokens"] == 5


def test_sessions_expire_by_event_time(spark, tmp_path):
    day = 86400
    stream = turn_stream(spark, tmp_path, [("a", 0, 1), ("a", day, 1), ("b", 40 * day, 1), ("c", 80 * day, 1)])
    R.run_to_parquet(R.expiring_sessions(stream, "30 days"), str(tmp_path / "out"), str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["session_id"]: r["total_turns"] for r in rows} == {"a": 2, "b": 1}


@pytest.mark.parametrize("refresh, loads", [(0, 3), (300, 1)])
def test_registry_is_loaded_again_when_old(spark, tmp_path, refresh, loads):
    for i in range(3):
        spark.createDataFrame([(f"k{i}",)], "api_key string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("api_key string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    loaded, results = [], []

    def load():
        loaded.append(1)
        return spark.createDataFrame([("k0", True), ("k1", False)], "key string, enabled boolean")

    def sink(batch, batch_id):
        results.extend((r["api_key"], r["accepted"]) for r in batch.select("api_key", "accepted").collect())

    R.with_registry(stream, load, sink, str(tmp_path / "c"), refresh).awaitTermination()
    assert sorted(results) == [("k0", True), ("k1", False), ("k2", False)] and len(loaded) == loads


def test_line_schema_is_the_declared_one():
    assert STREAM_LINE == "request_id string, seq int, line string, ts timestamp"


def test_response_time_ends_with_the_finish_line_among_all_lines(spark):
    lines = ['{"choices": [{"delta": {"content": "Fine."}}]}', '{"choices": [{"delta": {}, "finish_reason": "stop"}]}', "[DONE]"]
    rows = [("a", seq, f"data: {line}", at) for seq, (line, at) in enumerate(zip(lines, (0, 4, 60), strict=True))]
    rows += [("a", 1, rows[1][2], 9), ("cut", 0, rows[0][2], 0), ("cut", 1, rows[0][2], 3)]
    df = spark.createDataFrame(rows, "request_id string, seq int, line string, t int").withColumn("ts", F.timestamp_seconds("t"))
    audited = G.audit_answers(G.assemble_batch(df), LexiconScorer({"evil": 200}))
    log = {r["request_id"]: r["response_time"] for r in G.completion_log(audited, "finish_ts").collect()}
    assert log == {"a": 4.0, "cut": 3.0}
