"""The streaming answer gate: hold a streamed answer, audit it once, release or replace it.

Only the assembly of an answer needs state. The audit after it is row-local, so the same
gate expressions serve batch tables and streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.config import AUDIT_ERROR_MESSAGE, POST_THRESHOLD, SERVICE, STANDARD_REFUSAL
from wardline.functions.rows import explode_positions
from wardline.functions.text import is_blank, token_estimate
from wardline.operators import moderation as mod
from wardline.operators.scoring import Scorer
from wardline.streaming.lines import DONE, PREFIX, parse_lines, replacement_lines

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINE = "seq int, kind string, content string, finish_reason string, error string, line string, ms bigint"
#: What is kept of an answer beside its lines: where it ends, which lines are there (as first and
#: last number of each run), the timer that waits for more, and whether it has been given out.
HEADER = "end int, runs array<int>, due bigint, released boolean"
EVENT = """request_id string, what string, seq int, content string, finish_reason string, error string, status string,
n_lines int, first_ms bigint, last_ms bigint, finish_ms bigint, lines array<string>"""


def merged_runs(runs: list[int], numbers: list[int]) -> list[int]:
    """Runs [first, last, first, last, ...] of whole numbers with further numbers in them."""
    spans = sorted([*zip(runs[::2], runs[1::2], strict=True), *((n, n) for n in numbers)])
    out: list[int] = []
    for first, last in spans:
        if out and first <= out[-1] + 1:
            out[-1] = max(out[-1], last)
        else:
            out += [first, last]
    return out


def put_together(lines: list[tuple], end: int | None, status: str) -> tuple[dict, list[tuple]]:
    """An answer from its lines (as in ``LINE``) and the lines that are no part of it. Everything is
    decided by number: of several lines of one number the smallest counts, and none behind the end."""
    chosen: dict[int, tuple] = {}
    dropped = []
    for row in sorted(lines, key=lambda r: (r[0], [(x is not None, x or "") for x in r[1:6]], r[6])):
        if end is not None and row[0] > end:
            if row[1] != "done":
                dropped.append((row[0], "behind"))
        elif row[0] in chosen:
            dropped.append((row[0], "copy"))
        else:
            chosen[row[0]] = row
    used = list(chosen.values())
    last = chosen.get(end)
    answer = {
        "content": "".join(r[2] or "" for r in used),
        "finish_reason": last[3] if last else None,
        "error": last[4] if last else None,
        "status": "error" if last and last[4] else status,
        "n_lines": len(used),
        "first_ms": min(r[6] for r in used) if used else None,
        "last_ms": max(r[6] for r in used) if used else None,
        "finish_ms": last[6] if last else None,
        "lines": [r[5] for r in used if r[1] in ("delta", "error")],
    }
    return answer, dropped


def answer_events(lines: DataFrame, delay: str = "10 minutes", idle_seconds: int = 600) -> DataFrame:
    """The stream's answers and dropped lines, told apart by ``what``: ``answer``, ``behind`` (a line
    behind the end) and ``copy`` (a further line of one number).

    An answer is emitted once: when its end mark and every line before it have arrived - in any
    order, repeated or not - or as ``incomplete`` after ``idle_seconds`` of event time without
    one. Its lines are a list that only grows until then; each batch adds to it and reads nothing
    but a short header. After that the header alone is kept, until it times out as well, so
    stragglers cannot emit an answer again. State per request is bounded by its answer. The
    order in which lines arrive changes nothing but which batch emits them.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    parsed = parse_lines(lines.withWatermark("ts", delay)).where(F.col("kind") != "other")
    fields = [c.split()[0] for c in LINE.split(", ")]
    rows = parsed.withColumn("ms", F.unix_millis("ts")).select("request_id", "ts", *fields)
    names = [c.split()[0] for c in EVENT.replace("\n", " ").split(", ")]

    class Assembly(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.lines = handle.getListState("lines", LINE)
            self.header = handle.getValueState("header", HEADER)

        def close(self) -> None:
            pass

        def known(self) -> tuple:
            held = self.header.get()
            return (held[0], list(held[1]), held[2], held[3]) if held is not None else (None, [], None, False)

        def wait(self, due: int, before: int | None, timers) -> int:
            due = max(due, before or 0, timers.getCurrentWatermarkInMs() + 1)
            if due != before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(due)
            return due

        def events(self, key: tuple, answer: dict | None, dropped: list[tuple]) -> pd.DataFrame:
            out = [{"request_id": key[0], "what": "answer", **answer}] if answer else []
            out += [{"request_id": key[0], "what": why, "seq": seq} for seq, why in dropped]
            frame = pd.DataFrame(out, columns=names).astype(object)
            return frame.where(frame.notna(), None)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            fresh = [
                tuple(None if x is None or x != x else x for x in row)
                for batch in rows
                for row in zip(*(batch[c].tolist() for c in fields), strict=True)
            ]
            fresh = [(int(r[0]), *r[1:6], int(r[6])) for r in fresh]
            if not fresh:
                return
            end, runs, due, released = self.known()
            if released:
                late = [(r[0], "copy" if end is None or r[0] <= end else "behind") for r in fresh if r[1] != "done" or end is None or r[0] <= end]
                yield self.events(key, None, late)
                return
            ends = [r[0] for r in fresh if r[1] in ("done", "error") or r[3]]
            end = min([*ends, *([end] if end is not None else [])], default=None)
            runs = merged_runs(runs, [r[0] for r in fresh])
            due = self.wait(max(r[6] for r in fresh) + idle_seconds * 1000, due, timerValues)
            if end is not None and runs[0] == 0 and runs[1] >= end:
                answer, dropped = put_together([*map(tuple, self.lines.get()), *fresh], end, "complete")
                self.lines.clear()
                self.header.update((end, [], due, True))
                yield self.events(key, answer, dropped)
            else:
                self.lines.appendList(fresh)
                self.header.update((end, runs, due, False))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            end, _, due, released = self.known()
            if released:
                self.header.clear()
                return
            answer, dropped = put_together([*map(tuple, self.lines.get())], end, "incomplete")
            self.lines.clear()
            self.header.update((end, [], self.wait(due + idle_seconds * 1000, None, timerValues), True))
            yield self.events(key, answer, dropped)

    return rows.groupBy("request_id").transformWithStateInPandas(Assembly(), EVENT, "Append", "EventTime")


def assemble_stream(lines: DataFrame, delay: str = "10 minutes", idle_seconds: int = 600) -> DataFrame:
    """One row per streamed answer. ``last_ts`` is that of the last line that is part of it."""
    answers = answer_events(lines, delay, idle_seconds).where("what = 'answer'").drop("what", "seq")
    times = {f"{c}_ts": F.timestamp_millis(f"{c}_ms") for c in ("first", "last", "finish")}
    return answers.withColumns(times).drop("first_ms", "last_ms", "finish_ms")


def dropped_lines(lines: DataFrame, delay: str = "10 minutes", idle_seconds: int = 600) -> DataFrame:
    """(request_id, seq, what) of the lines that became no part of an answer."""
    return answer_events(lines, delay, idle_seconds).where("what <> 'answer'").select("request_id", "seq", "what")


def assemble_batch(lines: DataFrame) -> DataFrame:
    """The same rows from a finished table of lines; ``last_ts`` also counts lines behind the end."""
    once = parse_lines(lines).where(F.col("kind") != "other").groupBy("request_id", "seq").agg(
        F.min(F.struct("kind", "content", "finish_reason", "error", "line")).alias("r"), F.min("ts").alias("ts")
    )
    ends = (F.col("r.kind").isin("done", "error")) | F.col("r.finish_reason").isNotNull()
    last = F.struct("seq", F.col("r.finish_reason").alias("finish"), F.col("r.error").alias("error"), "ts")
    per = once.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "r"))).alias("_all"),
        F.min(F.when(ends, last)).alias("_end"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    used = F.filter("_all", lambda x: F.col("_end").isNull() | (x["seq"] <= F.col("_end.seq")))
    whole = F.col("_end").isNotNull() & (F.size("_used") == F.col("_end.seq") + 1)
    kept = F.filter("_used", lambda x: x["r"]["kind"].isin("delta", "error"))
    error = F.col("_end.error")
    return per.withColumn("_used", used).select(
        "request_id",
        F.array_join(F.transform("_used", lambda x: F.coalesce(x["r"]["content"], F.lit(""))), "").alias("content"),
        F.col("_end.finish").alias("finish_reason"),
        error.alias("error"),
        F.when(error.isNotNull(), "error").when(whole, "complete").otherwise("incomplete").alias("status"),
        F.size("_used").alias("n_lines"),
        "first_ts",
        "last_ts",
        F.col("_end.ts").alias("finish_ts"),
        F.transform(kept, lambda x: x["r"]["line"]).alias("lines"),
    )


def audit_answers(
    answers: DataFrame, scorer: Scorer, message: str = STANDARD_REFUSAL, threshold: float = POST_THRESHOLD
) -> DataFrame:
    """Add is_safe, blocked_because and the released lines to assembled answers.

    A blank answer is released unaudited. An answer over the threshold is replaced by
    ``message``; one that could not be scored is replaced too, saying so.
    """
    judged = mod.attach_sentences(answers, ["request_id"], "content", scorer, SERVICE, "_judged", every_score=False)
    failed = mod.has_scoring_error(F.col("_judged"))
    reason = (
        F.when(is_blank(F.col("content")), F.lit(None))
        .when(failed, "audit_error")
        .when(~mod.post_flag(F.col("_judged"), threshold), "audit")
    )
    created = F.unix_timestamp("last_ts")
    end = F.array(F.lit(PREFIX + DONE))
    instead = F.when(F.col("blocked_because") == "audit_error", F.lit(AUDIT_ERROR_MESSAGE)).otherwise(F.lit(message))
    return (
        judged.withColumn("blocked_because", reason)
        .withColumn("is_safe", F.col("blocked_because").isNull())
        .withColumn(
            "released",
            F.when(F.col("is_safe"), F.concat("lines", end)).otherwise(
                replacement_lines(F.col("request_id"), created, instead)
            ),
        )
        .drop("_judged", "lines")
    )


def completion_log(audited: DataFrame, until: str = "last_ts") -> DataFrame:
    """A log row per answer; failed streams count no tokens. The response time ends with the last
    line or, ``until="finish_ts"``, with the line that ends the answer where there is one."""
    ended = F.coalesce(until, "last_ts")
    ok = F.col("status") == "complete"
    return audited.select(
        "request_id",
        F.when(ok, F.col("content")).otherwise(F.lit("")).alias("response_content"),
        F.when(ok, token_estimate(F.col("content"))).otherwise(F.lit(0)).cast("bigint").alias("tokens_used"),
        (ended.cast("double") - F.col("first_ts").cast("double")).alias("response_time"),
        F.when(F.col("is_safe"), F.col("finish_reason")).otherwise("content_filter").alias("finish_reason"),
        F.when(ok, F.lit(None)).otherwise(F.coalesce("error", F.col("status"))).alias("error"),
    )


def released_rows(audited: DataFrame) -> DataFrame:
    """(request_id, pos, line) as sent to the caller."""
    return explode_positions(audited, ["request_id"], F.col("released"), "pos", "line")


def stream_gate(lines: DataFrame, scorer: Scorer, delay: str = "10 minutes", idle_seconds: int = 600) -> DataFrame:
    return audit_answers(assemble_stream(lines, delay, idle_seconds), scorer)
