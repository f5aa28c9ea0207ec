"""Stream lines: parsing ``data: {...}`` lines and rendering replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.config import SAFETY_MODEL

PREFIX = "data: "
DONE = "[DONE]"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add kind (delta, done, error, malformed, other), content, finish_reason and error."""
    body = F.trim(F.substring("line", len(PREFIX) + 1, 1 << 30))
    df = lines.withColumn("_data", F.when(F.startswith(F.col("line"), F.lit(PREFIX)), body))
    valid = F.try_parse_json("_data").isNotNull()
    fault = F.get_json_object("_data", "$.error.message")
    kind = (
        F.when(F.col("_data").isNull(), "other")
        .when(F.col("_data") == DONE, "done")
        .when(~valid, "malformed")
        .when(fault.isNotNull(), "error")
        .otherwise("delta")
    )
    delta = F.col("kind") == "delta"
    return (
        df.withColumn("kind", kind)
        .withColumn("content", F.when(delta, F.coalesce(F.get_json_object("_data", "$.choices[0].delta.content"), F.lit(""))))
        .withColumn("finish_reason", F.when(delta, F.nullif(F.get_json_object("_data", "$.choices[0].finish_reason"), F.lit(""))))
        .withColumn("error", F.when(F.col("kind") == "error", fault))
        .drop("_data")
    )


def _line(chunk_id: Column, created: Column, role: Column | None, content: Column | None, finish: str | None) -> Column:
    fields = [] if role is None else [role.alias("role")]
    if content is not None:
        fields.append(content.alias("content"))
    delta = F.struct(*fields) if fields else F.create_map().cast("map<string,string>")
    choice = F.struct(
        F.lit(0).alias("index"), delta.alias("delta"), F.lit(finish).cast("string").alias("finish_reason")
    )
    chunk = F.struct(
        chunk_id.alias("id"),
        F.lit("chat.completion.chunk").alias("object"),
        created.alias("created"),
        F.lit(SAFETY_MODEL).alias("model"),
        F.array(choice).alias("choices"),
    )
    return F.concat(F.lit(PREFIX), F.to_json(chunk, {"ignoreNullFields": "false"}))


def replacement_lines(request_id: Column, created: Column, message: Column) -> Column:
    """Lines sent instead of a blocked answer: a role line, one line per character, a
    closing line with ``content_filter`` and the end mark."""
    cid = F.concat(F.lit("chatcmpl-"), request_id)
    chars = F.filter(F.split(message, ""), lambda c: F.length(c) > 0)
    return F.concat(
        F.array(_line(cid, created, F.lit("assistant"), F.lit(""), None)),
        F.transform(chars, lambda c: _line(cid, created, None, c, None)),
        F.array(_line(cid, created, None, None, "content_filter"), F.lit(PREFIX + DONE)),
    )


def answer_lines(answers: DataFrame, ids: list[str], text: str, size: int = 40) -> DataFrame:
    """(ids, seq, line): an answer cut into delta lines, a finish line and the end mark."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))

    def delta(content: Column, finish: Column) -> Column:
        choice = F.struct(F.struct(content.alias("content")).alias("delta"), finish.alias("finish_reason"))
        return F.concat(F.lit(PREFIX), F.to_json(F.struct(F.array(choice).alias("choices"))))

    none = F.lit(None).cast("string")
    lines = F.concat(
        F.transform(pieces, lambda p: delta(p, none)), F.array(delta(none, F.lit("stop")), F.lit(PREFIX + DONE))
    )
    return answers.select(*ids, F.posexplode(lines).alias("seq", "line"))
