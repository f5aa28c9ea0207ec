"""Readers with explicit schemas; bad input is set apart or skipped, never inferred away."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import schemas as S
from wardline.functions.rows import explode_structs, explode_values
from wardline.functions.text import strip
from wardline.operators.sequences import number_rows

log = logging.getLogger(__name__)


def _found(spark: SparkSession, path: str | None, load) -> DataFrame | None:
    """The loaded frame, or None with a warning when the path is missing or blank."""
    if not path:
        return None
    try:
        return load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log.warning("nothing found at %s", path)
        return None


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def keyword_list(spark: SparkSession, path: str | None, list_name: str = "keywords") -> DataFrame:
    """(list_name, keyword) from a JSON array, or an object with a ``keywords`` array.
    A missing file or bad JSON gives no keywords."""
    empty = spark.createDataFrame([], "list_name string, keyword string")
    raw = _found(spark, path, lambda p: _whole(spark, p))
    if raw is None:
        return empty
    wrapped = F.from_json("value", "struct<keywords:array<string>>")["keywords"]
    flat = F.from_json("value", "array<string>")
    words = explode_values(raw, [], F.coalesce(flat, wrapped), "keyword")
    return words.select(F.lit(list_name).alias("list_name"), "keyword").dropDuplicates()


def category_blacklist(spark: SparkSession, path: str | None) -> DataFrame:
    """(category, sub_keyword); entries without a name or without sub-keywords are skipped."""
    raw = _found(
        spark, path, lambda p: spark.read.schema("keyword string, sub_keywords array<string>").json(p, multiLine=True)
    )
    if raw is None:
        return spark.createDataFrame([], "category string, sub_keyword string")
    complete = raw.where(F.col("keyword").isNotNull() & F.col("sub_keywords").isNotNull())
    return explode_values(complete.withColumnRenamed("keyword", "category"), ["category"], F.col("sub_keywords"), "sub_keyword")


def knowledge_base(spark: SparkSession, path: str, min_length: int = 10) -> DataFrame:
    """(source, chunk): stripped lines over ``min_length`` of every .txt file below ``path``."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    return lines.select(F.col("_metadata.file_path").alias("source"), strip(F.col("value")).alias("chunk")).where(
        F.length("chunk") > min_length
    )


def jsonl_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_number, text, metadata) from JSON lines.

    A line may be an object with ``text``, a bare string, or any other JSON, which is kept
    as text itself. Blank and malformed lines are skipped but counted in the line number;
    scalar fields of an object become metadata.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        strip(F.col("value")).alias("_line"),
    )
    numbered = number_rows(raw, ["source"], ["_block", "_at"], "line_number")
    parsed = numbered.withColumn("_v", F.try_parse_json("_line")).where(
        (F.length("_line") > 0) & F.col("_v").isNotNull()
    )
    is_object = F.startswith(F.col("_line"), F.lit("{"))
    is_string = F.startswith(F.col("_line"), F.lit('"'))
    text = (
        F.when(is_object & F.array_contains(F.json_object_keys("_line"), F.lit("text")), F.get_json_object("_line", "$.text"))
        .when(is_string, F.try_variant_get("_v", "$", "string"))
        .otherwise(F.col("_line"))
    )
    kinds = F.from_json(F.when(is_object, F.col("_line")), "map<string,variant>")
    scalar = F.map_filter(
        kinds,
        lambda k, v: (k != "text") & ~F.regexp_like(F.schema_of_variant(v), F.lit("^(OBJECT|ARRAY|VOID)")),
    )
    metadata = F.transform_values(scalar, lambda k, v: F.try_variant_get(v, "$", "string"))
    return parsed.select(
        "source", "line_number", text.alias("text"),
        F.coalesce(metadata, F.create_map().cast("map<string,string>")).alias("metadata"),
    ).where(F.col("text").isNotNull())


def plain_document(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): a whole .txt or .md file as one document."""
    if not path.endswith((".txt", ".md")):
        raise ValueError(f"unsupported document format: {path}")
    return _whole(spark, path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents by suffix: JSON lines, or a plain file."""
    if path.endswith(".jsonl"):
        return jsonl_corpus(spark, path).select("source", "text")
    return plain_document(spark, path)


def request_log(spark: SparkSession, path: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of a JSON-lines request log; blank lines are skipped."""
    raw = _found(spark, path, lambda p: spark.read.text(p))
    if raw is None:
        return spark.createDataFrame([], S.REQUEST_LOG), spark.createDataFrame([], "line string")
    lines = raw.select(strip(F.col("value")).alias("line")).where(F.length("line") > 0)
    corrupt = F.try_parse_json("line").isNull() | ~F.startswith(F.col("line"), F.lit("{"))
    parsed = lines.where(~corrupt).select(F.from_json("line", S.REQUEST_LOG).alias("r")).select("r.*")
    return parsed, lines.where(corrupt)


def conversation_store(spark: SparkSession, path: str | None) -> dict[str, DataFrame]:
    """turns, sessions and users of a stored snapshot; an unreadable one counts as empty.
    Dates that cannot be parsed become NULL."""
    raw = _found(spark, path, lambda p: _whole(spark, p))
    if raw is None:
        raw = spark.createDataFrame([], "value string")
    store = raw.select(F.from_json("value", f"struct<{_typed(S.STORE)}>").alias("s"))
    sessions = explode_structs(store, [], F.map_entries("s.sessions"), "key").select("value.*").where(
        F.col("session_id").isNotNull()
    )
    users = explode_structs(store, [], F.map_entries("s.users"), "key").select("value.*").where(F.col("user_id").isNotNull())
    turns = explode_structs(sessions, ["session_id", "user_id"], "conversation_turns", "request_id")
    return {
        "turns": turns.withColumn("ts", F.try_to_timestamp("timestamp")).drop("timestamp"),
        "sessions": _dates(sessions.drop("conversation_turns"), "created_at", "last_active"),
        "users": _dates(users, "last_active"),
    }


def _typed(columns: str) -> str:
    """``a map<..>, b map<..>`` as struct fields."""
    return columns.replace("sessions map", "sessions:map").replace("users map", "users:map")


def _dates(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.try_to_timestamp(n))
    return df


def key_registry(spark: SparkSession, path: str | None, as_of: str) -> DataFrame:
    """Registry from a JSON list of keys or an object key -> attributes. Keys are stripped,
    blank ones dropped, missing attributes defaulted; ``as_of`` stands in for a missing
    creation time."""
    raw = _found(spark, path, lambda p: _whole(spark, p))
    if raw is None:
        return spark.createDataFrame([], S.REGISTRY)
    listed = F.transform(F.from_json("value", "array<string>"), lambda k: F.struct(k.alias("key"), F.lit(None).cast(S.KEY).alias("value")))
    detailed = F.map_entries(F.from_json("value", f"map<string,{S.KEY}>"))
    rows = raw.select(F.posexplode_outer(F.coalesce(listed, detailed)).alias("_pos", "_e")).where(F.col("_e.key").isNotNull())
    keyed = rows.select(strip(F.col("_e.key")).alias("key"), "_pos", F.col("_e.value").alias("_v")).where(F.length("key") > 0)
    last = keyed.groupBy("key").agg(F.max_by("_v", "_pos").alias("_v"))
    return last.select(
        "key",
        F.coalesce("_v.created_at", F.lit(as_of).cast("timestamp")).alias("created_at"),
        F.col("_v.last_used").alias("last_used"),
        F.coalesce("_v.usage_count", F.lit(0)).cast("bigint").alias("usage_count"),
        F.coalesce("_v.description", F.lit("")).alias("description"),
        F.coalesce("_v.enabled", F.lit(True)).alias("enabled"),
    )


def saved_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry as written by the registry sink."""
    return spark.read.schema(S.REGISTRY).json(path)


def question_answer_folder(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Question/answer rows of the JSON-lines files directly in a folder."""
    return spark.read.schema(S.QUESTION_ANSWER).option("pathGlobFilter", pattern).json(path)


def chat_training_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(conversations, unreadable): all files of a folder, each a JSON list of conversations."""
    files = _whole(spark, path).select(F.col("_metadata.file_path").alias("source"), "value")
    parsed = files.withColumn("_c", F.from_json("value", S.CONVERSATIONS))
    rows = explode_values(parsed, ["source"], F.col("_c"), "messages")
    return rows, parsed.where(F.col("_c").isNull()).select("source")


def labelled_texts(spark: SparkSession, positives: str, negatives: str) -> DataFrame:
    """(text, label) from one JSON-lines file per class."""
    one = spark.read.schema("text string").json(positives).withColumn("label", F.lit(1))
    zero = spark.read.schema("text string").json(negatives).withColumn("label", F.lit(0))
    return one.unionByName(zero)
