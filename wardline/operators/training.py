"""Preparation of chat and classifier training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.config import IM_END, IM_START, IM_START_ID
from wardline.functions.messages import (
    DEFAULT_SYSTEM,
    conversation_length,
    loss_labels,
    pad_and_cut,
    qa_messages,
    render_chat,
)
from wardline.functions.rows import explode_structs
from wardline.functions.text import NON_WORD, WORD, strip
from wardline.operators.sequences import number_rows
from wardline.session import broadcast_within

IM_END_ID = 151645
VOCABULARY = 150_000
BROADCAST_ROWS = 100_000
CHAT_TOKEN = rf"(<\|im_start\|>|<\|im_end\|>|\n|{WORD}+|[^\p{{L}}\p{{N}}_\s])"


def hash_number(text: Column) -> Column:
    """The first 32 bits of the md5 as a number - stable over engines and runs."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def chat_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHAT_TOKEN), F.lit(1))


def token_id(token: Column) -> Column:
    """Default vocabulary: markers have their own ids, other tokens are hashed."""
    return (
        F.when(token == IM_START, IM_START_ID)
        .when(token == IM_END, IM_END_ID)
        .otherwise((hash_number(token) % VOCABULARY).cast("int"))
    )


def sft_rows(df: DataFrame, question: str = "question", answer: str = "answer", clean=strip) -> DataFrame:
    return df.withColumn("messages", qa_messages(F.col(question), F.col(answer), clean))


def order_by_length(df: DataFrame, ids: Sequence[str], messages: str = "messages") -> DataFrame:
    """Shortest conversations first; a global sort by range, so no task sees all rows."""
    return df.withColumn("n_chars", conversation_length(F.col(messages))).orderBy("n_chars", *ids)


def tokenise_chats(
    df: DataFrame, messages: str = "messages", system: str = DEFAULT_SYSTEM, max_len: int = 2048, tokenizer=chat_tokens, to_id=token_id
) -> DataFrame:
    """Add rendered text, tokens, ids, loss labels and the padded training arrays."""
    return (
        df.withColumn("rendered", render_chat(F.col(messages), system))
        .withColumn("tokens", tokenizer(F.col("rendered")))
        .withColumn("ids", F.transform("tokens", to_id))
        .withColumn("loss", loss_labels(F.col("ids")))
        .withColumn("row", pad_and_cut(F.col("ids"), F.col("loss"), max_len))
    )


def token_table(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ids, pos, token, id, label): tokens beside their labels, for inspection."""
    zipped = F.transform(
        F.arrays_zip("tokens", "ids", "loss"),
        lambda x, i: F.struct(
            i.cast("bigint").alias("pos"), x["tokens"].alias("token"), x["ids"].alias("id"), x["loss"].alias("label")
        ),
    )
    return explode_structs(df.withColumn("_z", zipped), ids, "_z", "pos")


def classifier_rows(positives: DataFrame, negatives: DataFrame) -> tuple[DataFrame, DataFrame]:
    return positives.withColumn("label", F.lit(1)), negatives.withColumn("label", F.lit(0))


def interleave(first: DataFrame, second: DataFrame, order: Sequence[str]) -> DataFrame:
    """Alternate two datasets until both are used up, starting the smaller one over.

    Adds ``round`` and ``source`` (0, 1), which order the result. Deterministic, where a
    random draw would not be. Repeats come from a join on the row number, so a small side
    is never multiplied inside one task.
    """
    a = number_rows(first, [], order, "_no")
    b = number_rows(second, [], order, "_no")
    na, nb = first.count(), second.count()
    if not na or not nb:
        raise ValueError("both datasets need rows")
    rounds = (a if na >= nb else b).select(F.col("_no").alias("round"))

    def side(df: DataFrame, n: int, source: int) -> DataFrame:
        if n == max(na, nb):
            placed = df.withColumnRenamed("_no", "round")
        else:
            again = rounds.withColumn("_no", F.pmod(F.col("round") - 1, F.lit(n)) + 1)
            placed = again.join(broadcast_within(df, BROADCAST_ROWS), "_no").drop("_no")
        return placed.withColumn("source", F.lit(source))

    return side(a, na, 0).unionByName(side(b, nb, 1))


def hash_split(df: DataFrame, key: str, train: int = 80, validation: int = 10) -> DataFrame:
    """Add ``split`` by a hash of the key: stable for a row, whatever else is in the data."""
    at = hash_number(F.col(key).cast("string")) % 100
    return df.withColumn(
        "split", F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test")
    )


def train_classifier(rows: DataFrame, features: int = 1 << 16, iterations: int = 20):
    """A hashed tf-idf logistic regression over (text, label); usable as a pipeline scorer."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_words", pattern=f"{NON_WORD}+", toLowercase=True),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol="label", maxIter=iterations, regParam=0.01),
        ]
    ).fit(rows)


def classifier_metrics(model, rows: DataFrame, by: str = "split") -> DataFrame:
    """Accuracy and mean log loss per split."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows)
    p = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    return scored.groupBy(by).agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"),
        F.round(F.avg(-F.log(F.greatest(p, F.lit(1e-15)))), 6).alias("loss"),
    )
