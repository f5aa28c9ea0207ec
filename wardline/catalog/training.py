"""Chat and classifier training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog import sqltext as q
from wardline.catalog.chats import PAIRS_SQL, TURNS_SQL, pairs, turns
from wardline.catalog.registry import query, table
from wardline.functions import messages as M
from wardline.functions import text as TX
from wardline.operators import conversations as conv
from wardline.operators import training as T
from wardline.plans.training import prepare_classifier, prepare_sft
from wardline.session import materialise

IDS = ["conv_id", "turn"]
_RENDER = (
    "'<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || "
    + q.strip("user_message") + " || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || "
    + q.strip("assistant_response") + " || '<|im_end|>' || chr(10)"
)
_TOKEN_LIST = r"regexp_extract_all(rendered, '(<\|im_start\|>|<\|im_end\|>|\n|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])')"
_ID = (
    "CASE WHEN t = '<|im_start|>' THEN 151644 WHEN t = '<|im_end|>' THEN 151645 "
    "ELSE CAST(CAST('0x' || substr(md5(t), 1, 8) AS UBIGINT) % 150000 AS INTEGER) END"
)
CHATS_SQL = f"""{PAIRS_SQL}, r AS (SELECT conv_id, turn, length({q.strip('user_message')}) + length({q.strip('assistant_response')}) AS n_chars, {_RENDER} AS rendered FROM pairs),
tk AS (SELECT *, {_TOKEN_LIST} AS toks FROM r),
ti AS (SELECT *, list_transform(toks, lambda t: {_ID}) AS ids FROM tk),
st AS (SELECT *, list_filter(range(1, len(ids)), lambda i: ids[i] = 151644 AND ids[i + 1] <> 77960) AS starts FROM ti)"""


def _sft(spark, sf):
    return T.sft_rows(pairs(spark, sf), "user_message", "assistant_response")


@query(
    "sft_rows",
    f"WITH {PAIRS_SQL} SELECT conv_id, turn, 'user:' || {q.strip('user_message')} || '|assistant:' || {q.strip('assistant_response')} AS chat FROM pairs",
)
def sft_rows(spark, sf):
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return _sft(spark, sf).select(*IDS, F.array_join(said, "|").alias("chat"))


@query("chat_template", f"WITH {CHATS_SQL} SELECT conv_id, turn, rendered FROM r")
def chat_template(spark, sf):
    return _sft(spark, sf).select(*IDS, M.render_chat(F.col("messages")).alias("rendered"))


@query(
    "loss_mask",
    f"""WITH {CHATS_SQL} SELECT conv_id, turn, len(ids) AS n_tokens,
 array_to_string(list_transform(ids, lambda t, k: CASE WHEN k <= starts[3] + 2 THEN -100 ELSE t END), ',') AS labels FROM st""",
)
def loss_mask(spark, sf):
    done = T.tokenise_chats(_sft(spark, sf))
    return done.select(*IDS, F.size("ids").cast("bigint").alias("n_tokens"), F.array_join("loss", ",").alias("labels"))


_MULTI_SQL = f"""{TURNS_SQL}, r0 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, request_id) AS rn FROM turns),
ms AS (SELECT a.request_id, '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) ||
 string_agg('<|im_start|>user' || chr(10) || b.user_message || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || b.assistant_response || '<|im_end|>' || chr(10), '' ORDER BY b.rn) AS rendered
 FROM r0 a JOIN r0 b ON b.session_id = a.session_id AND b.rn >= a.rn - 2 AND b.rn <= a.rn GROUP BY a.request_id),
tk AS (SELECT *, {_TOKEN_LIST} AS toks FROM ms),
ti AS (SELECT *, list_transform(toks, lambda t: {_ID}) AS ids FROM tk),
st AS (SELECT *, list_filter(range(1, len(ids)), lambda i: ids[i] = 151644 AND ids[i + 1] <> 77960) AS starts FROM ti)"""


@query(
    "loss_mask_multi_turn",
    f"""WITH {_MULTI_SQL} SELECT request_id, len(starts) AS n_messages,
 array_to_string(list_transform(ids, lambda t, k: CASE WHEN k <= starts[3] + 2
  OR (len(starts) >= 5 AND k >= starts[4] AND k <= starts[5] + 2) OR (len(starts) >= 7 AND k >= starts[6] AND k <= starts[7] + 2) THEN -100 ELSE t END), ',') AS labels FROM st""",
)
def loss_mask_multi_turn(spark, sf):
    """Requests with two turns of context and their answer: only answers are learned."""
    sent = conv.with_context(turns(spark, sf), 2)
    full = F.concat("context", F.array(M.message("assistant", F.col("assistant_response"))))
    done = T.tokenise_chats(sent.select("request_id", full.alias("messages")))
    starts = F.size(F.filter("ids", lambda i: i == 151644)).cast("bigint")
    return done.select("request_id", starts.alias("n_messages"), F.array_join("loss", ",").alias("labels"))


@query(
    "pad_truncate",
    f"""WITH {CHATS_SQL} SELECT conv_id, turn, n_chars, array_to_string(list_append(ids, 151643)[1:64], ',') AS input_ids,
 array_to_string(list_append(list_transform(ids, lambda t, k: CASE WHEN k <= starts[3] + 2 THEN -100 ELSE t END), 151643)[1:64], ',') AS labels,
 CAST(least(len(ids), 64) AS BIGINT) AS attended FROM st""",
)
def pad_truncate(spark, sf):
    done = prepare_sft(pairs(spark, sf), IDS, "user_message", "assistant_response", max_len=64)
    attended = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return done.select(
        *IDS, "n_chars", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("labels", ",").alias("labels"),
        attended.cast("bigint").alias("attended"),
    )


@query(
    "token_label_table",
    f"""WITH {CHATS_SQL}, z AS (SELECT conv_id, turn, starts, unnest(range(len(ids))) AS pos, unnest(toks) AS token, unnest(ids) AS id FROM st)
SELECT conv_id, turn, pos, token, id, CASE WHEN pos + 1 <= starts[3] + 2 THEN -100 ELSE id END AS label FROM z""",
)
def token_label_table(spark, sf):
    return T.token_table(T.tokenise_chats(_sft(spark, sf)), IDS)


@query(
    "length_order",
    f"""WITH {CHATS_SQL} SELECT conv_id, turn, n_chars, row_number() OVER (ORDER BY n_chars, conv_id, turn) AS place FROM r""",
)
def length_order(spark, sf):
    from wardline.operators.sequences import number_rows

    ordered = T.order_by_length(_sft(spark, sf), IDS).select(*IDS, "n_chars")
    return number_rows(ordered, [], ["n_chars", *IDS], "place")


_LABELLED = "lab AS (SELECT doc_id, text, toxic FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id")


def _classifier_sets(spark, sf, *cols):
    both = _labelled(spark, sf)
    keep = ["doc_id", *cols]
    return both.where("toxic = 0").select(*keep), both.where("toxic = 1").select(*keep)


@query(
    "interleave_oversample",
    f"""WITH {_LABELLED}, a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM lab WHERE toxic = 0),
b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM lab WHERE toxic = 1),
n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb),
rounds AS (SELECT unnest(range(greatest(na, nb))) AS rd, na, nb FROM n)
SELECT rd + 1 AS round, 0 AS source, a.doc_id, 1 AS label FROM rounds JOIN a ON a.rn = rd % na
UNION ALL SELECT rd + 1, 1, b.doc_id, 0 FROM rounds JOIN b ON b.rn = rd % nb""",
)
def interleave_oversample(spark, sf):
    first, second = T.classifier_rows(*_classifier_sets(spark, sf))
    return T.interleave(first, second, ["doc_id"]).select("round", "source", "doc_id", "label")


@query(
    "hash_split",
    """SELECT doc_id, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'validation' ELSE 'test' END AS split FROM
 (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS UBIGINT) % 100 AS h FROM documents)""",
)
def hash_split(spark, sf):
    return T.hash_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "leading_clean",
    f"SELECT doc_id, {q.strip(f"regexp_replace(text, '^{q.WORD}{q.SPACE}', '')")} AS cleaned FROM documents",
)
def leading_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", TX.drop_leading_pair(F.col("text")).alias("cleaned"))


@query(
    "fixed_tokens",
    f"""WITH t AS (SELECT doc_id, {q.tokens('lower(text)')} AS toks FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, 257), lambda i: coalesce(toks[i], '[PAD]')), ' ') AS fixed FROM t""",
)
def fixed_tokens(spark, sf):
    fixed = TX.fixed_length(TX.lower_tokens(F.col("text")), 256)
    return table(spark, sf, "documents").select("doc_id", F.array_join(fixed, " ").alias("fixed"))


@query("classifier_metrics")
def classifier_metrics(spark, sf):
    """A classifier trained on the prepared rows, measured on every split."""
    rows = prepare_classifier(*_classifier_sets(spark, sf, "text"), "doc_id", TX.drop_leading_pair)
    # read by every pass of the training and by the measure, prepared once
    rows = materialise(rows.select("text", "label", "split"), "classifier")
    model = T.train_classifier(rows.where("split = 'train'"))
    return T.classifier_metrics(model, rows)
