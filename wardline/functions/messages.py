"""Chat messages, prompts and request fields as Column expressions.

Messages are ``array<struct<role,content>>``. Prompt wording is a parameter everywhere;
the templates here are short defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import config as C
from wardline.config import (
    IGNORE_LABEL,
    IM_END,
    IM_START,
    IM_START_EXCEPTION_ID,
    IM_START_ID,
    MAX_CONTEXT_CHARS,
    NO_RESULT_TEXT,
    PAD_ID,
    SAFETY_MODEL,
    STANDARD_REFUSAL,
    TRUNCATED_NOTICE,
)
from wardline.functions.rows import let
from wardline.functions.text import strip

DEFAULT_SYSTEM = "You are a helpful assistant."
DEFAULT_SAFE_SYSTEM = "You answer strictly within the law and only from the retrieved text."
DEFAULT_SAFE_TEMPLATE = (
    "Answer only from the retrieved text below, add nothing to it, and refuse unlawful requests "
    "with an explanation and a lawful alternative.\n\nRetrieved text:\n{context}\n\nQuestion:\n{query}\n\nAnswer:"
)
DEFAULT_FALLBACK_TEMPLATE = (
    "Question: {query}\n\nRetrieval is unavailable, so no authoritative text can be quoted. "
    "Suggest retrying later or asking an official source."
)


# ---------------------------------------------------------------- messages


def message(role: str | Column, content: Column) -> Column:
    r = role if isinstance(role, Column) else F.lit(role)
    return F.struct(r.alias("role"), content.alias("content"))


def turn_messages(turns: Column) -> Column:
    """(user_message, assistant_response) structs flattened to alternating messages."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(message("user", t["user_message"]), message("assistant", t["assistant_response"])),
        )
    )


def last_user_message(messages: Column) -> Column:
    """Content of the last message when a user wrote it, else the empty string."""
    last = F.try_element_at(messages, F.lit(-1))
    return F.when(last["role"] == "user", F.coalesce(last["content"], F.lit(""))).otherwise(F.lit(""))


def first_user_message(messages: Column) -> Column:
    first = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))
    return F.coalesce(first["content"], F.lit(""))


def compact_json(value: Column) -> Column:
    """JSON without NULL fields."""
    return F.to_json(value, {"ignoreNullFields": "true"})


def apply_context_prompt(
    messages: Column, prompt: Column, enable_context: Column, system: str = DEFAULT_SAFE_SYSTEM
) -> Column:
    """Use a retrieval prompt: replace the last message when there is history, else start
    a new (system, user) pair. A NULL prompt leaves the messages as they are."""
    keep = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    replaced = F.concat(keep, F.array(message("user", prompt)))
    fresh = F.array(message("system", F.lit(system)), message("user", prompt))
    return (
        F.when(prompt.isNull(), messages)
        .when(F.coalesce(enable_context, F.lit(False)) & (F.size(messages) > 1), replaced)
        .otherwise(fresh)
    )


def render_chat(messages: Column, system: str = DEFAULT_SYSTEM, generation_prompt: bool = False) -> Column:
    """Chat-template text; a system message is put first when the messages lack one."""

    def block(role: Column, content: Column) -> Column:
        return F.concat(F.lit(IM_START), role, F.lit("\n"), content, F.lit(IM_END + "\n"))

    body = F.array_join(F.transform(messages, lambda m: block(m["role"], m["content"])), "")
    implicit = F.when(F.get(messages, F.lit(0))["role"] == "system", F.lit("")).otherwise(
        block(F.lit("system"), F.lit(system))
    )
    tail = F.lit(f"{IM_START}assistant\n" if generation_prompt else "")
    return F.concat(implicit, body, tail)


# ---------------------------------------------------------------- request fields


def request_user(user_id: Column, user: Column) -> Column:
    """user_id, else user, else anonymous; empty strings count as missing."""
    return F.coalesce(F.nullif(user_id, F.lit("")), F.nullif(user, F.lit("")), F.lit("anonymous"))


def key_preview(key: Column, shown: int = 8) -> Column:
    return F.when(F.length(key) > shown, F.concat(F.left(key, F.lit(shown)), F.lit("..."))).otherwise(key)


def safety_response(text: str = STANDARD_REFUSAL) -> Column:
    """The reply put in place of blocked content."""
    n = F.length(F.lit(text)).cast("bigint")
    return F.struct(
        F.lit(SAFETY_MODEL).alias("model"),
        F.lit("assistant").alias("role"),
        F.lit(text).alias("content"),
        F.lit("content_filter").alias("finish_reason"),
        F.lit(0).cast("bigint").alias("prompt_tokens"),
        n.alias("completion_tokens"),
        n.alias("total_tokens"),
    )


# ---------------------------------------------------------------- retrieval prompts


def context_prompt(contexts: Column, question: Column) -> Column:
    """Bulleted contexts followed by the question."""
    bullets = F.array_join(F.transform(contexts, lambda c: F.concat(F.lit(C.CONTEXT_BULLET), c)), "\n")
    return F.concat(F.lit(C.CONTEXT_HEAD), bullets, F.lit(C.CONTEXT_QUESTION), question, F.lit(C.CONTEXT_TAIL))


def _first_present(item: Column, fields: list[tuple[str, str]]) -> Column:
    """The first field that is not NULL, with its label; NULL when none is."""
    out = F.lit(None).cast("string")
    for name, label in reversed(fields):
        out = F.when(item[name].isNotNull(), F.concat(F.lit(label), item[name])).otherwise(out)
    return out


def result_text(query: Column, results: Column, metadata: Column | None = None) -> Column:
    """Retrieval results as plain text.

    ``results`` holds structs with content, text, document, passage, source, url, title,
    score and similarity, any of them NULL.
    """

    def one(r: Column, i: Column) -> Column:
        content = F.coalesce(r["content"], r["text"], r["document"], r["passage"])
        rank = F.when(r["score"].isNotNull(), F.format_string(C.RESULT_SCORE, r["score"])).when(
            r["similarity"].isNotNull(), F.format_string(C.RESULT_SIMILARITY, r["similarity"])
        )
        return F.concat_ws(
            "\n",
            F.format_string(C.RESULT_ITEM, i + 1),
            F.when(F.length(content) > 0, F.concat(F.lit(C.RESULT_CONTENT), content)),
            _first_present(r, [("source", C.RESULT_SOURCE), ("url", C.RESULT_URL), ("title", C.RESULT_TITLE)]),
            rank,
        )

    n = F.coalesce(F.size(results), F.lit(0))
    body = F.when(
        n > 0,
        F.concat_ws(
            "\n", F.format_string(C.RESULT_COUNT, n), F.array_join(F.transform(results, one), "\n")
        ),
    )
    extra = F.lit(None).cast("string")
    if metadata is not None:
        pairs = F.transform(
            F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))
        )
        extra = F.when(F.size(metadata) > 0, F.concat_ws("\n", F.lit(C.RESULT_METADATA), F.array_join(pairs, "\n")))
    return F.concat_ws("\n", F.concat(F.lit(C.RESULT_QUERY), query), body, extra)


def clean_context(context: Column, max_chars: int = MAX_CONTEXT_CHARS) -> Column:
    """Strip, squeeze blank lines, keep the first of repeated lines, cut overlong text."""
    squeezed = F.regexp_replace(strip(context), r"\n{3,}", "\n\n")
    kept = let(
        F.split(squeezed, "\n"),
        lambda lines: let(
            F.transform(lines, strip),
            lambda bare: F.filter(
                lines,
                lambda line, i: (F.length(F.get(bare, i)) == 0)
                | (F.array_position(bare, F.get(bare, i)) == i + 1),
            ),
        ),
    )
    text = let(
        F.array_join(kept, "\n"),
        lambda t: F.when(
            F.length(t) > max_chars, F.concat(F.left(t, F.lit(max_chars)), F.lit(TRUNCATED_NOTICE))
        ).otherwise(t),
    )
    return F.when(context.isNull() | (F.length(context) == 0), F.lit(NO_RESULT_TEXT)).otherwise(text)


def safe_prompt(
    query: Column,
    context: Column,
    template: str = DEFAULT_SAFE_TEMPLATE,
    fallback: str = DEFAULT_FALLBACK_TEMPLATE,
    failed: Column | None = None,
) -> Column:
    """Fill {context} and {query}; rows marked ``failed`` get the fallback prompt instead."""
    head, rest = template.split("{context}")
    middle, tail = rest.split("{query}")
    prompt = F.concat(F.lit(head), clean_context(context), F.lit(middle), query, F.lit(tail))
    before, after = fallback.split("{query}")
    plain = F.concat(F.lit(before), query, F.lit(after))
    chosen = prompt if failed is None else F.when(failed, plain).otherwise(prompt)
    return F.coalesce(chosen, plain)


def rag_messages(prompt: Column, system: str = DEFAULT_SAFE_SYSTEM) -> Column:
    return F.array(message("system", F.lit(system)), message("user", prompt))


# ---------------------------------------------------------------- training rows


def qa_messages(question: Column, answer: Column, clean=strip) -> Column:
    """A two-message conversation; ``clean`` is the injected text cleaner."""
    return F.array(message("user", clean(question)), message("assistant", clean(answer)))


def conversation_length(messages: Column) -> Column:
    """Characters of the first two messages together."""
    first, second = F.get(messages, F.lit(0)), F.get(messages, F.lit(1))
    return (F.length(first["content"]) + F.length(second["content"])).cast("bigint")


def loss_labels(
    ids: Column,
    start_id: int = IM_START_ID,
    exception_id: int = IM_START_EXCEPTION_ID,
    ignore: int = IGNORE_LABEL,
) -> Column:
    """Copy of the token ids with everything but assistant bodies set to ``ignore``.

    Message starts are counted; the first two mask from the very beginning through two
    tokens past the start, every later odd-numbered one from the start before it, and
    later even-numbered ones mask nothing.
    """

    def starts(x: Column) -> Column:
        last = F.size(x) - 2
        candidates = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.filter(candidates, lambda i: (F.get(x, i) == start_id) & (F.get(x, i + 1) != exception_id))

    def spans(s: Column) -> Column:
        every = F.transform(
            s,
            lambda at, n: F.struct(
                F.when(n <= 1, F.lit(0)).when(n % 2 == 0, F.get(s, n - 1)).alias("a"), (at + 2).alias("b")
            ),
        )
        return F.filter(every, lambda v: v["a"].isNotNull())

    return let(
        starts(ids),
        lambda s: let(
            spans(s),
            lambda sp: F.transform(
                ids,
                lambda tok, k: F.when(
                    F.exists(sp, lambda v: (k >= v["a"]) & (k <= v["b"])), F.lit(ignore)
                ).otherwise(tok),
            ),
        ),
    )


def pad_and_cut(ids: Column, labels: Column, max_len: int, pad: int = PAD_ID) -> Column:
    """(input_ids, labels, attention_mask) with one pad token appended, cut to ``max_len``.
    The pad token is kept as a label, and is not attended to."""
    ones = F.transform(ids, lambda _: F.lit(1))
    return F.struct(
        F.slice(F.concat(ids, F.array(F.lit(pad))), 1, max_len).alias("input_ids"),
        F.slice(F.concat(labels, F.array(F.lit(pad))), 1, max_len).alias("labels"),
        F.slice(F.concat(ones, F.array(F.lit(0))), 1, max_len).alias("attention_mask"),
        (F.size(ids) == F.size(labels)).alias("aligned"),
    )


