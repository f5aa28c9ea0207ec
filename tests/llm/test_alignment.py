"""Token alignment against the tokenizer libraries and a walk over both token lists."""

from __future__ import annotations

import collections
import hashlib
import os
import random

import public_tokenizers as P
import pytest

from wardline.llm import alignment
from wardline.llm.catalog import QUERIES

PATHS = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def walked(rows):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_side.encode_special_tokens = True
    letters, counts, out = alignment.byte_alphabet(), collections.Counter(), []
    for doc, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        pieces = [b_side.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
        whole = (" " + text).encode() if text else b""
        if not b"".join(a_bytes) == b"".join(b_bytes) == whole:
            a, b = [], []
        links, groups, i, j = [], [], 0, 0
        end_a, end_b = (len(a_bytes[0]), len(b_bytes[0])) if a else (0, 0)
        group = [[0], [0]]
        while i < len(a):
            links.append((a[i], b[j]))
            if end_a == end_b:
                groups.append("|".join(",".join(str(ids[k]) for k in g) for ids, g in zip((a, b), group, strict=True)))
                group = [[i + 1], [j + 1]]
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a:
                i += 1
                end_a += len(a_bytes[i]) if i < len(a) else 0
                group[0] += [i] if not step_b else []
            if step_b:
                j += 1
                end_b += len(b_bytes[j]) if j < len(b) else 0
                group[1] += [j] if not step_a else []
        counts.update(links)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), links, sha))
    highest = collections.Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [
        (doc, n_a, n_b, n_groups, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), sha)
        for doc, n_a, n_b, n_groups, links, sha in out
    ]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, *[str(x) for x in r]))


ODD = [
    (1, "a b"), (1, "a b"), (None, "a b"), (None, None), (2, None), (3, ""), (4, " "), (5, "\n\n\n"), (6, "x▁y"),
    (7, "<|endoftext|> </s> <s> <unk> <0x41> <pad>"), (8, "日本語 \U0001f600́ \u0000 � \r\n\t　"), (9, "ab" * 8_000),
    (10, " " * 9_000 + "x"), (11, "1234567890" * 30), (12, "it's we'll I'd they're"), (13, "é" * 3_000),
]


@pytest.mark.parametrize("frequent", [1, 20, 1 << 19])
def test_odd_rows_with_any_number_of_frequent_pairs(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    rows = [(d, t, 1) for d, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_a int").repartition(3)
    got = alignment.alignment(docs, *PATHS).withColumnRenamed("doc", "doc_id").select(COLUMNS).collect()
    assert ordered(got) == ordered(walked(ODD))
    assert alignment.alignment(docs.filter("false"), *PATHS).count() == 0


def test_query_equals_the_walk(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_token_alignment"](spark, sf_dir).select(COLUMNS).collect()
    assert ordered(got) == ordered(walked(rows))


def test_both_libraries_give_the_same_ids():
    """Side A's ranks are merged by a faster library than the one its file belongs to."""
    sides = alignment.Sides.of(*PATHS)
    assert sides.quick is not None
    rng = random.Random(9)
    alphabet = "abcdeinrst  \n'.,019éüА日\U0001f600<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(2_000)]
    quick, slow = (sides.encoded(texts, [x] * len(texts))[0] for x in (False, True))
    assert all(a.tolist() == b.tolist() for a, b in zip(quick, slow, strict=True))
