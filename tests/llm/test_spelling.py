"""Spelling variants against brute force."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import oracle
import pytest

from wardline.llm import spelling
from wardline.llm.catalog import QUERIES, SQL


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by_hole = collections.defaultdict(set)  # words that are equal but for one letter share a hole
    for w in counts:
        by_hole[w].add(w)
        for i in range(len(w)):
            by_hole[w[:i] + w[i + 1 :]].add(w)
    near = collections.defaultdict(set)
    for group in by_hole.values():
        for a in group:
            near[a] |= {b for b in group if a != b and edits(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 5 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert any(r[1] for r in want) and found(QUERIES["op11_spelling_groups"](spark, sf_dir)) == want


@pytest.mark.parametrize("shard_words", [1, 6, 10_000])
def test_dense_words_at_any_cut_of_the_trie(spark, monkeypatch, shard_words):
    """Few letters, so most words have near ones, chains of forms and several of equal counts."""
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(spelling, "BLOCK", 50)
    rng = random.Random(3)
    words = ["".join(rng.choice("abÉé") for _ in range(rng.randrange(5, 9))) for _ in range(70)]
    words += ["abcdefgh", "abcdefg", "abcdefghi", "bbcdefgh", "×÷×÷×÷", "×÷×÷××"]
    rows = [(i % 7, " ".join(f"{w}, {w.upper() if w.isascii() else w}" for _ in range(5 ** rng.randrange(1, 4)))) for i, w in enumerate(words)]
    # the random words alone have no chain
    rows.append((7, " ".join(["chainab"] * 5 + ["chainabc"] * 25 + ["chainabcd"] * 125)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute(rows)
    chains = {r[0]: r[1] for r in want if r[1]}
    assert any(f in chains for f in chains.values())
    assert found(spelling.spelling_groups(docs)) == want


def test_odd_rows(spark):
    base = "wonderful weather " * 5
    rows = [(1, base, "a"), (1, base, "a"), (None, base, None), (2, None, "b"), (3, "", "b"), (4, "a 1 \n", None), (5, "q" * 100_000, "x")] + [
        (i, "q" * 100_000 + "w", "x") for i in range(10, 16)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string").repartition(2)
    assert found(spelling.spelling_groups(docs)) == brute([r[:2] for r in rows])
    assert spelling.spelling_groups(docs.filter("false")).count() == 0


def test_one_edit_letter_by_letter():
    words = ["abcdef", "abcdeg", "abdcef", "abcdf", "xabcdef", "abcdefx", "abcdefxy", "abccdef", "abcdef"]
    raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    near = np.abs(np.diff(offsets)[a] - np.diff(offsets)[b]) <= 1
    a, b = a[near], b[near]
    got = spelling.one_edit(raw, offsets, a, b)
    assert got.tolist() == [edits(words[i], words[j]) for i, j in zip(a, b, strict=True)]


def test_query_equals_sql(spark, sf_dir):
    name = "op11_spelling_groups"
    assert oracle.compare(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), SQL[name]) is None
