"""The pipeline operations against SQL, brute force and invariants, on small tables with nulls,
empty and long texts, repeated rows and extra columns."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.llm import bpe, jaccard, kdtree, maxscore, mixlm, pfair, pii, quality, secrets, suffixes
from wardline.llm.catalog import QUERIES, SQL

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, a column named as a result."""
    base = "the quick brown fox jumps over the lazy dog and runs to the old barn near the river " * 3
    rows = [
        (1, base, "en", "a", 1, "x"), (1, base, "en", "a", 1, "x"), (2, base + "today", None, None, None, None),
        (3, None, "en", "a", None, None), (4, "", None, "b", 0, None), (5, " \n\t\x0b ", "en", None, 5, None),
        (6, "éé " * 30_000, "fr", "a", 1, "y"), (None, base, None, None, None, None), (None, None, None, None, None, None),
        (7, "password = 'hunter2hunter2' AKIA" + "A" * 16 + " mail a.b@c.de 4111 1111 1111 1111", "en", "c", 1, None),
        (8, "z" * 5_000, None, "a", 2, None), (9, "one two", "en", "a", 7, None), (10, "One TWO", "en", "a", 7, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    difference = oracle.compare(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), SQL[name])
    assert difference is None, difference


def all_operators(docs):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    return {
        "repeats": suffixes.digests(suffixes.remove_repeats(docs)),
        "quality": quality.quality_rules(docs),
        "secrets": secrets.redact(secrets.scan_secrets(docs)),
        "bpe": bpe.digests(bpe.encode_decode(docs, path, P.PATTERN)),
        "jaccard": jaccard.digests(docs, jaccard.jaccard_components(docs)),
        "pii": pii.personal_data(docs),
        "mix": pfair.mix(docs),
        "shards": kdtree.digests(kdtree.kd_shards(docs, shards=3)),
        "lm": mixlm.digests(mixlm.score(docs)),
    }


def test_odd_rows_keep_their_number(odd):
    for name, found in all_operators(odd).items():
        assert found.count() == odd.count(), name


def test_empty_table(odd):
    for name, found in all_operators(odd.filter("false")).items():
        assert found.count() == 0, name


def test_repeats_equal_brute_force(spark, sf_dir, texts):
    seen: set[bytes] = set()
    want = {}
    for i in sorted(texts):
        raw = texts[i].encode()
        gone = bytearray(len(raw))
        mine = {raw[p : p + 50] for p in range(len(raw) - 49)}
        for p in range(len(raw) - 49):
            if raw[p : p + 50] in seen:
                gone[p : p + 50] = b"\1" * 50
        seen |= mine
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        want[i] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    got = {r[0]: tuple(r)[1:5] for r in QUERIES["op1_suffix_dedup"](spark, sf_dir).collect()}
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=50, max_size=80).map(lambda b: bytes(c % 2 for c in b)), min_size=1, max_size=12))
def test_suffix_block_classes(segments):
    raw = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.cumsum([len(s) for s in segments])
    of_window, keys, least = suffixes.block_classes(raw, ends, np.arange(len(segments)))
    windows = [(s[i : i + 50], d) for d, s in enumerate(segments) for i in range(len(s) - 49)]
    first = {}
    for w, d in windows:
        first[w] = min(first.get(w, d), d)
    assert len(keys) == len(first) and [least[c] for c in of_window] == [first[w] for w, _ in windows]


def test_bpe_equals_tiktoken_and_decodes(texts):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    coder, ranks = bpe.TextCoder(path, P.PATTERN), bpe.read_ranks(path)
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in [*list(texts.values())[:60], "a" * 3_000, "abcab" * 700, "", "é\U0001f600 <|endoftext|>"]:
        _, tokens, _, raw = coder.code([text])
        assert tokens.tolist() == exact.encode_ordinary(text) and bytes(raw).decode() == text


def shingle_set(text):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def linked_by_brute_force(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_equals_brute_force(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op5_jaccard_join"](spark, sf_dir).collect()}
    assert got == linked_by_brute_force(texts)


def test_jaccard_of_a_large_group_and_of_short_texts(spark):
    """Near copies whose similarities lie on both sides of the threshold, and texts of fewer
    shingles than the longest prefix asks for, each met by many documents."""
    rng = np.random.default_rng(5)
    texts = {}
    for size, many in ((90, 260), (10, 150), (8, 150)):
        base = [f"w{size}x{i}" for i in range(size)]
        for _ in range(many):
            words = list(base)
            for at in rng.choice(size, rng.integers(0, max(2, size // 12)), replace=False):
                words[at] = f"e{rng.integers(40)}"
            texts[len(texts)] = " ".join(words[: size - int(rng.integers(0, 3))])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.digests(df, jaccard.jaccard_components(df)).collect()}
    assert got == linked_by_brute_force(texts)


def test_quality_windows(spark):
    df = spark.createDataFrame([("a b c d e a b c d e x",), ("a a a a a a",), ("a b c",)], "text string")
    assert [r["n_repeat_words"] for r in quality.quality_rules(df).collect()] == [10, 6, 0]


def test_weak_parts_need_complementary_ones(spark):
    text = ["https://x.example/y token=abcdefgh12", "https://x.example/y", "token=abcdefgh12 " + "w " * 300 + "https://x.example/y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id int, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.digests(secrets.scan_secrets(df)).collect()}
    assert "endpoint" in got[0] and got[1] == "" and "endpoint" not in got[2]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.scan_secrets(df)).collect()}
    assert clean[0] == "[secret] [secret]" and clean[1] == text[1]


def test_account_numbers(spark):
    df = spark.createDataFrame([("IBAN DE89370400440532013000",), ("DE88370400440532013000",)], "text string")
    kinds = [[s["kind"] for s in r["pii_spans"]] for r in pii.personal_data(df).collect()]
    assert "iban" in kinds[0] and "iban" not in kinds[1]


def test_mixing_stays_within_a_block():
    steps = pfair.steps_of({"a": 5.0, "b": 3.0, "c": 1.0, "d": 0.5}, 100)
    placed, length = pfair.one_cycle(steps), sum(steps.values())
    assert sorted(s for _, _, s in placed) == list(range(length))
    had = collections.Counter()
    for name, block, step in placed:
        assert block == had[name] and block * length // steps[name] <= step
        had[name] += 1
        assert all(abs((step + 1) * steps[k] / length - had[k]) < 1 for k in steps)


def test_mixture_places_every_row_once(spark, sf_dir):
    rows = QUERIES["op7_mixing"](spark, sf_dir).collect()
    assert all(r["mix_release"] <= r["mix_step"] < r["mix_deadline"] for r in rows)
    assert len({(r["mix_step"], r["mix_place"]) for r in rows}) == len(rows)


def test_shards_are_even_and_gapless(spark, sf_dir):
    rows = QUERIES["op8_sharding"](spark, sf_dir).collect()
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(size) == 24 and max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in rows)


def test_language_model(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in QUERIES["op9_lm_scoring"](spark, sf_dir).collect()}
    tokens = {i: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t)] + [0] for i, t in texts.items()}
    tokens = {i: [w if w == 0 else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in ws] for i, ws in tokens.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, distinct = sum(count.values()), len(count)
    for i, ws in tokens.items():
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws)
        assert math.isclose(base, got[i]["base_score"], rel_tol=1e-9) and got[i]["train_tokens"] == total
        assert got[i]["n_known"] == sum(count[w] > 0 for w in ws) and got[i]["held_out"] == held[i]
    bits = -sum(got[i]["score"] for i in texts if held[i]) * math.log2(10) / sum(len(texts[i].encode()) for i in texts if held[i])
    assert bits < 3.5  # held-out texts; eight without a model


def test_model_probabilities_add_up():
    tree = np.zeros((mixlm.ORDERS, mixlm.SLOTS, 512), np.float32)
    tree[:, :, 256 + 97] = 3
    for node in range(255, 0, -1):
        tree[:, :, node] = tree[:, :, 2 * node] + tree[:, :, 2 * node + 1]
    model = mixlm.Mixer(tree, mixlm.Mixer.empty())
    assert math.isclose(np.exp(model.log_probability(np.arange(256) + (7 << 8))).sum(), 1.0, rel_tol=1e-6)


def test_top_k_ties_nulls_and_own_row(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = maxscore.top_k(df, df.filter("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 6, -65536)]


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = corpus_pipeline.run(spark, sf_dir)
    assert corpus_pipeline.STAGES[-1][0] == "byte_bpe" and kept.columns[0] == "doc_id"
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    passed = quality.quality_rules(docs).filter("kept").select(*names)
    found = jaccard.jaccard_components(passed.select("doc_id", "text")).filter("doc = component")
    assert ids == {r["doc"] for r in found.collect()}
    clean = {r["doc_id"] for r in QUERIES["op2_quality_rules"](spark, sf_dir).filter(F.col("kept")).collect()}
    assert ids <= clean
