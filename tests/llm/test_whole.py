"""Operations over the whole job: places where an earlier version did less."""

from __future__ import annotations

import collections
import math
import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from wardline.llm import bpe, features, jaccard, mixlm, pfair, secrets, words


def test_mixture_follows_the_weights_of_many_sources(spark):
    """1,200 sources of which one is a third: before, all were dealt equal shares."""
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 1199}", "x" * 99) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(4)
    weights = {s: 1.0 for s in {r[1] for r in rows}} | {"hot": 599.5}
    assert len(weights) == 1_200
    got = pfair.mix(docs, weights, block_bytes=100).collect()
    assert len(got) == len(rows) and len({r["mix_step"] for r in got}) == len(rows)
    blocks, had = collections.Counter(r["source"] for r in got), collections.Counter()
    total = sum(weights.values())
    at = {r["mix_step"]: (r["source"], r["mix_block"]) for r in got}
    for step in range(max(at) + 1):
        if step in at:
            name, block = at[step]
            assert block == had[name]
            had[name] += 1
        if step % 50 == 0 or step < 300:  # every source against its true weight
            assert all(abs((step + 1) * w / total - had[k]) < 1 for k, w in weights.items() if had[k] < blocks[k])


def test_mixture_of_uneven_weights_does_not_drift():
    weights = {f"s{i}": (i + 1) ** 0.7 for i in range(19)} | {"hot": 60.1}
    total, had = sum(weights.values()), collections.Counter()
    for name, _, step, _, _ in pfair.schedule(pfair.whole_weights(weights), dict.fromkeys(weights, 10_000)):
        had[name] += 1
        if had["hot"] == 10_000:
            break
        assert all(abs((step + 1) * w / total - had[k]) < 1 + 1e-6 for k, w in weights.items())


def found_by_brute_force(text):
    parts = []
    for kind, (pattern, role, strong) in secrets.KINDS.items():
        for m in re.finditer(pattern, text):
            if kind != "assign" or len(m.group(2)) >= 8:
                parts.append((m.start(), kind, m.end(), role, strong))
    near = lambda a, b: max(a[0] - b[2], b[0] - a[2]) <= secrets.SCOPE
    kept = [a for a in parts if a[4] or any(a[3] != b[3] and near(a, b) for b in parts)]
    order = list(secrets.KINDS)
    return ",".join(f"{k}:{s}:{e}" for s, k, e, _, _ in sorted(kept, key=lambda a: (a[0], order.index(a[1]))))


def test_weak_parts_link_with_one_another_and_from_end_to_start(spark):
    bearer, url = "Bearer abcdefghijklmnop1234", "https://api.example/v1"
    jwt = "token=" + "eyJhbGciOi." * 60
    texts = [
        f"client_id=acme-7 then {bearer} at {url}", bearer, f"{jwt} {url}", url + " " * 200 + bearer,
        url + " " * 201 + bearer, f"{bearer} {'A' * 700} {url}", "https://" + "x" * 900 + f" {bearer}", f"{url} {url}",
    ]
    rng = random.Random(3)
    pool = [bearer, url, jwt, "login: someone", "AKIA" + "Z" * 16, "https://" + "y" * 450]
    for _ in range(150):
        texts.append("".join(rng.choice(pool) + " " * rng.choice([1, 60, 199, 200, 201, 202, 390, 401, 650]) for _ in range(7)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r["doc_id"]: r["spans"] for r in secrets.digests(secrets.scan_secrets(df)).collect()}
    assert got == {i: found_by_brute_force(t) for i, t in enumerate(texts)}
    kinds = [re.findall("[a-z]+", got[i]) for i in range(8)]
    assert kinds[0] == ["account", "bearer", "endpoint"] and kinds[1] == [] and kinds[2] == ["assign", "endpoint"]
    assert len(kinds[3]) == 2 and kinds[4] == [] == kinds[5] == kinds[7] and len(kinds[6]) == 2
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.scan_secrets(df)).collect()}
    assert "Bearer" not in clean[0]


def test_bpe_of_long_unbroken_runs():
    """100,000 random letters as one piece, and runs whose bytes all stand side by side in tokens."""
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    coder, ranks = bpe.TextCoder(path, P.PATTERN), bpe.read_ranks(path)
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(11)
    run = lambda letters, n: "".join(rng.choices(letters, k=n))
    lower = "abcdefghijklmnopqrstuvwxyz"
    for text in [run(lower, 100_000), run(lower + lower.upper(), 5_000), run("acgt", 5_000), run("etaoin", 5_000), "th" * 700]:
        _, tokens, _, raw = coder.code([text])
        assert tokens.tolist() == exact.encode_ordinary(text) and bytes(raw).decode() == text


def test_bpe_cache_stays_bounded_in_pieces_and_bytes(monkeypatch):
    """Texts of new and of recurring pieces; the cache a worker keeps is cut again and again."""
    import public_tokenizers as P
    import tiktoken

    monkeypatch.setattr(bpe, "CACHE_PIECES", 300)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 6_000)
    path = P.path("byte_bpe_50k.tiktoken")
    coder = bpe.worker_coder(path, P.PATTERN)
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(4)
    often = ["oftenmet", "Éléphantes", "x" * 60]
    for k in range(30):
        size = 900 if k % 10 == 9 else rng.randrange(4, 12)
        fresh = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=size)) for _ in range(5 if size == 900 else 60)]
        text = " ".join([*often, *fresh, *often, *often])
        _, tokens, _, raw = coder.code([text])
        assert tokens.tolist() == exact.encode_ordinary(text) and bytes(raw).decode() == text
        assert len(coder.known) <= 300 + 70 and len(coder.raw) <= 6_000 + 5_500
        assert len(coder.known) == len(coder.uses) == len(coder.n_raw) and coder.n_raw.sum() == len(coder.raw)
    words.give_back(everything=False)
    assert bpe.worker_coder(path, P.PATTERN) is coder
    words.give_back()  # what tasks of other kinds call
    assert not hasattr(words.kept_by_worker(), "coder")


def test_bpe_cache_is_no_python_object_a_piece():
    """What a worker keeps of 60,000 pieces: before, strings in a dictionary, over 250 bytes a piece."""
    import gc
    import tracemalloc

    import public_tokenizers as P
    import pyarrow as pa

    coder, rng = bpe.TextCoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(20_000)) for _ in range(3)]
    coder.code(["first words"])
    gc.collect()
    tracemalloc.start()
    try:
        arrow = pa.total_allocated_bytes()
        for text in texts:
            coder.code([text])
        gc.collect()
        grown = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert len(coder.known) > 59_000 and grown < 120 * len(coder.known)


def test_bpe_works_on_texts_by_their_own_size(spark, monkeypatch):
    """Long texts behind many short ones were cut by the average row, so all of them were one slab."""
    import public_tokenizers as P
    import pyarrow as pa
    import tiktoken

    monkeypatch.setattr(bpe, "SLAB_BYTES", 10_000)
    path, rng, steps = P.path("byte_bpe_50k.tiktoken"), random.Random(2), []
    texts = ["few words", None, "", "Éé 漢字\n"] * 100 + [" ".join(f"w{rng.randrange(10**6)}" for _ in range(500)) for _ in range(20)]
    docs = spark.createDataFrame([(0, "")], "doc_id bigint, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, step, schema: steps.append(step))
    bpe.encode_decode(docs, path, P.PATTERN)
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "_text"])
    found = list(steps[0](iter([given, given.slice(0, 0), given.slice(390, 15)])))
    assert max(sum(len(x) for x in b.column("decoded").to_pylist()) for b in found) < 2 * 10_000
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = [r for b in found for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == [*range(len(texts)), *range(390, 405)]
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["token_ids"] == exact.encode_ordinary(text) and r["decoded"].decode() == text


def linked(docs, want_pairs=()):
    got = {r["doc_id"]: r["component_id"] for r in jaccard.digests(docs, jaccard.jaccard_components(docs)).collect()}
    return [got[a] == got[b] for a, b in want_pairs]


@pytest.mark.parametrize("partitions", ["4", "200"])
def test_words_whose_short_hashes_meet_are_not_linked(spark, partitions):
    """One-word texts that an earlier version took for equal, and two runs of 1,024 letters with equal
    polynomial hashes modulo 2**64."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    texts = ["w436709", "w1035937", "w1066493", "w1765225", thue, thue.translate(str.maketrans("ab", "ba")), "same same", "SAME same"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, sign string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert linked(docs, [(0, 1), (2, 3), (4, 5), (6, 7)]) == [False, False, False, True]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocks_of_many_buckets_are_mostly_features(spark):
    """What a block says of its documents grew with the number of buckets beyond the features themselves."""
    rng = random.Random(8)
    rows = [(10**12 + 7 * i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "128")
    try:
        blocks = features.packed(docs, "doc_id", "text", words.shingles, True).filter("bucket >= 0").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(len(b["features"]) for b in blocks) == 4 * 96 * len(rows)
    assert sum(len(b["ids"]) + len(b["counts"]) for b in blocks) < sum(len(b["features"]) for b in blocks)
    for values in ([], [5], [-(2**63), 2**63 - 1, 0], [2**40, 2**40 + 127, 2**40 - 2], list(range(300, 0, -1))):
        packs = [features.stepped(np.array(values, np.int64)), b"", features.stepped([3, 3])]
        assert features.unstepped(packs, np.int64).tolist() == [*values, 3, 3]


def test_whole_sets_do_not_travel_to_find_heads_and_pairs(spark, monkeypatch):
    """Joins took the shared shingles of all documents along, though profiles are short and few documents are in pairs."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{long} end{i % 9}") for i in range(40)]
    plans = {}
    write = jaccard.written

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(jaccard, "written", seen)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["component"] for r in found} == {0}
    above, below = plans["profiles"].split("Join", 1)
    assert "Join Inner" in plans["profiles"] and "slice(" not in above and "slice(" in below
    assert "Join LeftSemi" in plans["likely"]


def test_words_alone_decide_where_all_hashes_meet(spark, monkeypatch):
    """With sent features cut to a few bits nearly all shingles look shared; links stay exact."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 60))]
        rows.append((3 * i, " ".join(own)))
        near = list(own)
        near[rng.randrange(len(near))] = "changed"
        rows += [(3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(own[: max(1, len(own) - 2)]))]
    whole = features.packed
    monkeypatch.setattr(features, "packed", lambda docs, doc, text, of, sized: whole(docs, doc, text, lambda *a: coarse(of(*a)), sized))

    def coarse(found):
        owner, value, other = found
        cut = np.lexsort((other, value >> np.uint64(54), owner))
        return owner[cut], (value[cut] >> np.uint64(54)) << np.uint64(54), other[cut]

    sets = {d: jaccard.word_sets([t]) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = jaccard.jaccard_components(docs).collect()
    assert {r["doc"]: r["component"] for r in found} == {d: root(d) for d in sets}
    assert {r["doc"]: r["n_shingles"] for r in found} == {d: len(s) for d, s in sets.items()}


def test_language_model_tells_structured_words_apart(spark):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(i, t) for i, t in enumerate([thue, thue.translate(str.maketrans("ab", "ba")), "cd", "cd ef"] * 4)]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = collections.Counter(w for d, t in rows if not held(d) for w in [*t.split(), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    for r in mixlm.score(docs).collect():
        tokens = [*rows[r["doc"]][1].split(), "\n"]
        want = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert abs(r["base_score"] - want) < 1e-9 and r["n_known"] == sum(counts[w] > 0 for w in tokens)


CODES_TEXTS = """
import random, re, sys, public_tokenizers as P, pyarrow as pa, pandas, duckdb, regex
from wardline.llm import bpe, words

def now(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rng = random.Random(7)
known = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(200_000)]
batch = pa.record_batch({"text": [" ".join(rng.choices(known, k=400)) for _ in range(2_000)]})
coder = bpe.worker_coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
words.give_back(everything=False)
before = now("VmRSS")
for part in words.slices([batch], "text", bpe.SLAB_BYTES):
    n_tokens, tokens, n_raw, raw = coder.code(part.column("text").to_pylist())
    assert raw.tobytes().decode() == "".join(part.column("text").to_pylist())
    del part, n_tokens, tokens, n_raw, raw
    words.give_back(everything=False)
print(len(coder.known), now("VmHWM") - before, now("VmRSS") - before)
"""


def test_bpe_memory_of_a_worker():
    """5 MB of texts with 180,000 pieces: coding them took 135 MB at most, of which 81 are left."""
    root = Path(bpe.__file__).parents[2]
    env = os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}", "OMP_NUM_THREADS": "1"}
    ran = subprocess.run([sys.executable, "-c", CODES_TEXTS], env=env, capture_output=True, text=True, check=True)
    pieces, most, kept = map(float, ran.stdout.split()[:3])
    assert pieces > 170_000 and kept < most < 110
