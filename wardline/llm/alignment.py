"""Tokens of two tokenizers aligned by the bytes they cover.

Each batch of texts is tokenized by both; running sums of token lengths give every token its
first byte. ``pandas.merge_asof``, keyed by document, finds for each token's start the token
of the other side that covers it. Two tokens overlap exactly if the later start lies in the other,
so the union of both directions holds every link, twice only where starts are equal; equal
starts are also where a group of tokens begins (and the one before ends on both sides).

A document's links travel packed: its distinct id pairs and how often each occurs. Pairs are
counted over the corpus. Those that make up at least one in ``FREQUENT`` of all links - so at
most ``FREQUENT`` pairs - are sent to all tasks; the others, none of which is frequent, are
joined as rows.

Side A is a byte-level BPE from a tokenizer file, side B a piece model. Texts that are null,
empty, or whose token bytes do not give a space and the text have no tokens. Rows that share
an id are worked on separately; other columns play no part; an empty table gives no rows.
Ids may be null. Long texts are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.store import written
from wardline.session import scratch_path

#: Pairs known to all tasks, at most.
FREQUENT = 1 << 19
SLICE_BYTES = 1_000_000
#: Texts with unbroken runs of this many bytes go to the library whose time grows evenly.
LONG_RUN = 2_000

ALIGNED = (
    "row bigint, doc bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, pairs binary, times binary"
)


def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for
    themselves, the others, in order, for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Sides:
    """Both tokenizers of a worker, kept for its next batches."""

    kept: dict = {}

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import json

        import numpy as np
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_alphabet(), {t["content"] for t in spec.get("added_tokens", []) if t["special"]}
        entries = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if t not in special}
        ranks = {entries[t]: i for t, i in spec["model"]["vocab"].items() if t in entries}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [ranks[entries["".join(m)]] for m in merges]
        # merged in the order of ids, a vocabulary is one of ranks, which are merged faster
        self.quick = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ids == sorted(ids) else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        of_a = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            of_a[i] = token
        of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.tokens = [Tokens(of_a), Tokens(of_b)]
        assert max(len(of_a), len(of_b)) <= 1 << 16, "ids are packed in two bytes each"
        self.empty = np.zeros(0, np.int64)

    @classmethod
    def of(cls, *paths: str) -> Sides:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if paths not in cls.kept:
            cls.kept[paths] = cls(*paths)
        return cls.kept[paths]

    def encoded(self, texts: list[str], long: list[bool]):
        """Ids of both sides, an array for each text."""
        import numpy as np

        spaced = [" " + t for t in texts]
        slow = [i for i, x in enumerate(long) if x or self.quick is None]
        found = dict(zip(slow, self.slow.encode_batch([spaced[i] for i in slow], add_special_tokens=False), strict=True))
        a = [found[i].ids if i in found else self.quick.encode_ordinary(t) for i, t in enumerate(spaced)]
        b = self.b.encode(texts, num_threads=1)
        return [[np.array(x, np.int64) for x in side] for side in (a, b)]


class Tokens:
    """A vocabulary's bytes, lengths and ids as text with each separator."""

    SEPARATORS = (",", "|", ";", "")

    def __init__(self, entries: list[bytes]):
        import numpy as np
        import pyarrow as pa

        self.entries = pa.array(entries, pa.binary())
        self.size = np.array([len(x) for x in entries], np.int64)
        self.printed = pa.array([f"{i}{s}" for i in range(len(entries)) for s in self.SEPARATORS], pa.binary())


def _joined(values, index):
    """The bytes of ``values`` taken by ``index``, one after the other, and where each begins."""
    import numpy as np
    import pyarrow as pa

    taken = values.take(pa.array(index))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int32)[taken.offset : taken.offset + len(taken) + 1]
    return (memoryview(data).cast("B")[at[0] : at[-1]] if data is not None else memoryview(b"")), at - at[0]


def _long_runs(column):
    """For each text whether it has ``LONG_RUN`` bytes on end that are all blank or all not."""
    import numpy as np

    from wardline.llm.words import text_bytes

    raw, offsets = text_bytes(column)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    turn = np.ones(len(raw), bool)
    turn[1:] = blank[1:] != blank[:-1]
    turn[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(turn)
    runs = np.diff(np.append(starts, len(raw)))
    found = np.zeros(len(offsets) - 1, bool)
    found[np.searchsorted(offsets, starts[runs >= LONG_RUN], "right") - 1] = True
    return found.tolist()


def overlaps(start_a, doc_a, start_b, doc_b):
    """``(a, b, begins_a, begins_b)``: places of all pairs of overlapping tokens, and the tokens
    that begin where one of the other side does. Starts rise over all documents."""
    import numpy as np
    import pandas as pd

    a = pd.DataFrame({"start": start_a, "doc": doc_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"start": start_b, "doc": doc_b, "b": np.arange(len(start_b))})
    cover_of_a = pd.merge_asof(a, b, on="start", by="doc")["b"].to_numpy().astype(np.int64)
    cover_of_b = pd.merge_asof(b, a, on="start", by="doc")["a"].to_numpy().astype(np.int64)
    begins_a, begins_b = start_b[cover_of_a] == start_a, start_a[cover_of_b] == start_b
    inner = np.flatnonzero(~begins_b)  # the others were found from side A
    return (
        np.concatenate([a["a"].to_numpy(), cover_of_b[inner]]), np.concatenate([cover_of_a, inner]), begins_a, begins_b
    )


def align(sides: Sides, column):
    """Columns (n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of a column of texts."""
    import hashlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    whole = pc.fill_null(column, "")
    texts, rows = whole.to_pylist(), len(whole)
    ids = sides.encoded(texts, _long_runs(whole))
    for side in ids:
        for i, text in enumerate(texts):
            if not text:
                side[i] = sides.empty
    flat = [np.concatenate([sides.empty, *side]) for side in ids]
    cuts = [np.concatenate([[0], np.cumsum([len(x) for x in side])]) for side in ids]
    made = [_joined(t.entries, x) for t, x in zip(sides.tokens, flat, strict=True)]
    gone = set()
    for i, text in enumerate(texts):
        want = b" " + text.encode() if text else b""
        if any(data[at[cut[i]] : at[cut[i + 1]]] != want for (data, at), cut in zip(made, cuts, strict=True)):
            gone.add(i)
    if gone:
        ids = [[sides.empty if i in gone else x for i, x in enumerate(side)] for side in ids]
        flat = [np.concatenate([sides.empty, *side]) for side in ids]
        cuts = [np.concatenate([[0], np.cumsum([len(x) for x in side])]) for side in ids]
    del made
    (a, b), (cut_a, cut_b) = flat, cuts
    start = [np.cumsum(t.size[x]) - t.size[x] for t, x in zip(sides.tokens, flat, strict=True)]
    doc = [np.repeat(np.arange(rows), np.diff(c)) for c in cuts]
    left, right, begins_a, begins_b = overlaps(start[0], doc[0], start[1], doc[1])
    group_a, group_b = np.cumsum(begins_a), np.cumsum(begins_b)  # from 1
    count = int(group_a[-1]) if len(a) else 0
    per_a, per_b = np.bincount(group_a, minlength=count + 1), np.bincount(group_b, minlength=count + 1)
    # where each token stands when every group's A tokens are written before its B tokens
    place_a = np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(per_a)[group_b]
    end_a, end_b = np.ones(len(a), bool), np.ones(len(b), bool)
    end_a[:-1], end_b[:-1] = begins_a[1:], begins_b[1:]
    last_b = np.zeros(len(b), bool)
    last_b[cut_b[1:][np.diff(cut_b) > 0] - 1] = True
    base = len(sides.tokens[0].printed)
    index = np.zeros(len(a) + len(b), np.int64)
    index[place_a] = a * 4 + end_a
    index[place_b] = base + b * 4 + np.where(last_b, 3, np.where(end_b, 2, 0))
    printed, at = _joined(pa.concat_arrays([t.printed for t in sides.tokens]), index)
    ends = cut_a + cut_b
    shas = [
        hashlib.sha256(printed[at[s] : at[e]]).hexdigest() if e > s else ""
        for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
    ]
    groups = np.bincount(doc[0][begins_a], minlength=rows)
    links = np.bincount(doc[0][left], minlength=rows)
    key = (doc[0][left].astype(np.uint64) << np.uint64(32)) | (a[left].astype(np.uint64) << np.uint64(16)) | b[right].astype(np.uint64)
    key, times = np.unique(key, return_counts=True)
    at = np.searchsorted(key >> np.uint64(32), np.arange(rows + 1, dtype=np.uint64))
    pair, times = key.astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes()
    blob = lambda x: pa.array([x[4 * s : 4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
    return [
        pa.array(np.diff(cut_a)), pa.array(np.diff(cut_b)), pa.array(groups), pa.array(links), pa.array(shas, pa.string()),
        blob(pair), blob(times),
    ]


def aligned(docs: DataFrame, a_path: str, b_path: str, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``, with a number of its own, its alignment and its packed links."""

    def tokenize(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from wardline.llm.words import slices

        sides = Sides.of(a_path, b_path, pattern)
        row = TaskContext.get().partitionId() << 33
        names = [c.split()[0] for c in ALIGNED.split(", ")]
        for batch in slices(batches, "text", SLICE_BYTES):
            n = batch.num_rows
            numbers = pa.array(np.arange(row, row + n))
            row += n
            yield pa.RecordBatch.from_arrays([numbers, batch.column("doc"), *align(sides, batch.column("text"))], names=names)

    given = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return given.mapInArrow(tokenize, ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """``(pair, n)``: how many links of the corpus hold each id pair."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            pair = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), np.uint32)
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), np.uint32)
            pair, at = np.unique(pair, return_inverse=True)
            n = np.bincount(at, times, len(pair)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    parts = found.select("pairs", "times").mapInArrow(count, "pair bigint, n bigint")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def ranked_pairs(counts: DataFrame) -> DataFrame:
    """``(pair, n, best)``: whether no pair of the same B id has a higher count. There are as many
    B ids as the vocabulary has, 65,536 at most."""
    of_b = F.col("pair").bitwiseAND(0xFFFF)
    highest = counts.groupBy(of_b.alias("id_b")).agg(F.max("n").alias("highest"))
    ranked = counts.withColumn("id_b", of_b).join(F.broadcast(highest), "id_b")
    return ranked.select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def link_sums(found: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(row, n_best, count_sum)`` for every row of ``found`` that has links."""
    spark = found.sparkSession
    total = ranked.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") * FREQUENT >= F.lit(total)
    known = ranked.filter(common).toPandas().sort_values("pair")  # FREQUENT rows at most
    sent = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "n", "best")))

    def add(batches):
        import numpy as np
        import pyarrow as pa

        pairs, counts, bests = sent.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                blobs = batch.column("pairs").to_pylist()
                pair = np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64)
                times = np.frombuffer(b"".join(batch.column("times").to_pylist()), np.uint32).astype(np.int64)
                owner = np.repeat(np.arange(len(blobs)), [len(x) // 4 for x in blobs])
                at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
                hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
                # sums of whole numbers: floating-point bincount is exact below 2**53 only
                n = np.zeros(len(blobs), np.int64)
                np.add.at(n, owner[hit], counts[at[hit]] * times[hit])
                best = np.bincount(owner[hit], bests[at[hit]] * times[hit], len(blobs)).astype(np.int64)
                rest = np.flatnonzero(~hit)
                rows = batch.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([rows, rows[owner[rest]]])),
                     pa.array(np.concatenate([np.full(len(blobs), -1), pair[rest]])),
                     pa.array(np.concatenate([n, times[rest]])),
                     pa.array(np.concatenate([best, np.zeros(len(rest), np.int64)]))],
                    names=["row", "pair", "n", "best"],
                )

    parts = written(found.select("row", "pairs", "times").mapInArrow(add, "row bigint, pair bigint, n bigint, best bigint"), "links")
    rare = ranked.filter(~common).select("pair", F.col("n").alias("count"), F.col("best").alias("first"))
    open_links = parts.filter("pair >= 0").join(rare, "pair").select(
        "row", (F.col("n") * F.col("count")).alias("n"), F.when(F.col("first"), F.col("n")).otherwise(F.lit(0)).alias("best")
    )
    sums = parts.filter("pair < 0").select("row", "n", "best").unionByName(open_links)
    return sums.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder, packed tighter than usual, and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alignment(docs: DataFrame, a_path: str, b_path: str, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row of ``docs``."""
    found = kept(aligned(docs, a_path, b_path, pattern, doc, text), "aligned")
    ranked = written(ranked_pairs(written(pair_counts(found), "pairs")), "ranked")
    sums = link_sums(found, ranked)
    return found.join(sums, "row", "left").select(
        "doc", "n_a", "n_b", "n_groups", "n_links",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")], "groups_sha256",
    )
