"""Suffix-array removal of long repeats.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. Equal strings are brought together by anchors: the least hash among the
``GRAM``-byte strings inside a window of LENGTH bytes depends on the window alone, so every
window is owned by one place of the text, and the windows owned by one place are a short
segment. Only segments whose anchor several documents share are taken further.

Equal segments become one row with the smallest id that has it. Shards of segments, dealt by
anchor, each get suffix arrays over blocks of bounded size: suffixes are ranked by 8 bytes
and refined by Larsson and Sadakane's doubling of the sorted depth, groups that are already
single being left alone; Kasai's pass in text order gives the common prefixes of neighbours,
and runs of LENGTH or more are classes of equal windows. The blocks' sorted classes are
merged by binary search, which tells for every window the smallest id of all.

An anchor that very many different segments share (the edge of a line that is everywhere)
is not one shard's work: its segments are cut into single windows, dealt by their bytes.

Null or short texts lose nothing. Rows without an id are kept whole and take no part. Rows
that share an id are judged as one document of that id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.features import bucket_bits, met_features
from wardline.llm.store import written
from wardline.llm.words import Prefixes, scrambled, slices, text_bytes

LENGTH = 50
GRAM = 20
WINDOW = LENGTH - GRAM + 1
BLOCK_BYTES = 1_500_000
#: An anchor in more different segments than this, and than a shard has on average, is cut up.
HOT_SEGMENTS = 500
SEGMENTS = "doc bigint, start int, windows int, anchor bigint, segment binary"
MASKS = "anchor bigint, code bigint, mask bigint"


def owned(raw, offsets):
    """``(document, first window, number of windows, anchor hash)`` of every owning place;
    windows are named by their first byte in the slice."""
    import numpy as np

    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    gram = Prefixes(raw).rolling(GRAM)
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size * 2 <= WINDOW:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    least = np.minimum(least[: len(raw) - LENGTH + 1], least[WINDOW - size : WINDOW - size + len(raw) - LENGTH + 1])
    pick = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)[: len(pick)]
    window = np.flatnonzero(np.arange(len(pick)) + LENGTH <= offsets[owner + 1])
    if not len(window):
        return none, none, none, np.zeros(0, np.uint64)
    pick, owner = pick[window], owner[window]
    new = np.ones(len(pick), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    # anchors are least hashes and so mostly small numbers: scrambled again to spread evenly
    return owner[first], window[first], np.diff(np.append(first, len(pick))), scrambled(gram[pick[first]])


def anchors(raw, offsets):
    """``(document, anchor hash, segment hash)`` of every owning place."""
    import numpy as np

    owner, start, windows, gram = owned(raw, offsets)
    if not len(owner):
        return owner, gram, np.zeros(0, np.uint32)
    code = Prefixes(raw).hashes(start, start + windows + LENGTH - 1)
    return owner, gram, (code >> np.uint64(32)).astype(np.uint32)


def ragged(values, starts, lengths):
    """``(offsets, bytes)`` of the runs of ``values`` one after another."""
    import numpy as np

    ends = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)
    return ends.astype(np.int32), values[index]


def told(batch, column: str, owner, gram, bits: int):
    """Two masks over places: anchors told with bit 0 and anchors told with bit 1."""
    import numpy as np

    lists = batch.column(column)
    many = np.diff(lists.offsets.to_numpy())
    features = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    drop = np.uint64(32 - bits)
    salt = lambda i: scrambled(np.asarray(i, np.uint64) + np.uint64(1))
    known = (features >> drop) ^ salt(np.repeat(np.arange(len(many)), many))
    mine = (gram >> drop) ^ salt(owner)
    odd = features & np.uint64(1) == 1
    return np.isin(mine, known[~odd]), np.isin(mine, known[odd])


def open_segments(docs: DataFrame, doc: str, text: str, wanted: DataFrame) -> DataFrame:
    """All segments whose anchor stands in different segments of several documents."""
    bits = bucket_bits(docs)
    odd = wanted.select("doc", F.filter("wanted", lambda x: x.bitwiseAND(F.lit(1)) == 1).alias("wanted"))
    given = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).join(
        odd.filter(F.size("wanted") > 0).hint("shuffle_hash"), "doc"
    )

    def cut(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            raw, offsets = text_bytes(batch.column("text"))
            owner, start, windows, gram = owned(raw, offsets)
            keep = told(batch, "wanted", owner, gram, bits)[1]
            owner, start, windows, gram = owner[keep], start[keep], windows[keep], gram[keep]
            ends, data = ragged(raw, start, windows + LENGTH - 1)
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner], pa.int64()), pa.array(start - offsets[owner], pa.int32()), pa.array(windows, pa.int32()),
                 pa.array(gram.view("int64")),
                 pa.BinaryArray.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])],
                names=["doc", "start", "windows", "anchor", "segment"],
            )

    return given.mapInArrow(cut, SEGMENTS)


def refine(raw, ends):
    """Ranks of all suffixes of a block by their first 64 bytes, never past their segment's
    end: 8 bytes by sorting packed words, then Larsson and Sadakane's doubling."""
    import numpy as np

    n = len(raw)
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n)
    word = np.zeros(n, np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    for k in range(8):
        word |= np.where(left > k, padded[k : k + n], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.argsort(word, kind="stable")
    rank = np.empty(n, np.int64)

    def number(order, key, base):
        """Ranks are the place of a group's first member, so later refinements fit inside."""
        new = np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        rank[order] = np.repeat(base[first], np.diff(np.append(first, len(order))))
        return np.repeat(np.diff(np.append(first, len(order))) > 1, np.diff(np.append(first, len(order))))

    places = np.arange(n)
    open_ = number(order, word[order], places)
    depth = 8
    while depth < LENGTH and open_.any():
        order, places = order[open_], places[open_]
        behind = np.where(left[order] > depth, rank[np.minimum(order + depth, n - 1)] + 1, 0)
        key = (rank[order].astype(np.uint64) << np.uint64(32)) | behind.astype(np.uint64)
        sort = np.argsort(key, kind="stable")
        order, key = order[sort], key[sort]
        open_ = number(order, key, places)
        depth *= 2
    return rank


def common_prefixes(raw, starts, windows, before, place):
    """Kasai's pass over every segment side by side: for each window, in text order, how many
    bytes (up to LENGTH) it shares with the window sorted before it; -1 where there is none.
    What a window shares is at least what the one a byte earlier shared, less one - if that
    one's neighbour has a window a byte later too and it is sorted before this one; ``place``
    gives each window's place in the sorted order, and one beyond all where there is none."""
    import numpy as np

    lengths = np.zeros(len(before), np.int64)
    first = np.cumsum(windows) - windows
    shared = np.zeros(len(starts), np.int64)
    for step in range(int(windows.max(initial=0))):
        lane = np.flatnonzero(windows > step)
        here, there = starts[lane] + step, before[first[lane] + step]
        h = np.zeros(len(lane), np.int64)
        if step:
            last = before[first[lane] + step - 1]
            follows = (last >= 0) & (place[last + 1] < place[here]) & (there >= 0)
            h = np.where(follows, np.maximum(shared[lane] - 1, 0), 0)
        alive = np.flatnonzero(there >= 0)
        while len(alive):
            more = raw[here[alive] + h[alive]] == raw[there[alive] + h[alive]]
            alive = alive[more]
            h[alive] += 1
            alive = alive[h[alive] < LENGTH]
        shared[lane] = h
        lengths[first[lane] + step] = np.where(there >= 0, h, -1)
    return lengths


def block_classes(raw, ends, first_doc):
    """``(class of each window, windows' bytes and smallest id of each class)`` of a block;
    windows are in text order, classes in sorted order."""
    import numpy as np

    sizes = np.diff(np.concatenate([[0], ends]))
    windows = sizes - (LENGTH - 1)
    starts = ends - sizes
    _, window = ragged(np.arange(len(raw)), starts, windows)
    order = np.argsort(refine(raw, ends)[window], kind="stable")
    before = np.full(len(window), -1, np.int64)
    before[order[1:]] = window[order[:-1]]
    place = np.full(len(raw) + 1, len(order), np.int64)
    place[window[order]] = np.arange(len(order))
    lcp = common_prefixes(raw, starts, windows, before, place)[order]
    number = np.cumsum(lcp < LENGTH) - 1
    heads = np.flatnonzero(lcp < LENGTH)
    doc = np.repeat(first_doc, windows)[order]
    least = np.minimum.reduceat(doc, heads)
    of_window = np.empty(len(window), np.int64)
    of_window[order] = number
    text = raw[window[order[heads]][:, None] + np.arange(LENGTH)]
    return of_window, np.ascontiguousarray(text).view(f"S{LENGTH}").ravel(), least


def merge_classes(merged, classes):
    """Put a block's sorted classes into the merged ones, by binary search."""
    import numpy as np

    (keys, least), (more, ids) = merged, classes
    if not len(keys):
        return more, ids
    at = np.minimum(np.searchsorted(keys, more), len(keys) - 1)
    hit = keys[at] == more
    least = least.copy()
    least[at[hit]] = np.minimum(least[at[hit]], ids[hit])
    place = np.searchsorted(keys, more[~hit])
    return np.insert(keys, place, more[~hit]), np.insert(least, place, ids[~hit])


def _shard(table):
    """Per segment the mask of windows that a document with a smaller id has too."""
    import numpy as np
    import pyarrow as pa

    column = table.column("segment").combine_chunks()
    raw, offsets = text_bytes_of(column)
    docs = table.column("first").to_numpy()
    ends = offsets[1:]
    block = ((ends - 1) // BLOCK_BYTES) if len(ends) else ends
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(ends)]
    parts, merged = [], (np.zeros(0, f"S{LENGTH}"), np.zeros(0, np.int64))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = block_classes(raw[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a], docs[a:b])
        merged = merge_classes(merged, part[1:])
        parts.append((a, b, part[0], part[1]))
    mask = np.zeros(len(docs), np.int64)
    for a, b, of_window, keys in parts:
        least = merged[1][np.searchsorted(merged[0], keys)][of_window]
        windows = np.diff(offsets[a : b + 1]) - (LENGTH - 1)
        owner = np.repeat(np.arange(a, b), windows)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        np.bitwise_or.at(mask, owner, np.where(least < docs[owner], np.int64(1) << place, 0))
    return pa.table({"anchor": table.column("anchor"), "code": table.column("code"), "mask": pa.array(mask)})


def text_bytes_of(column):
    import numpy as np

    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def masks(classes: DataFrame) -> DataFrame:
    """``(anchor, code, mask)`` for classes of equal segments (anchor, code, segment, windows, first)."""
    shards = 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    usual = max(HOT_SEGMENTS, classes.count() // shards)
    crowds = classes.groupBy("anchor").agg(F.count("*").alias("crowd"))
    crowded = written(crowds.filter(F.col("crowd") > usual).select("anchor"), "crowded")
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    cold = classes.join(crowded, "anchor", "left_anti").select("anchor", "code", "segment", "first", shard)
    by_shard = cold.groupBy("shard").applyInArrow(_shard, MASKS)
    window = lambda i: F.substr("segment", i, F.lit(LENGTH))
    hot = classes.join(crowded, "anchor").select(
        "anchor", "code", "first", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("windows")), window)).alias("place", "window")
    )
    single = hot.groupBy("window").agg(F.min("first").alias("least"), F.max("first").alias("last")).filter("least < last")
    found = hot.join(single, "window").filter("least < first")
    bits = found.groupBy("anchor", "code").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
    return by_shard.unionByName(bits)


def repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, wanted, hits)``: per document the anchors whose windows all go (lowest bit 0), and
    other windows that go, as the first byte of a segment and a mask of its windows."""
    wanted = written(met_features(docs, doc, text, anchors).withColumnRenamed("features", "wanted"), "anchors")
    segments = written(open_segments(docs, doc, text, wanted), "segments")
    coded = segments.withColumn("code", F.xxhash64("segment"))
    same = ["anchor", "code"]
    classes = written(
        coded.groupBy(*same).agg(F.min("doc").alias("first"), F.first("segment").alias("segment"), F.first("windows").alias("windows")),
        "classes",
    )
    own = written(masks(classes).filter("mask <> 0"), "masks")
    # written, so that the join below has two plain sides and a segment that is everywhere can be split
    least = written(classes.select(*same, "first").join(own, same, "left"), "least")
    said = coded.select("doc", "start", "windows", *same).join(least, same)
    later = F.col("doc") > F.col("first")
    hits = said.filter(later | F.col("mask").isNotNull()).select(
        "doc", "start", F.when(later, F.expr("shiftleft(1L, windows) - 1")).otherwise(F.col("mask")).alias("mask")
    )
    hits = hits.groupBy("doc").agg(F.collect_list(F.struct("start", "mask")).alias("hits"))
    even = F.filter("wanted", lambda x: x.bitwiseAND(F.lit(1)) == 0)
    return wanted.select("doc", even.alias("wanted")).join(hits, "doc", "left")


REMOVED = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<start:int,end:int>>"


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (remaining bytes) and ``spans``
    (removed runs of bytes) for each row of ``docs``."""
    found = written(repeats(docs, doc, text), "repeats")
    kind = dict(docs.dtypes)[doc]
    bits = bucket_bits(docs)
    given = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).join(found.hint("shuffle_hash"), "doc", "left")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, "text"):
            raw, offsets = text_bytes(batch.column("text"))
            edge = np.zeros(len(raw) + 1, np.int64)
            owner, first, windows, gram = owned(raw, offsets)
            every = told(batch, "wanted", owner, gram, bits)[0]
            np.add.at(edge, first[every], 1)
            np.add.at(edge, first[every] + windows[every] + LENGTH - 1, -1)
            lists = batch.column("hits")
            many = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            start, mask = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            owner = np.repeat(np.arange(len(many)), many)
            for bit in range(WINDOW):
                on = (mask >> bit) & 1 == 1
                at = offsets[owner[on]] + start[on] + bit
                np.add.at(edge, at, 1)
                np.add.at(edge, at + LENGTH, -1)
            gone = np.cumsum(edge)[:-1] > 0
            size = np.diff(offsets)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[offsets[1:]] - total[offsets[:-1]]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = offsets[:-1][(offsets[:-1] < len(raw)) & (size > 0)]
            begins[inner] = gone[inner]
            stops = gone.copy()
            stops[:-1] &= ~gone[1:]
            last = offsets[1:][size > 0] - 1
            stops[last] = gone[last]
            a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
            of = np.searchsorted(offsets, a, "right") - 1
            spans = np.bincount(of, minlength=len(size))
            place = pa.array(np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int32))
            kept = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, place.buffers()[1], pa.py_buffer(raw[~gone].tobytes())])
            pairs = pa.StructArray.from_arrays(
                [pa.array(a - offsets[of], pa.int32()), pa.array(b - offsets[of], pa.int32())], ["start", "end"]
            )
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spans)]).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *[pa.array(x, pa.int64()) for x in (size, removed, spans)], kept, runs],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
            )

    return given.mapInArrow(cut, f"doc {kind}, {REMOVED}")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select(
        F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
