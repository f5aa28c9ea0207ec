"""Which features of a document occur in other documents too - without a row per feature.

Every task turns its texts into hashed features and packs them, by leading bits, into one
block per bucket: four bytes a feature plus a short table of documents, as steps of a byte or two. A bucket's task
sorts the features of all documents that begin with its bits, and hands back only those that
more than one document has, packed again, by parts of the documents. The four bytes
and the bucket's bits make a shared feature a candidate only: different features may meet, so
documents seem to share too much, never too little, and what is built on top compares texts.

Blocks of a bucket are about as large as a shuffle partition of the input's text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.words import give_back, scrambled, signatures, slices, text_bytes

BLOCKS = "bucket int, ids binary, counts binary, features binary, codes binary"
SHARED = "doc bigint, size int, lost int, sign bigint, sign2 bigint, features array<bigint>, documents array<int>"
MET = "part int, kind int, top int, ids binary, counts binary, features binary, more binary"


def bucket_bits(df: DataFrame) -> int:
    """Buckets: the largest power of two up to the number of shuffle partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(12, parts.bit_length() - 1))


def packed(docs: DataFrame, doc: str, text: str, features: Callable, sized: bool) -> DataFrame:
    """Blocks of features. ``features(raw, offsets)`` gives arrays (document, hash, code) of a slice
    of texts, sorted by document; code is None or four bytes that say more of the feature. With
    ``sized`` the third is a second hash, and each document's number of features is sent too,
    its signature and how many features it loses where only the sent bits tell them apart."""
    bits = bucket_bits(docs)

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        names, kinds = ["bucket", "ids", "counts", "features", "codes"], [pa.int32(), *[pa.binary()] * 4]

        def blocks(batch):
            ids = batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
            raw, offsets = text_bytes(batch.column("text"))
            owner, value, code = features(raw, offsets)
            rows, other = [], code
            code = None if sized else code
            bucket = (value >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(2**bits + 1))
            low = (value >> np.uint64(32 - bits)).astype(np.uint32)
            for b in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[b] : cuts[b + 1]]
                who, counts = np.unique(owner[mine], return_counts=True)
                more = b"" if code is None else code[mine].tobytes()
                rows.append((int(b), stepped(ids[who]), stepped(counts), low[mine].tobytes(), more))
            if sized:
                size = np.bincount(owner, minlength=len(ids)).astype(np.int32)
                sent = value >> np.uint64(32 - bits)  # sorted within a document, as the hashes are
                same = (sent[1:] == sent[:-1]) & (owner[1:] == owner[:-1])
                lost = np.bincount(owner[1:][same], minlength=len(ids))
                more = np.column_stack([lost, signatures(owner, value, other, len(ids))]).astype(np.int64)
                rows.append((-1 - int(ids[0] % 2**bits), stepped(ids), stepped(size), more.tobytes(), b""))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        give_back()
        yield from map(blocks, slices(batches, "text"))
        give_back(everything=False)  # the worker may stay idle through other steps

    given = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return given.mapInArrow(pack, BLOCKS)


def stepped(values) -> bytes:
    """Whole numbers as the first one and the steps between them, in as few bytes as the largest step
    needs. A document has few features in a bucket once there are many buckets, so plain ids and
    counts would take more than the features."""
    import numpy as np

    if not len(values):
        return b""
    values = np.asarray(values, np.int64)
    steps = np.diff(values)  # modulo 2**64, as is adding them up
    most, least = (int(steps.max()), int(steps.min())) if len(steps) else (0, 0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + values[:1].tobytes() + steps.astype(kind).tobytes()


def unstepped(packs, kind):
    """The numbers of several ``stepped`` one after another."""
    import numpy as np

    parts = [np.zeros(0, kind)]
    for raw in packs:
        if raw:
            steps = np.frombuffer(raw, f"i{raw[0]}", offset=9)
            first = np.frombuffer(raw, np.int64, 1, 1)
            parts.append(np.cumsum(np.concatenate([first, steps]), dtype=np.int64).astype(kind))
    return np.concatenate(parts)


class Bucket:
    """All features of a bucket, equal ones side by side in the order of arrival."""

    def __init__(self, key, table, bits: int):
        import numpy as np

        give_back()
        self.number, self.bits = key[0].as_py(), bits
        self.ids = unstepped(table.column("ids").to_pylist(), np.int64)
        counts = unstepped(table.column("counts").to_pylist(), np.int32)
        if self.number < 0:
            self.sizes, self.signs = counts, self.joined(table, "features", np.int64).reshape(-1, 3)
            return
        # four bytes a place wherever that is enough: a bucket's arrays are the largest there are
        key = self.joined(table, "features", np.uint32).astype(np.uint64)
        key <<= np.uint64(32)
        key |= np.arange(len(key), dtype=np.uint64)
        key.sort()
        self.order = key.astype(np.uint32)
        key >>= np.uint64(32)
        self.low = key.astype(np.uint32)
        del key
        who = np.repeat(np.arange(len(self.ids), dtype=np.uint32), counts)
        self.doc = self.ids[who[self.order]]
        del who
        new = np.ones(len(self.low), bool)
        new[1:] = self.low[1:] != self.low[:-1]
        self.first, self.group = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
        self.other = new  # not the same document as the one before, of the same feature
        self.other[1:] |= self.doc[1:] != self.doc[:-1]

    @staticmethod
    def joined(table, name, kind):
        import numpy as np

        return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])


def widened(top: int, low, bits: int):
    """64-bit features again; their bits beyond the bucket's and the 32 sent are zero."""
    import numpy as np

    return ((low.astype(np.uint64) << np.uint64(32 - bits)) | np.uint64(top << (64 - bits))).view(np.int64)


def dealt(bits: int, doc, features, more=None, kind: int = 0, top: int = 0):
    """Found features as packed rows, one for each part of the documents; those of kind 0
    as the four bytes sent, for ``widened``."""
    import numpy as np
    import pyarrow as pa

    part = (scrambled(doc.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((doc, part))
    doc, features, part = doc[order], features[order], part[order]
    more = None if more is None else more[order]
    cuts = np.searchsorted(part, np.arange(2**bits + 1))
    rows = []
    for p in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[p], cuts[p + 1]
        who, counts = np.unique(doc[a:b], return_counts=True)
        extra = b"" if more is None else stepped(more[a:b])
        rows.append((int(p), kind, top, stepped(who), stepped(counts), features[a:b].tobytes(), extra))
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = [*[pa.int32()] * 3, *[pa.binary()] * 4]
    names = ["part", "kind", "top", "ids", "counts", "features", "more"]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def gathered(found: DataFrame, bits: int, marked: bool = False) -> DataFrame:
    """One row per document from the packed rows of all buckets. ``marked``: ``more`` is the lowest
    bit of a feature, else a count."""

    def gather(table):
        import numpy as np
        import pyarrow as pa

        give_back()
        kind = table.column("kind").to_numpy()
        one = lambda k, name, t: unstepped(table.column(name).filter(pa.array(kind == k)).to_pylist(), t)
        doc = np.repeat(one(0, "ids", np.int64), one(0, "counts", np.int32))
        sent = table.filter(pa.array(kind == 0))
        lows = [np.frombuffer(x, np.uint32) for x in sent.column("features").to_pylist()]
        wide = [widened(top, low, bits) for top, low in zip(sent.column("top").to_pylist(), lows, strict=True)]
        features = np.concatenate([np.zeros(0, np.int64), *wide])
        if marked:
            features |= one(0, "more", np.int8).astype(np.int64)
            more = np.zeros(len(doc), np.int32)
        else:
            more = one(0, "more", np.int32)
        order = np.lexsort((features, more, doc))
        doc, features, more = doc[order], features[order], more[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (features[1:] != features[:-1])
        doc, features, more = doc[new], features[new], more[new]
        sized = np.repeat(one(1, "ids", np.int64), one(1, "counts", np.int32))
        every = np.unique(np.concatenate([doc, sized]))
        offsets = pa.array(np.append(np.searchsorted(doc, every), len(doc)).astype(np.int32))
        at, sizes = np.searchsorted(every, sized), np.zeros(len(every), np.int32)
        np.maximum.at(sizes, at, one(1, "more", np.int32))  # rows that share an id: the largest
        signs = table.column("features").filter(pa.array(kind == 1)).to_pylist()
        told, said = np.zeros((len(every), 3), np.int64), np.frombuffer(b"".join(signs), np.int64).reshape(-1, 3)
        told[at] = said
        several = np.zeros(len(every), bool)  # rows of one id, but different texts: no signature
        several[at[(said[:, 1:] != told[at, 1:]).any(axis=1)]] = True
        np.maximum.at(told[:, 0], at, said[:, 0])
        return pa.Table.from_arrays(
            [pa.array(every), pa.array(sizes), pa.array(told[:, 0].astype(np.int32)),
             *[pa.array(told[:, k], mask=several) for k in (1, 2)], pa.ListArray.from_arrays(offsets, pa.array(features)),
             pa.ListArray.from_arrays(offsets, pa.array(more))],
            names=["doc", "size", "lost", "sign", "sign2", "features", "documents"],
        )

    return found.groupBy("part").applyInArrow(gather, SHARED)


def shared_features(docs: DataFrame, doc: str, text: str, features: Callable) -> DataFrame:
    """A row (doc, size, lost, sign, sign2, features, documents) for every document: the number of
    features, which must be distinct, how many of them the sent bits do not tell apart, a digest
    of all of them, those that several documents have, each once, and how many documents have
    each; ordered by that number, then by feature."""
    bits = bucket_bits(docs)

    def meet(key, table):
        import numpy as np

        b = Bucket(key, table, bits)
        if b.number < 0:
            return dealt(bits, b.ids, b.signs, b.sizes, 1)
        documents = np.bincount(b.group, b.other).astype(np.int32)[b.group]
        keep = (documents > 1) & b.other
        doc, low, documents, top = b.doc[keep], b.low[keep], documents[keep], b.number
        del b, keep
        give_back(everything=False)
        return dealt(bits, doc, low, documents, top=top)

    return gathered(packed(docs, doc, text, features, True).groupBy("bucket").applyInArrow(meet, MET), bits)


def met_features(docs: DataFrame, doc: str, text: str, features: Callable) -> DataFrame:
    """A row (doc, features) for every document with features that several documents have. The
    lowest bit is 0 where all of them have the feature with one code - then it is told to every
    document but the smallest - and 1 where codes differ, which is told to all."""
    bits = bucket_bits(docs)

    def meet(key, table):
        import numpy as np

        b = Bucket(key, table, bits)
        code = b.joined(table, "codes", np.uint32)[b.order]
        shared = np.bincount(b.group, b.other) > 1
        mixed = np.maximum.reduceat(code, b.first) != np.minimum.reduceat(code, b.first)
        least = np.minimum.reduceat(b.doc, b.first)
        keep = shared[b.group] & b.other & (mixed[b.group] | (b.doc > least[b.group]))
        doc, low, mixed, top = b.doc[keep], b.low[keep], mixed[b.group[keep]].astype(np.int8), b.number
        del b, code, shared, least, keep
        give_back(everything=False)
        return dealt(bits, doc, low, mixed, top=top)

    met = packed(docs, doc, text, features, False).groupBy("bucket").applyInArrow(meet, MET)
    return gathered(met, bits, True).select("doc", "features")
