"""Language-model scoring by logistic context mixing over bits.

Every byte is eight binary decisions. For contexts of 0 to 3 preceding bytes, hashed to a
bounded number of slots, counters say how often each decision was 1 in the training
documents. Their predictions are combined in the logistic domain with weights chosen by a
gate - the depth in the byte and how often the longest context was seen - that are learned
online, pass by pass over the training statistics, and the result is refined by an adaptive
map from (depth, prediction) to what really came. A text ends with a sign of its own, so the
probabilities of all texts add up to one.

The corpus is gathered as counts: of tokens, for the add-one unigram base, and of four-byte
strings, from which counters, weights and map are trained. Both grow with the input and stay
distributed; what is broadcast - counters, weights, map - is bounded by ``SLOTS``.

Documents are placed in chunks by a hash of their id, so a chunk's token counts can be
handed back to it by joins. Null texts are empty: one end token, one end sign. Rows are
scored one by one, repeated or null ids included (a null id counts as '').
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.store import written
from wardline.llm.words import lower_ascii, slices, text_bytes, word_digests, words

ORDERS = 4
SLOTS = 4_096
LEVELS = 16
RATE = 0.02
PASSES = 4
STEPS = 33
PRIOR = 0.05
END = 255
COUNTS = "kind int, chunk int, key bigint, n bigint"


def chunked(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``(doc, text, held_out, chunk)``; as many chunks as shuffle partitions."""
    plain = F.coalesce(F.col(doc).cast("string"), F.lit(""))
    chunks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(
        F.col(doc).alias("doc"),
        F.col(text).alias("text"),
        (F.crc32(F.encode(plain, "UTF-8")) % 7 == 2).alias("held_out"),
        F.pmod(F.xxhash64(plain), F.lit(chunks)).cast("int").alias("chunk"),
    )


def grams_of(raw, offsets):
    """``(document, last four bytes)`` of each byte and of the end sign; zeros before a text."""
    import numpy as np

    n = len(offsets) - 1
    sizes = np.diff(offsets)
    line = np.zeros(len(raw) + 4 * n, np.uint32)
    owner = np.repeat(np.arange(n), sizes)
    line[np.arange(len(raw)) + 4 * owner + 3] = raw
    ends = offsets[1:] + 4 * np.arange(n) + 3
    line[ends] = END
    gram = line.copy()
    for back in (1, 2, 3):
        gram[back:] |= line[:-back] << np.uint32(8 * back)
    keep = np.ones(len(line), bool)
    for k in range(3):
        keep[offsets[:-1] + 4 * np.arange(n) + k] = False
    return np.repeat(np.arange(n), sizes + 1), gram[keep]


def tokens_of(raw, offsets):
    """``(document, hash)`` of each word, letters A-Z lower-cased."""
    import numpy as np

    low = lower_ascii(raw)
    starts, ends, owner = words(low, offsets)
    if not len(starts):
        return owner, np.zeros(0, np.int64)
    return owner, word_digests(low, starts, ends)[:, 0].view(np.int64)


def _summed(keys, counts):
    import numpy as np

    keys, counts = np.concatenate(keys), np.concatenate(counts)
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, counts, len(unique)).astype(np.int64)


def _count(table):
    """Per chunk: each token with its count in training texts, each training gram with its count."""
    import numpy as np
    import pyarrow as pa

    chunk = table.column("chunk")[0].as_py()
    found = {0: ([], []), 1: ([], [])}
    for batch in slices(table.to_batches(), "text"):
        raw, offsets = text_bytes(batch.column("text"))
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        owner, token = tokens_of(raw, offsets)
        unique, at = np.unique(token, return_inverse=True)
        found[0][0].append(unique)
        found[0][1].append(np.bincount(at, train[owner], len(unique)))
        owner, gram = grams_of(raw, offsets)
        unique, n = np.unique(gram[train[owner]], return_counts=True)
        found[1][0].append(unique.astype(np.int64))
        found[1][1].append(n)
    parts = [(kind, *_summed(*found[kind])) for kind in found]
    return pa.table({
        "kind": pa.array(np.concatenate([np.full(len(k), kind) for kind, k, _ in parts]), pa.int32()),
        "chunk": pa.array(np.full(sum(len(k) for _, k, _ in parts), chunk), pa.int32()),
        "key": pa.array(np.concatenate([k for _, k, _ in parts]), pa.int64()),
        "n": pa.array(np.concatenate([n for _, _, n in parts]), pa.int64()),
    })


def slot(gram, order: int):
    """The counter slot of the ``order`` bytes before the last one; works on columns and arrays."""
    kept = (gram // 256) % (256**order)
    return (kept * 2_654_435_761 // 65_536) % SLOTS if order > 1 else kept % SLOTS


class Mixer:
    """Counters, weights and map; predictions for grams."""

    def __init__(self, tree, weights, refined=None):
        self.tree, self.weights, self.refined = tree, weights, refined

    @staticmethod
    def empty():
        import numpy as np

        return np.full((8 * LEVELS, ORDERS), 0.3, np.float64)

    def stretched(self, grams):
        """Per gram and bit: inputs (orders), gate, bit."""
        import numpy as np

        grams = grams.astype(np.int64)
        byte = grams % 256
        nodes = np.stack([(256 + byte) >> (8 - d) for d in range(8)], 1)
        bits = np.stack([(byte >> (7 - d)) & 1 for d in range(8)], 1)
        inputs = np.empty((len(grams), 8, ORDERS))
        for order in range(ORDERS):
            at = slot(grams, order)[:, None]
            one, zero = self.tree[order][at, 2 * nodes + 1], self.tree[order][at, 2 * nodes]
            inputs[:, :, order] = np.log((one + PRIOR) / (zero + PRIOR))
        seen = np.minimum(np.log2(one + zero + 1), LEVELS - 1).astype(np.int64)
        return inputs, np.arange(8)[None, :] * LEVELS + seen, bits

    def mixed(self, grams):
        import numpy as np

        inputs, gate, bits = self.stretched(grams)
        return inputs, gate, bits, np.clip((inputs * self.weights[gate]).sum(2), -16, 16)

    def log_probability(self, grams):
        """Natural logarithm of each last byte's probability after the three before it."""
        import numpy as np

        _, gate, bits, x = self.mixed(grams)
        p = 1 / (1 + np.exp(-x))
        if self.refined is not None:
            p = (p + self.refined[gate // LEVELS, np.rint((x + 16) * (STEPS - 1) / 32).astype(np.int64)]) / 2
        return np.log(np.where(bits == 1, p, 1 - p)).sum(1)


def counters(grams: DataFrame):
    """Per order the counts of bit strings in every slot: trees with leaves 256 to 511."""
    import numpy as np

    rows = None
    for order in range(ORDERS):
        kept = F.expr(f"(key div 256) % {256**order}")
        at = F.expr(f"(((key div 256) % {256**order}) * 2654435761L div 65536) % {SLOTS}") if order > 1 else kept % SLOTS
        one = grams.select(F.lit(order).alias("o"), at.alias("s"), (F.col("key") % 256).alias("b"), "n")
        rows = one if rows is None else rows.unionByName(one)
    got = rows.groupBy("o", "s", "b").agg(F.sum("n").alias("n")).toPandas()  # at most ORDERS x SLOTS x 256 rows
    tree = np.zeros((ORDERS, SLOTS, 512), np.float32)
    tree[got["o"].to_numpy(), got["s"].to_numpy(), 256 + got["b"].to_numpy()] = got["n"].to_numpy()
    for node in range(255, 0, -1):
        tree[:, :, node] = tree[:, :, 2 * node] + tree[:, :, 2 * node + 1]
    return tree


def train(grams: DataFrame):
    """The mixer trained on (key, n) rows: grams and their counts."""
    import numpy as np

    spark = grams.sparkSession
    tree = spark.sparkContext.broadcast(counters(grams))
    spread = grams.repartition("key").sortWithinPartitions(F.xxhash64("key"))

    def online(batches):
        import pyarrow as pa

        mixer, mass = Mixer(tree.value, Mixer.empty()), np.zeros(8 * LEVELS)
        for batch in batches:
            grams, n = (batch.column(c).to_numpy() for c in ("key", "n"))
            for _ in range(PASSES):
                for at in range(0, len(grams), 512):
                    part, many = grams[at : at + 512], n[at : at + 512]
                    inputs, gate, bits, x = mixer.mixed(part)
                    error = (bits - 1 / (1 + np.exp(-x))) * many[:, None]
                    flat = gate.ravel()
                    weight = np.bincount(flat, np.repeat(many, 8), 8 * LEVELS)
                    for order in range(ORDERS):
                        step = np.bincount(flat, (error * inputs[:, :, order]).ravel(), 8 * LEVELS)
                        mixer.weights[:, order] += RATE * step / np.maximum(weight, 1)
            mass += np.bincount(mixer.stretched(grams)[1].ravel(), np.repeat(n, 8), 8 * LEVELS)
        rows = [(g, o, float(mixer.weights[g, o] * mass[g]), float(mass[g])) for g in np.flatnonzero(mass) for o in range(ORDERS)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)],
            names=["g", "o", "w", "m"],
        )

    weights = Mixer.empty()
    learned = spread.mapInArrow(online, "g int, o int, w double, m double").groupBy("g", "o")
    for r in learned.agg(F.sum("w").alias("w"), F.sum("m").alias("m")).collect():
        weights[r["g"], r["o"]] = r["w"] / r["m"]

    def outcomes(batches):
        import pyarrow as pa

        mixer, n = Mixer(tree.value, weights), np.zeros(8 * STEPS * 2)
        for batch in batches:
            _, gate, bits, x = mixer.mixed(batch.column("key").to_numpy())
            cell = ((gate // LEVELS) * STEPS + np.rint((x + 16) * (STEPS - 1) / 32).astype(np.int64)) * 2 + bits
            n += np.bincount(cell.ravel(), np.repeat(batch.column("n").to_numpy(), 8), len(n))
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(n[cells])], names=["cell", "n"])

    prior = np.repeat(1 / (1 + np.exp(-np.linspace(-16, 16, STEPS)))[None], 8, 0)
    table = np.zeros(8 * STEPS * 2)
    for r in grams.mapInArrow(outcomes, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r["cell"]] = r["n"]
    table = table.reshape(8, STEPS, 2)
    return Mixer(tree, weights, (table[:, :, 1] + 20 * prior) / (table.sum(2) + 20))


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score)`` of each row."""
    placed = chunked(docs, doc, text)
    kind = dict(docs.dtypes)[doc]
    counted = written(placed.groupBy("chunk").applyInArrow(_count, COUNTS), "lm-counts")
    tokens = counted.filter("kind = 0").groupBy("key").agg(F.sum("n").alias("c"))
    grams = written(counted.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "lm-grams")
    tokens = written(tokens.filter("c > 0"), "lm-tokens")
    known = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = placed.filter("NOT held_out").count()
    total, distinct = known["n"] + ends, known["v"] + (1 if ends else 0)
    mixer = train(grams)
    tree, weights, refined = mixer.tree, mixer.weights, mixer.refined
    back = counted.filter("kind = 0").select("chunk", "key").join(tokens, "key")
    names = ["doc", "held_out", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(key, left, right):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        model = Mixer(tree.value, weights, refined)
        keys, counts = right.column("key").to_numpy(), right.column("c").to_numpy()
        order = np.argsort(keys)
        keys, counts = np.append(keys[order], np.iinfo(np.int64).max), np.append(counts[order], 0)
        end = np.log10((ends + 1) / (total + distinct + 1))
        out = []
        for batch in slices(left.to_batches(), "text"):
            raw, offsets = text_bytes(batch.column("text"))
            n = batch.num_rows
            owner, token = tokens_of(raw, offsets)
            codes, unique = pd.factorize(token)
            at = np.searchsorted(keys, unique)
            c = np.where(keys[at] == unique, counts[at], 0)[codes]
            n_tokens = np.bincount(owner, minlength=n) + 1
            n_known = np.bincount(owner, c > 0, n).astype(np.int64) + (ends > 0)
            base = np.bincount(owner, np.log10((c + 1) / (total + distinct + 1)), n) + end
            owner, gram = grams_of(raw, offsets)
            codes, unique = pd.factorize(gram)
            cost = model.log_probability(unique) / np.log(10)
            out.append(pa.table([
                batch.column("doc"), batch.column("held_out"), pa.array(np.diff(offsets)), pa.array(n_tokens, pa.int64()),
                pa.array(n_known), pa.array(np.full(n, total), pa.int64()), pa.array(base),
                pa.array(np.bincount(owner, cost[codes], n)),
            ], names=names))
        if not out:
            empty = [left.schema.field("doc").type, pa.bool_(), *[pa.int64()] * 4, pa.float64(), pa.float64()]
            return pa.table([pa.array([], t) for t in empty], names=names)
        return pa.concat_tables(out)

    schema = f"doc {kind}, held_out boolean, n_bytes bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return placed.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, schema)


def digests(scored: DataFrame) -> DataFrame:
    bits = -F.col("score") * 3.321928094887362 / F.greatest(F.col("n_bytes"), F.lit(1))
    return scored.withColumnRenamed("doc", "doc_id").withColumn("bits_per_byte", bits)
