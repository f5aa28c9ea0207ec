"""Spelling variants grouped by a frequency-vector trie.

Words are counted by Spark. A word's vector holds how often each letter group occurs in it;
the groups are the ``LEVELS - REST`` most frequent letters, one each, and ``REST`` groups of
the others. Arranged by successive counts the vectors form a trie. One inserted letter is a
surplus of one in one group, one deleted letter a deficit of one, a replaced letter at most one
of each. So a depth-first search that may spend one surplus and one deficit finds, in the
leaves it reaches, every word one edit away, and leaf words are verified letter by letter.

The trie is cut at a depth at which no subtree holds more than ``SHARD_WORDS`` words (or at its
leaves), and each subtree is searched by one task. A word goes to its own subtree and to those
its budget reaches; of two directions only the one that starts with a surplus is taken, so a
pair is met once.

A word's form is its near word of most occurrences, if that has ``RATIO`` times its own; the
counts grow by that factor along a chain of forms, so chains are short and pointer jumping
follows them in a few joins.

Null or empty texts have no words. A null id counts as the empty string in the digest that
thins words out. Repeated rows count each time. Other columns play no part. An empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.store import written

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Maximal runs of letters; shorter ones cannot become words.
RUN = "[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run loses a letter where this divides its digest.
THIN = 199
LEVELS, REST = 24, 4
SHARD_WORDS = 10_000
#: Trie nodes that a search expands at a time.
BLOCK = 200_000

NEAR = "word string, n bigint, near string, near_n bigint"


def word_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)`` of all words long and frequent enough."""
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("of"), run.alias("run"))
    lowered = runs.select("of", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = lowered.withColumn("h", F.crc32(F.concat_ws(":", "of", "run")))
    place = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % THIN == 0, shorter).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def letter_groups(words: DataFrame) -> list[int]:
    """The group of each Latin-1 code point, by the letters' occurrences in ``words`` (a row for
    each letter of the alphabet at most)."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    order = [r["letter"] for r in sorted(letters, key=lambda r: (-r["count"], r["letter"]))]
    group = [LEVELS - 1] * 256
    for k, letter in enumerate(order):
        if letter:
            group[ord(letter)] = k if k < LEVELS - REST else LEVELS - REST + k % REST
    return group


def _latin(column):
    """``(bytes, offsets)``: a byte for each letter of a column of words."""
    import numpy as np

    words = [w.encode("latin-1") for w in column.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.frombuffer(b"".join(words), np.uint8), offsets


def _vectors(raw, offsets, group):
    import numpy as np

    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * LEVELS + np.array(group)[raw], minlength=n * LEVELS)
    return counts.reshape(n, LEVELS).astype(np.int32)


def placed(words: DataFrame, group: list[int], depth: int, sent: bool) -> DataFrame:
    """``(path, own, word, n)``: each word under the path of its subtree and, where ``sent``, under
    those that one surplus, or a surplus and a later deficit, lead to."""

    def place(batches):
        import numpy as np
        import pyarrow as pa

        steps = [(i, j) for i in range(depth) for j in (None, *range(i + 1, depth))] if sent else []
        for whole in batches:
            for at in range(0, whole.num_rows, 4_096):
                batch = whole.slice(at, 4_096)
                prefix = _vectors(*_latin(batch.column("word")), group)[:, :depth]
                for step in [None, *steps]:
                    path, rows = prefix.copy(), np.arange(len(prefix))
                    if step is not None:
                        up, down = step
                        path[:, up] += 1
                        if down is not None:
                            rows = np.flatnonzero(path[:, down] > 0)
                            path[:, down] -= 1
                    paths = pa.array([x.tobytes() for x in path[rows]], pa.binary())
                    own = pa.array(np.full(len(rows), step is None))
                    word, n = (batch.column(c).take(pa.array(rows)) for c in ("word", "n"))
                    yield pa.RecordBatch.from_arrays([paths, own, word, n], names=["path", "own", "word", "n"])

    return words.select("word", "n").mapInArrow(place, "path binary, own boolean, word string, n bigint")


def cut_depth(words: DataFrame, group: list[int]) -> int:
    """The depth at which every subtree has ``SHARD_WORDS`` words at most, or that of the leaves."""
    if words.count() <= SHARD_WORDS:
        return 0
    sizes = written(placed(words, group, LEVELS, False).groupBy("path").agg(F.count("*").alias("n")), "leaves")
    for depth in range(1, LEVELS):
        subtree = sizes.groupBy(F.substring("path", 1, 4 * depth)).agg(F.sum("n").alias("n"))
        if subtree.agg(F.max("n")).first()[0] <= SHARD_WORDS:
            return depth
    return LEVELS


class Trie:
    """Sorted vectors as a trie: a node is a run of rows that agree up to its depth."""

    def __init__(self, vectors, depth: int):
        import numpy as np

        self.depth, rows = depth, len(vectors)
        differs = np.zeros(rows, bool)
        differs[:1] = True
        self.starts, self.values = {depth: np.flatnonzero(differs)}, {}
        for k in range(depth, LEVELS):
            differs[1:] |= vectors[1:, k] != vectors[:-1, k]
            self.starts[k + 1] = np.flatnonzero(differs)
            self.values[k] = vectors[self.starts[k + 1], k]
        self.children = {
            k: np.append(np.searchsorted(self.starts[k + 1], self.starts[k]), len(self.starts[k + 1]))
            for k in range(depth, LEVELS)
        }
        self.ends = np.append(self.starts[LEVELS][1:], rows)

    def search(self, queries, surplus, deficit):
        """Blocks (query, row) of all rows within the budget; ``surplus`` and ``deficit`` say what a
        query may still spend. Depth first, so few blocks wait at any time."""
        import numpy as np

        n = len(queries)
        waiting = [(self.depth, np.arange(n), np.zeros(n, np.int64), surplus, deficit)] if len(self.starts[LEVELS]) else []
        while waiting:
            k, query, node, more, less = waiting.pop()
            first = self.children[k][node] if k < LEVELS else self.starts[k][node]
            many = (self.children[k][node + 1] if k < LEVELS else self.ends[node]) - first
            if many.sum() > BLOCK and len(query) > 1:
                half = len(query) // 2
                for part in (slice(half, None), slice(half)):
                    waiting.append((k, query[part], node[part], more[part], less[part]))
                continue
            which = np.repeat(np.arange(len(query)), many)
            below = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + first[which]
            if k == LEVELS:
                yield query[which], below
                continue
            step = self.values[k][below] - queries[query[which], k]
            on = (step == 0) | ((step == 1) & more[which]) | ((step == -1) & less[which])
            which, below, step = which[on], below[on], step[on]
            if len(which):
                waiting.append((k + 1, query[which], below, more[which] & (step != 1), less[which] & (step != -1)))


def one_edit(raw, offsets, a, b):
    """Whether words a and b (of one length or lengths that differ by one) are one edit apart."""
    import numpy as np

    size = np.diff(offsets)
    short, long = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    found = np.zeros(len(a), bool)
    order = np.lexsort((size[long], size[short]))
    pair = np.stack([size[short], size[long]])[:, order]
    cuts = [0, *(np.flatnonzero((pair[:, 1:] != pair[:, :-1]).any(0)) + 1).tolist(), len(order)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i == j:
            continue
        few, more = (int(x) for x in pair[:, i])
        step = max(1, 4_000_000 // max(more, 1))
        for at in range(i, j, step):
            rows = order[at : min(j, at + step)]
            s = raw[offsets[short[rows]][:, None] + np.arange(few)]
            t = raw[offsets[long[rows]][:, None] + np.arange(more)]
            if few == more:
                found[rows] = (s != t).sum(1) == 1
            elif more - few == 1:
                ahead = np.logical_and.accumulate(s == t[:, :few], axis=1).sum(1)
                behind = np.logical_and.accumulate((s == t[:, 1:])[:, ::-1], axis=1).sum(1)
                found[rows] = ahead + behind >= few
    return found


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)`` of all words one edit apart, in both directions."""
    group = letter_groups(words)
    depth = cut_depth(words, group)

    def search(table):
        import numpy as np
        import pyarrow as pa

        path = np.frombuffer(table.column("path")[0].as_py(), np.int32)
        own = np.flatnonzero(table.column("own").to_numpy())
        raw, offsets = _latin(table.column("word"))
        vectors = _vectors(raw, offsets, group)
        own = own[np.lexsort(vectors[own].T[::-1])] if len(own) else own
        gap = path[None, :] - vectors[:, :depth]
        more, less = ~(gap == 1).any(1), ~(gap == -1).any(1)
        mine = np.zeros(len(vectors), bool)
        mine[own] = True
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, row in Trie(vectors[own], depth).search(vectors, more, less):
            b = own[row]
            once = ~mine[a] | (a < b)
            a, b = a[once], b[once]
            near = one_edit(raw, offsets, a, b)
            left.append(a[near])
            right.append(b[near])
        a, b = np.concatenate(left), np.concatenate(right)
        word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
        here, there = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
        return pa.Table.from_arrays(
            [word.take(here), n.take(here), word.take(there), n.take(there)], names=["word", "n", "near", "near_n"]
        )

    return placed(words, group, depth, True).groupBy("path").applyInArrow(search, NEAR)


def spelling_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word."""
    words = written(word_counts(docs, doc, text), "words")
    least = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), least.alias("best"))
    wide = words.join(near, "word", "left").withColumn("most", -F.col("best.minus"))
    formed = F.col("most") >= RATIO * F.col("n")
    wide = wide.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, F.col("most")).alias("form_n"),
    )
    wide = written(wide, "forms")
    most = wide.agg(F.max("n")).first()[0] or 1
    longest = math.ceil(math.log(max(most, RATIO) / LEAST_COUNT, RATIO)) + 1  # counts grow along a chain
    roots = wide.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(1, longest).bit_length()):
        over = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(over, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return wide.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
