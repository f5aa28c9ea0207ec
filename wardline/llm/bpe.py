"""Byte-level BPE encoding and decoding with DuckDB inside each partition.

A partition's texts are split by the pretokenizer's pattern; pieces not met before become
rows (piece, position, token) of a recursive query that joins neighbours with the merge
table and contracts every piece's minimum-rank pair until no pair is left. Where several
copies of the minimum pair stand side by side, they are contracted from the left without
overlap in one round; that equals contracting the leftmost one again and again wherever no
merge can create a pair of a smaller rank, and ids for which it could are contracted one
at a time. A piece that is itself a token is that token. Decoding aggregates the bytes of
a piece's tokens in their order.

Long pieces are cut between bytes that no token holds side by side, where no merge can reach
across. What is left longer than ``LONG_PIECE`` is contracted round by round in tables that hold
one round; the recursive query, which holds all rounds, gets short parts only, ``BATCH_ROWS`` bytes
at a time. So an unbroken run of any length needs memory for one round; beyond the limit DuckDB
spills to a folder of the task.

The piece cache only saves work. It is bounded in pieces and in bytes, as a worker keeps it from task
to task: when it is full, pieces met once are dropped and of the others the most used stay. It is kept
in Arrow and numpy arrays, some 50 bytes a piece, where a Python object a piece took 300 and, scattered
among dropped ones, kept their memory from being given back. A worker lets it go when a task of another
kind asks for memory (``words.give_back``). Texts are worked on a slab of ``SLAB_BYTES`` at a time, and
what a slab needed is given back before the next, also by DuckDB, and after the last. Null texts count as empty: no tokens. Lone surrogates
cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.words import give_back, kept_by_worker, slices

CACHE_PIECES = 400_000
CACHE_BYTES = 16_000_000
LONG_PIECE = 48
BATCH_ROWS = 60_000
SLAB_BYTES = 500_000
SLAB_PIECES = 100_000

#: Rows carry their right neighbour, so a round is two joins and a grouping.
CONTRACT = """
WITH RECURSIVE step AS (
  SELECT piece, pos, token, tail, 0 AS round FROM begun
  UNION ALL
  SELECT s.piece, CASE WHEN s.pos > b.pos THEN s.pos - 1 ELSE s.pos END,
         CASE WHEN s.pos = b.pos THEN b.merged ELSE s.token END,
         CASE WHEN s.pos = b.pos THEN b.next WHEN s.pos + 1 = b.pos THEN b.merged ELSE s.tail END, s.round + 1
  FROM step s JOIN (
    SELECT c.piece, c.pos, c.merged, n.tail AS next
    FROM (
      SELECT piece, (least % 1024)::int AS pos, (least // 1024)::int AS merged
      FROM (
        SELECT piece, min(merged * 1024::bigint + pos) AS least
        FROM step JOIN merges ON head = token AND merges.tail = step.tail GROUP BY piece
      )
    ) c JOIN step n ON n.piece = c.piece AND n.pos = c.pos + 1
  ) b ON s.piece = b.piece
  WHERE s.pos <> b.pos + 1
)
SELECT step.piece, pos, token
FROM step JOIN (SELECT piece, max(round) AS round FROM step GROUP BY piece) l
  ON l.piece = step.piece AND l.round = step.round
"""
#: For long runs without a break: all safe places of the minimum pair in one round.
ROUND = [
    """
CREATE OR REPLACE TEMP TABLE scored AS
SELECT n.*, m.merged, m.single, min(m.merged) OVER (PARTITION BY piece) AS best
FROM (
  SELECT piece, pos, token, lead(token) OVER w AS following, row_number() OVER w AS idx
  FROM begun WINDOW w AS (PARTITION BY piece ORDER BY pos)
) n LEFT JOIN merges m ON m.head = n.token AND m.tail = n.following
""",
    "INSERT INTO done SELECT piece, pos, token FROM scored WHERE best IS NULL",
    """
CREATE OR REPLACE TEMP TABLE begun AS
SELECT piece, pos, CASE WHEN take THEN merged ELSE token END AS token
FROM (
  SELECT *, coalesce(lag(take) OVER (PARTITION BY piece ORDER BY pos), false) AS gone
  FROM (
    SELECT *, merged IS NOT DISTINCT FROM best AND CASE
        WHEN single THEN idx = min(CASE WHEN merged = best THEN idx END) OVER (PARTITION BY piece)
        WHEN token = following THEN (idx - coalesce(max(CASE WHEN merged IS DISTINCT FROM best THEN idx END)
             OVER (PARTITION BY piece ORDER BY pos), 0)) % 2 = 1
        ELSE true END AS take
    FROM scored WHERE best IS NOT NULL
  )
)
WHERE NOT gone
""",
]
DECODE = """
SELECT t.piece, string_agg(hex(v.bytes), '' ORDER BY t.pos) AS digits
FROM tokens t JOIN vocabulary v ON v.token = t.token GROUP BY t.piece ORDER BY t.piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of base64 tokens and their ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int, bool]]:
    """``(head, tail, merged, single)``: all pairs of tokens that join to a token. ``single``
    marks results that can be part of a pair of smaller rank."""
    rows = []
    for whole, rank in ranks.items():
        for cut in range(1, len(whole)):
            head, tail = ranks.get(whole[:cut]), ranks.get(whole[cut:])
            if head is not None and tail is not None:
                rows.append((head, tail, rank))
    risky = {x for head, tail, merged in rows for x in (head, tail) if x > merged}
    return [(h, t, m, m in risky) for h, t, m in rows]


class PieceCoder:
    """Tokens and decoded bytes of distinct pieces, by DuckDB."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb
        import numpy as np
        import pyarrow as pa

        self.ranks = ranks
        self.single_bytes = [ranks[bytes([b])] for b in range(256)]
        self.joined = np.zeros(65_536, bool)  # two bytes that some token holds side by side
        for token in ranks:
            raw = np.frombuffer(token, np.uint8).astype(np.int32)
            self.joined[raw[:-1] << 8 | raw[1:]] = True
        self.spill = tempfile.TemporaryDirectory(prefix="wardline-bpe-")
        # DuckDB's allocator keeps 128 MB of freed memory unless told to give it back
        settings = {"threads": 1, "memory_limit": "400MB", "allocator_flush_threshold": "1MB", "allocator_bulk_deallocation_flush_threshold": "1MB"}
        self.con = duckdb.connect(config={**settings, "temp_directory": self.spill.name})
        head, tail, merged, single = zip(*merge_rows(ranks), strict=True)
        merges = pa.table({"head": pa.array(head, pa.int32()), "tail": pa.array(tail, pa.int32()),
                           "merged": pa.array(merged, pa.int32()), "single": pa.array(single)})
        vocabulary = pa.table({"token": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("given", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")

    def code(self, pieces: list[bytes]):
        """``(tokens per piece, tokens, decoded bytes)`` in the order of ``pieces``."""
        import numpy as np
        import pyarrow as pa

        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int32)
        lengths = np.where(whole >= 0, 1, [len(p) for p in pieces])
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        first = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(p if w < 0 else b"\0" for p, w in zip(pieces, whole, strict=True)), np.uint8)
        token = np.array(self.single_bytes, np.int32)[data]
        token[first[whole >= 0]] = whole[whole >= 0]
        start = np.zeros(len(owner), bool)
        start[first] = True
        apart = ~self.joined[data[:-1].astype(np.int32) << 8 | data[1:]]
        start[1:] |= apart & np.repeat(lengths > LONG_PIECE, lengths)[1:]
        part = (np.cumsum(start) - 1).astype(np.int32)
        begins = np.flatnonzero(start)
        sizes = np.diff(np.append(begins, len(owner)))
        pos = (np.arange(len(owner)) - begins[part]).astype(np.int32)
        tail = np.where(np.append(start[1:], True), -1, np.append(token[1:], -1)).astype(np.int32)
        begun = pa.table({"piece": part, "pos": pos, "token": token, "tail": tail})
        long = sizes[part] > LONG_PIECE
        parts = [self._contract(b) for b in _batches(begun.filter(pa.array(~long)))]
        parts += [self._contract_long(b) for b in _batches(begun.filter(pa.array(long)))]
        merged = pa.concat_tables(parts).sort_by([("piece", "ascending"), ("pos", "ascending")])
        of = owner[begins][merged.column("piece").to_numpy()]
        tokens = pa.table({"piece": of, "pos": np.arange(len(of)), "token": merged.column("token")})
        self.con.register("tokens", tokens)
        digits = self.con.sql(DECODE).to_arrow_table().column("digits").to_pylist()
        self.con.unregister("tokens")
        counts = np.bincount(of, minlength=len(pieces))
        return counts, tokens.column("token").to_numpy(), [bytes.fromhex(d) for d in digits]

    def _begin(self, begun) -> None:
        self.con.register("given", begun)
        self.con.execute("CREATE OR REPLACE TEMP TABLE begun AS SELECT * FROM given")
        self.con.unregister("given")

    def _contract(self, begun):
        self._begin(begun)
        return self.con.sql(CONTRACT).to_arrow_table()

    def _contract_long(self, begun):
        self._begin(begun)
        self.con.execute("CREATE OR REPLACE TEMP TABLE done (piece int, pos int, token int)")
        while self.con.execute("SELECT 1 FROM begun LIMIT 1").fetchone():
            for sql in ROUND:
                self.con.execute(sql)
        return self.con.sql("SELECT piece, pos, token FROM done").to_arrow_table()


def _batches(begun) -> Iterator:
    """Slices of up to ``BATCH_ROWS`` rows at ends of parts; a larger part is a slice of its own."""
    import numpy as np

    part, at = begun.column("piece").to_numpy(), 0
    while at < len(part):
        end = min(at + BATCH_ROWS, len(part))
        if end < len(part) and (cut := int(np.searchsorted(part, part[end]))) > at:
            end = cut
        elif end < len(part):
            end = int(np.searchsorted(part, part[at], "right"))
        yield begun.slice(at, end - at)
        at = end


def _runs(values, lengths, which):
    """Of the runs that ``lengths`` cut ``values`` into, those numbered ``which``, one after another."""
    import numpy as np
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    which = pa.array(which)
    if values.dtype == np.uint8:  # copied run by run
        runs = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(values)]).take(which)
        _, ends, data = runs.buffers()
        return np.frombuffer(data or b"", np.uint8)[: np.frombuffer(ends, np.int64)[len(runs)]]
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(values)).take(which).flatten().to_numpy()


class TextCoder:
    """Texts to (token counts, tokens, decoded lengths, decoded bytes), slab by slab."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.find = regex.compile(pattern)
        self.pieces = PieceCoder(read_ranks(ranks_path))
        self.clear()

    def clear(self) -> None:
        import numpy as np
        import pyarrow as pa

        self.known = pa.array([], pa.large_string())
        self.tokens, self.raw = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.n_tokens, self.n_raw, self.uses = (np.zeros(0, np.int32) for _ in range(3))

    def drop_rare(self) -> None:
        """Of a full cache the pieces met more than once, at most half as many as it holds."""
        import numpy as np
        import pyarrow as pa

        often = np.argsort(-self.uses, kind="stable")[: CACHE_PIECES // 2]
        often = np.sort(often[self.uses[often] > 1])
        if self.n_raw[often].sum() > CACHE_BYTES // 2:
            self.clear()
        else:
            self.known = self.known.take(pa.array(often))
            self.tokens, self.raw = _runs(self.tokens, self.n_tokens, often), _runs(self.raw, self.n_raw, often)
            self.n_tokens, self.n_raw, self.uses = self.n_tokens[often], self.n_raw[often], self.uses[often] // 2
        give_back(everything=False)

    def codes(self, found: list[str]):
        """The numbers of pieces in the cache; those not met before are worked out first."""
        import numpy as np
        import pyarrow as pa

        met = pa.array(found, pa.large_string()).dictionary_encode()
        found.clear()  # the numbers stand for them from here on
        codes = self.places(met.dictionary)
        if (codes < 0).any():
            if len(self.known) > CACHE_PIECES or len(self.raw) > CACHE_BYTES:
                self.drop_rare()
                codes = self.places(met.dictionary)
            new = codes < 0
            codes[new] = np.arange(len(self.known), len(self.known) + new.sum(), dtype=np.int32)
            self.learn(met.dictionary.filter(pa.array(new)))
        return codes[met.indices.to_numpy()]

    def places(self, pieces):
        """The numbers of distinct pieces in the cache, -1 for those not in it. The cache is looked up
        in the pieces, as a hash table of the cache would take more memory than the cache."""
        import numpy as np
        import pyarrow.compute as pc

        codes = np.full(len(pieces), -1, np.int32)
        at = pc.index_in(self.known, value_set=pieces)
        here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False)).astype(np.int32)
        codes[at.drop_null().to_numpy()] = here
        return codes

    def learn(self, fresh) -> None:
        import numpy as np
        import pyarrow as pa

        counts, tokens, raw = self.pieces.code(fresh.cast(pa.large_binary()).to_pylist())
        self.known = pa.concat_arrays([self.known, fresh])
        self.tokens = np.concatenate([self.tokens, tokens])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(raw), np.uint8)])
        self.n_tokens = np.concatenate([self.n_tokens, counts.astype(np.int32)])
        self.n_raw = np.concatenate([self.n_raw, np.array([len(r) for r in raw], np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int32)])

    def code(self, texts: list[str]):
        """``(token counts, tokens, decoded lengths, decoded bytes)`` of the texts."""
        import numpy as np

        outs: list[tuple] = []
        n_tokens, n_raw = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for owner, found in self._slabs(texts):
            codes = self.codes(found)
            self.uses += np.bincount(codes, minlength=len(self.uses)).astype(np.int32)
            n_tokens += np.bincount(owner, self.n_tokens[codes], len(texts)).astype(np.int64)
            n_raw += np.bincount(owner, self.n_raw[codes], len(texts)).astype(np.int64)
            outs.append((_runs(self.tokens, self.n_tokens, codes), _runs(self.raw, self.n_raw, codes)))
        if not outs:
            return n_tokens, np.zeros(0, np.int32), n_raw, np.zeros(0, np.uint8)
        return n_tokens, np.concatenate([o[0] for o in outs]), n_raw, np.concatenate([o[1] for o in outs])

    def _slabs(self, texts: list[str]) -> Iterator[tuple]:
        """(number of the text, piece) of up to about ``SLAB_PIECES`` pieces at a time."""
        import numpy as np

        owners, pieces = [], []
        for i, text in enumerate(texts):
            matches = (m.group() for m in self.find.finditer(text)) if len(text) > SLAB_BYTES else iter(self.find.findall(text))
            while found := list(islice(matches, SLAB_PIECES)):
                owners.append(np.full(len(found), i))
                pieces += found
                if len(pieces) >= SLAB_PIECES:
                    yield np.concatenate(owners), pieces
                    owners, pieces = [], []
        if pieces:
            yield np.concatenate(owners), pieces


def worker_coder(ranks_path: str, pattern: str) -> TextCoder:
    """One coder for all tasks of a Python worker, so its cache outlives a task."""
    store = kept_by_worker()
    if getattr(store, "coder_of", None) != (ranks_path, pattern):
        give_back()
        store.coder, store.coder_of = TextCoder(ranks_path, pattern), (ranks_path, pattern)
    return store.coder


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep_text: bool = False
) -> DataFrame:
    """``docs`` (without the text unless wanted) with ``token_ids`` (array of int) and
    ``decoded`` (binary). Columns of these names are replaced."""
    kept = [f for f in docs.schema.fields if f.name not in ("token_ids", "decoded") and (keep_text or f.name != text)]
    schema = T.StructType(
        [*kept, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())]
    )
    names = [f.name for f in kept]
    given = docs.select(*names, F.col(text).alias("_text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        coder = worker_coder(ranks_path, pattern)

        def coded(batch):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            n_tokens, tokens, n_raw, raw = coder.code(texts)
            offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            ids = pa.ListArray.from_arrays(offsets(n_tokens), pa.array(tokens, pa.int32()))
            decoded = pa.BinaryArray.from_buffers(
                pa.binary(), len(texts), [None, offsets(n_raw).buffers()[1], pa.py_buffer(raw.tobytes())]
            )
            columns = [batch.column(n) for n in names]
            return pa.RecordBatch.from_arrays([*columns, ids, decoded], names=[*names, "token_ids", "decoded"])

        for out in map(coded, slices(batches, "_text", SLAB_BYTES)):
            yield out
            del out
            give_back(everything=False)
        give_back(everything=False)  # the input too: the worker may stay idle through other steps

    return given.mapInArrow(run, schema)


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
