"""Vectorised reading of Arrow string columns inside tasks: bytes, words and their hashes."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Iterator

SLICE_BYTES = 1_000_000
_ODD = 0x9E3779B97F4A7C15


def slices(batches, column: str, most: int = SLICE_BYTES) -> Iterator:
    """Record batches cut so that the texts of each take about ``most`` bytes; at least a row,
    and fewer than 2**20 rows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        pa.default_memory_pool().release_unused()
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def kept_by_worker() -> types.ModuleType:
    """What tasks of one kind leave in their Python worker for the next of that kind."""
    return sys.modules.setdefault("_wardline_worker", types.ModuleType("_wardline_worker"))


def give_back(everything: bool = True) -> None:
    """Give freed memory back to the system, with what the worker keeps for tasks of one kind if
    ``everything`` goes. A Python worker lives on for tasks of other stages, and what earlier ones
    leave in it would add to what the next one needs."""
    import ctypes

    import pyarrow as pa

    if everything and vars(kept_by_worker()).pop("coder_of", None) is not None:
        del kept_by_worker().coder
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def text_bytes(column):
    """``(bytes, offsets)`` of a string column as arrays; nulls are empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def lower_ascii(raw):
    import numpy as np

    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[raw]


def scrambled(x):
    """A fixed one-to-one scrambling of 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int, kept={}):  # noqa: B006  (the default holds the longest powers so far)
    """Powers of an odd number and of its inverse modulo 2**64."""
    import numpy as np

    if not kept or len(kept["up"]) <= n:
        base, back = np.uint64(_ODD), np.uint64(pow(_ODD, -1, 2**64))
        kept["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]))
        kept["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, back)]))
    return kept["up"], kept["down"]


class Prefixes:
    """Hashes of any substrings of an array of bytes, from running sums."""

    def __init__(self, raw):
        import numpy as np

        up, self.down = _powers(len(raw))
        value = scrambled(np.arange(1, 257, dtype=np.uint64))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(value[raw] * up[: len(raw)])])

    def rolling(self, size: int):
        """The hash at every place of the ``size`` bytes from there on."""
        n = len(self.sums) - size
        return scrambled((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def hashes(self, starts, ends):
        return scrambled((self.sums[ends] - self.sums[starts]) * self.down[starts])


def words(raw, offsets):
    """``(starts, ends, document)`` of all words: runs without the six blanks 0x20, 0x09-0x0D,
    never across documents."""
    import numpy as np

    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    inside = ~blank[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    finals = offsets[1:][offsets[1:] > 0] - 1
    last[finals] = inside[finals]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_digests(raw, starts, ends):
    """Two 64-bit digests (n, 2) of each word: BLAKE2 of its bytes, once per distinct word."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    if not len(starts):
        return np.zeros((0, 2), np.uint64)
    step = np.zeros(len(raw) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    flat = raw[np.cumsum(step[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
    digests = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in found.dictionary.to_pylist())
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)[found.indices.to_numpy()]


def shingles(raw, offsets, width: int = 5):
    """``(document, hash, other)`` of the distinct word shingles of every document, sorted by
    document and hash; ``other`` is a second, independent hash. A document of fewer words than
    ``width`` has one shingle, all of them."""
    import numpy as np

    raw = lower_ascii(raw)
    starts, ends, owner = words(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    word = word_digests(raw, starts, ends)
    n = len(word)
    count = np.bincount(owner, minlength=len(offsets) - 1)
    end_of = np.cumsum(count)[owner]
    first = end_of - count[owner]
    at = np.arange(n)
    whole = at + width <= end_of
    short = (count[owner] < width) & (at == first)
    total = np.zeros((2, n), np.uint64)
    for k in range(width):
        factor = scrambled(np.array([k + 1001], np.uint64))[0] | np.uint64(1)
        there = at + k < end_of
        for lane in (0, 1):
            total[lane] += np.where(there, np.roll(word[:, lane], -k) * factor, np.uint64(0))
    keep = whole | short
    owner, value, other = owner[keep], scrambled(total[0][keep]), scrambled(total[1][keep])
    order = np.lexsort((value, owner))
    owner, value, other = owner[order], value[order], other[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], value[new], other[new]


def signatures(owner, value, other, documents: int):
    """Two 64-bit numbers (n, 2) for each document's set: BLAKE2 of all its hashes."""
    import hashlib

    import numpy as np

    both = np.ascontiguousarray(np.stack([value, other], axis=1))
    cuts = np.searchsorted(owner, np.arange(documents + 1)).tolist()
    digests = [hashlib.blake2b(both[a:b], digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
