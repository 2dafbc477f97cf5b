"""Vector helpers over the byte buffers of Arrow string columns (run in Python workers)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a vector pass works on at once; a longer single text is one block.
BLOCK = 1 << 21


def buffers(col):
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_blocks(off, limit=BLOCK):
    """Ranges of rows whose texts make up at most ``limit`` bytes, or one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1))
        yield i, j
        i = j


def mix(x):
    """Finalizer that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(seed):
    """256 fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BASE = 0xD1342543DE82EF95


class SpanHasher:
    """64-bit hashes of byte spans of a block: h = sum T[b_j] * B^j (mod 2^64), then mixed with the length.

    Prefix sums give any span's hash in constant time, since B is odd and so has an inverse.
    """

    def __init__(self, seed):
        self.table = byte_table(seed)
        self.seed = np.uint64(seed)
        self.pow = self.inv = np.ones(1, np.uint64)

    def _grow(self, n):
        if len(self.pow) < n + 1:
            m = max(n + 1, 1 << 16)
            for name, b in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
                a = np.full(m, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))

    def load(self, data):
        n = len(data)
        self._grow(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.pow[:n], dtype=np.uint64, out=self.sums[1:])
        return self

    def spans(self, start, end):
        h = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.seed)

    def windows(self, q):
        """Unmixed hashes of all windows of ``q`` bytes."""
        n = len(self.sums) - 1
        return (self.sums[q:] - self.sums[: n + 1 - q]) * self.inv[: n + 1 - q] if n >= q else np.zeros(0, np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def word_spans(data, off):
    """Starts and ends of the runs without ASCII white space, and each one's row; no run crosses a row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:n]
    start = np.flatnonzero(starts)
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1
