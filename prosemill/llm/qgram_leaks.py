"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are put in a normal form (lower case, runs of anything but
letters and digits as one space, UTF-8). An item is cut into overlapping windows of
``WINDOW`` = 64 bytes, every ``STRIDE`` bytes and at its end. A stretch of text within
e edits of a window of w bytes shares at least w - q + 1 - q e of its q-grams, and they
lie on at most e + 1 neighbouring diagonals. So shared q-grams (q = ``Q`` = 8 bytes) are
counted in bands of 2(e + 1) diagonals that overlap by half, a band that reaches the
bound is kept, and in it the window is aligned by Myers' bit vectors, 64 rows at once.
First the text is thinned: where fewer shared q-grams than the least bound lie within a
window's reach, no band can reach it.

The benchmark travels to the workers, in slices of at most ``SLICE`` bytes: a larger
one takes more passes over the documents, each as the first. No row is shuffled.

Defined results: null, empty and short texts match nothing; an item of less than
``LEAST`` normal bytes says too little and is left out, as are null ones; equal items
under different ids are all reported; rows that repeat an id are judged one by one and
reported once each; an empty table on either side gives an empty result. Texts may be of
any length. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm._common import unused
from prosemill.llm._text import buffers, row_blocks

WINDOW = 64
STRIDE = 32
Q = 8
#: Edits allowed, as a share of a window's bytes.
EDITS = 0.08
LEAST = 24
SLICE = 8 << 20
SCHEMA = "doc_id long, item_id long, windows int, found int, edits int, start long, end long"

_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_TABLE = np.where(_WORD, np.arange(256), 32).astype(np.uint8)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def normal(data, off):
    """(bytes, offsets, places): texts in normal form and each byte's place in ``data``."""
    word = _WORD[data]
    keep = word.copy()
    keep[1:] |= word[:-1]
    head = off[:-1][np.diff(off) > 0]
    keep[head] = word[head]
    upto = np.concatenate(([0], np.cumsum(keep)))
    at = np.flatnonzero(keep)
    return _TABLE[data[at]], upto[off], at


def grams(data):
    """The 8 bytes at every place but the last 7, as one number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for r in range(min(Q, n)):
        k = (n - r + Q - 1) // Q
        out[r::Q] = data[r : r + k * Q].view("<u8") if (r + k * Q) <= len(data) else np.frombuffer(data[r : r + k * Q].tobytes(), "<u8")
    return out


def windows_of(items):
    """[(item, index of item, start, bytes)] of (item_id, lower-case text) rows."""
    out, ids, count = [], [], []
    for item, text in items:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        b = normal(raw, np.array([0, len(raw)]))[0].tobytes().rstrip(b" ")
        if len(b) < LEAST:
            continue
        at = range(0, max(1, len(b) - WINDOW + 1), STRIDE)
        at = [*at, len(b) - WINDOW] if len(b) > WINDOW and at[-1] != len(b) - WINDOW else list(at)
        out += [(len(ids), b[s : s + WINDOW]) for s in at]
        ids.append(item)
        count.append(len(at))
    return out, ids, count


class Index:
    """The windows' q-grams, sorted, with the windows and offsets that have them."""

    def __init__(self, items, share=EDITS):
        wins, self.ids, self.count = windows_of(items)
        self.item = np.array([i for i, _ in wins], np.int64)
        self.size = np.array([len(b) for _, b in wins], np.int64)
        self.edits = np.floor(share * self.size + 1e-9).astype(np.int64)
        self.need = self.size - Q + 1 - Q * self.edits
        self.text = np.zeros((len(wins), WINDOW), np.uint8)
        for k, (_, b) in enumerate(wins):
            self.text[k, : len(b)] = np.frombuffer(b, np.uint8)
        parts = [grams(self.text[k, :n]) for k, n in enumerate(self.size)]
        g = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        win = np.repeat(np.arange(len(wins)), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(g, kind="stable")
        g, self.win, self.place = g[order], win[order], place[order]
        self.grams, self.first = np.unique(g, return_index=True)
        self.first = np.append(self.first, len(g))
        self.map = np.zeros(1 << _BITS, bool)
        self.map[(self.grams * _MULTIPLY) >> np.uint64(64 - _BITS)] = True


def align(pattern, size, text, length):
    """For each row the least edits between its pattern (at most 64 bytes) and any stretch of its text, and that stretch's end: first, in case of a tie."""
    k = len(pattern)
    peq = np.zeros((k, 256), np.uint64)
    for j in range(int(size.max())):
        own = np.flatnonzero(j < size)
        peq[own, pattern[own, j]] |= np.uint64(1 << j)
    one, rows = np.uint64(1), np.arange(k)
    last = np.uint64(1) << (size - 1).astype(np.uint64)
    pv, mv, score = np.full(k, ~np.uint64(0)), np.zeros(k, np.uint64), size.copy()
    best, end = size.copy(), np.zeros(k, np.int64)
    for j in range(text.shape[1]):
        eq = peq[rows, text[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score = score + ((ph & last) != 0) - ((mh & last) != 0)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        better = (score < best) & (j < length)
        best[better], end[better] = score[better], j + 1
    return best, end


def _cut(data, start, length):
    """Rows data[start : start + length], padded."""
    col = np.arange(int(length.max()))
    return np.where(col < length[:, None], data[np.minimum(start[:, None] + col, len(data) - 1)], 0).astype(np.uint8)


def find(ix: Index, data, off):
    """(row, window, edits, start, end) of all bands that hold a window, in normal bytes of the block."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if not len(ix.size) or len(data) < Q:
        return none
    g = grams(data)
    hit = ix.map[(g * _MULTIPLY) >> np.uint64(64 - _BITS)]
    reach = WINDOW - Q + 1 + int(ix.edits.max())
    at = np.flatnonzero(hit)
    at = at[ix.grams[np.minimum(np.searchsorted(ix.grams, g[at]), len(ix.grams) - 1)] == g[at]]
    # Hits of which enough others lie within reach: in some run of ``least`` hits that spans less than it.
    least = int(ix.need.min())
    if len(at) < least:
        return none
    near = np.zeros(len(at) + 1, np.int64)
    full = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < reach)
    np.add.at(near, full, 1)
    np.add.at(near, full + least, -1)
    at = at[np.cumsum(near)[:-1] > 0]
    if not len(at):
        return none
    where = np.searchsorted(ix.grams, g[at])
    n = ix.first[where + 1] - ix.first[where]
    k = np.repeat(ix.first[where] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    win, diagonal = ix.win[k], np.repeat(at, n) - ix.place[k] + WINDOW
    e = ix.edits[win] + 1
    # Bands of 2e diagonals start at every multiple of e; a diagonal lies in two.
    high = diagonal // e
    wide = len(data) + 2 * WINDOW + 2
    key = np.concatenate((win * wide + high, win * wide + high - 1))
    key, shared = np.unique(key, return_counts=True)
    win = key // wide
    keep = (shared >= ix.need[win]) & (key % wide < wide - 1)
    win, band = win[keep], (key % wide)[keep]
    if not len(win):
        return none
    e = ix.edits[win]
    low = band * (e + 1) - WINDOW
    row = np.clip(np.searchsorted(off, np.clip(low + 2 * e + 2 + ix.size[win] // 2, 0, len(data) - 1), side="right") - 1, 0, len(off) - 2)
    start = np.maximum(low - e, off[row])
    stop = np.minimum(low + 3 * (e + 1) + ix.size[win], off[row + 1])
    ok = stop > start
    win, row, start, stop, e = win[ok], row[ok], start[ok], stop[ok], e[ok]
    out = []
    for s in range(0, len(win), 4096):
        w, a, z = win[s : s + 4096], start[s : s + 4096], stop[s : s + 4096]
        best, end = align(ix.text[w], ix.size[w], _cut(data, a, z - a), z - a)
        good = best <= e[s : s + 4096]
        w, a, best, end, r = w[good], a[good], best[good], end[good], row[s : s + 4096][good]
        if len(w):
            col = np.arange(WINDOW)
            back = np.where(col < ix.size[w][:, None], ix.text[w[:, None], np.maximum(ix.size[w][:, None] - 1 - col, 0)], 0).astype(np.uint8)
            text = _cut(data, a, end)
            turned = text[np.arange(len(w))[:, None], np.maximum(end[:, None] - 1 - np.arange(text.shape[1]), 0)]
            _, length = align(back, ix.size[w], turned, end)
            out.append((r, w, best, a + end - length, a + end))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else none


def finder(items, share):
    state = []

    def leaks(batches):
        if not state:
            state.append(Index(items, share))
        ix = state[0]
        total = np.array(ix.count, np.int64)
        names = np.array(ix.ids, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = buffers(batch.column(1))
            for i, j in row_blocks(off):
                base = off[i]
                text, at, places = normal(data[off[i] : off[j]], off[i : j + 1] - base)
                row, win, edits, start, end = find(ix, text, at)
                if not len(row):
                    continue
                key, inverse = np.unique(row * len(names) + ix.item[win], return_inverse=True)
                k = len(key)
                r, item = key // len(names), key % len(names)
                seen = np.unique(inverse * (len(ix.size) + 1) + win)
                found = np.bincount(seen // (len(ix.size) + 1), minlength=k)
                least, first, last = np.full(k, 1 << 30), np.full(k, 1 << 62), np.zeros(k, np.int64)
                np.minimum.at(least, inverse, edits)
                head = off[i:j][row] - base
                np.minimum.at(first, inverse, places[start] - head)
                np.maximum.at(last, inverse, places[end - 1] + 1 - head)
                yield pa.record_batch([pa.array(ids[i:j][r]), pa.array(names[item]), pa.array(total[item].astype(np.int32)), pa.array(found.astype(np.int32)), pa.array(least.astype(np.int32)), pa.array(first), pa.array(last)], ["doc_id", "item_id", "windows", "found", "edits", "start", "end"])

    return leaks


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", share=EDITS, slice_bytes=SLICE) -> DataFrame:
    """(doc_id, item_id, windows, found, edits, start, end): documents that hold some window of an item.

    ``found`` of the item's ``windows`` occur; ``edits`` is the closest one's; ``start`` and
    ``end`` are where the first begins and the last ends, as bytes of the lower-case text.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.lower(F.col(item_text_col)).alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // slice_bytes))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("t")).where("id is not null and t is not null")
    out = None
    for k in range(parts):
        rows = [(r.i, r.t) for r in (items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k) if parts > 1 else items).distinct().collect()]
        found = src.mapInArrow(finder(sorted(rows), share), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", share=EDITS) -> DataFrame:
    """``docs`` without the documents that hold some window of an item; all columns unchanged. Rows with a null id or text stay."""
    (key,) = unused(docs.columns, "gone")
    gone = contaminated(docs, benchmark, id_col, text_col, share=share).select(F.col("doc_id").alias(key))
    return docs.join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti")


def op7_qgram_leaks(spark, sf_dir):
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
