"""Duplicate passages by a sparse suffix array over minimiser positions.

Of a text's UTF-8 bytes only the suffixes at minimisers are retained: places whose
``SEED``-byte gram hashes least in some ``WINDOW`` neighbouring places; of equal ones
all are. They depend on nearby content alone, so equal passages retain equal places. A
suffix takes part if the next ``KEY`` bytes are another retained suffix's as well;
these suffixes are sorted by what follows and, among equal ones, by what precedes
(read backwards). Each is compared with those up to ``NEAR`` - 1 places away in that
order and with its neighbours in the order of what precedes; matches are extended to
the right and to the left by up to ``WINDOW`` bytes and count if they make up ``LEAST``.
Sorting is done in hash partitions of the first ``KEY`` bytes: all suffixes that can
match meet there. A match that goes on beyond that is carried on by the next retained
suffix, so bounded contexts lose nothing of it. Suffixes of one task with equal KEY and
contexts are matched there, and one of them goes on, so that copies by the million don't
meet in one task; nor do equal KEYs of one task when they are counted. Rows travel packed,
one binary value a partition. KEYs are equal by two hashes of 96 bits together.

A window of ``WINDOW`` places, and ``KEY`` bytes from any of them on, make up ``LEAST``,
so every passage of at least LEAST bytes retains a suffix that its other occurrence
retains too. It is found, whole, where at most ``NEAR`` suffixes share those KEY bytes.
Where more do, a passage can be missed, or bytes at its left end, if others go on longer
to the right and yet others to the left. Nothing is reported that does not occur twice,
and no stretch shorter than LEAST.

Defined results: null and short texts have no passages; a repeat within one document
counts; rows that repeat a document id are one document each, whose equal suffixes at
equal places are one occurrence, so that a row and its copy of the same id are no
repeat. Rows with a null id are not looked at, nor are other columns, whatever their
names. An empty table has no passages. Texts may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm._packed import SCHEMA as PACKED
from prosemill.llm._packed import Held, pack, partitions, sent, spread, unpack, wished
from prosemill.llm._text import SpanHasher, buffers, row_blocks

SEED = 16
WINDOW = 50
LEAST = 100
#: Bytes from a minimiser on that two suffixes must share; any LEAST bytes hold a window and these.
KEY = LEAST - WINDOW + 1
#: Suffixes of equal KEY that are compared with one another, beyond neighbours by either context.
NEAR = 8
#: Rows that are compared at once, a run of one KEY being kept whole.
HELD = 100_000
#: Bytes of texts that are hashed at once, in some 170 bytes of memory each; a longer text is one block.
BLOCK = 1 << 18
#: Suffixes of a task that are counted before they are sent.
COUNTED = 1 << 19


def minimisers(h, off, seed=SEED, window=WINDOW):
    """Places that are minimisers of some window of a row, ``h`` being the hash of each place's gram in the block."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for k in range(1, seed):
        e = off[1:] - k
        e = e[(e >= 0) & (e < n)]
        ok[e] = False
    # Grams that cross a row's end are no places; they hash highest.
    v = np.where(ok, h, ~np.uint64(0))
    m, step = v.copy(), 1
    while step < window:
        take = min(step, window - step)
        m[: len(m) - take] = np.minimum(m[: len(m) - take], m[take:])
        step += take
    # m[i] is the least of window places from i on; windows must lie in a row.
    width = np.diff(off) - (seed - 1)
    full = off[:-1][width >= window]
    count = (width[width >= window] - window + 1).astype(np.int64)
    w = np.repeat(full - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum())) if len(full) else np.zeros(0, np.int64)
    out = np.zeros(n, bool)
    change = np.ones(len(w), bool)
    if len(w):
        change[1:] = (m[w[1:]] != m[w[:-1]]) | (w[1:] != w[:-1] + 1)
        least = m[w]
        begin = w[change]
        stop = np.append(w[np.flatnonzero(change)[1:] - 1], w[-1]) + window
        # Between begin and stop all windows have one least value; each of its places there is retained.
        runs = np.flatnonzero(change)
        value = least[runs]
        k = stop - begin
        where = np.repeat(begin - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(int(k.sum()))
        hit = v[where] == np.repeat(value, k)
        out[where[hit]] = True
    return np.flatnonzero(out)


def places(data, off, hasher):
    """(row, place, hash) of the retained suffixes with at least KEY bytes to go; places count from the row's start."""
    if len(data) < LEAST:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    hasher.load(data)
    grams = hasher.spans(np.arange(len(data) - SEED + 1), np.arange(SEED, len(data) + 1))
    at = minimisers(grams, off)
    row = np.searchsorted(off, at, side="right") - 1
    ok = at + KEY <= off[row + 1]
    at, row = at[ok], row[ok]
    return row, at - off[row], hasher.spans(at, at + KEY)


def _runs(*columns):
    """Where runs of equal rows of sorted columns begin, as a mask."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def suffixes(parts):
    """A function of texts: packed rows of retained suffixes (kind 0), one for each KEY of a task, and of those that share their KEY with others of the task (kind 1)."""

    def send(found):
        ids, place, h = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((place, ids, h))
        ids, place, h = ids[order], place[order], h[order]
        keep = _runs(h, ids, place)
        ids, place, h = ids[keep], place[keep], h[keep]
        at = np.flatnonzero(_runs(h))
        size = np.diff(np.append(at, len(h)))
        t = pa.table([pa.array(h[at]), pa.array(ids[at]), pa.array(place[at].astype(np.int32)), pa.array(size > 1)], ["h", "id", "place", "known"])
        yield pack(t, spread(h[at], parts), 0)
        many = np.repeat(size > 1, size)
        if many.any():
            yield pack(pa.table([pa.array(ids[many]), pa.array(place[many].astype(np.int32))], ["id", "place"]), spread(ids[many], parts), 1)

    def run(batches):
        hasher, found, held = SpanHasher(41), [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = buffers(batch.column(1))
            for i, j in row_blocks(off, BLOCK):
                row, place, h = places(data[off[i] : off[j]], off[i : j + 1] - off[i], hasher)
                found.append((ids[i:j][row], place, h))
                held += len(row)
                if held >= COUNTED:
                    yield from send(found)
                    found, held = [], 0
        if held:
            yield from send(found)
        pa.default_memory_pool().release_unused()

    return run


def often(parts):
    """A function of packed suffixes: the packed (id, place) of those whose KEY occurs more than once (kind 0)."""

    def run(batches):
        kinds = unpack(batches)
        wishes = [kinds[1]] if 1 in kinds else []
        if t := kinds.get(0):
            h, ids, place, known = (t.column(c).to_numpy(zero_copy_only=False) for c in ("h", "id", "place", "known"))
            order = np.lexsort((known, place, ids, h))
            h, ids, place, known = h[order], ids[order], place[order], known[order]
            same = _runs(h, ids, place)
            at = np.flatnonzero(_runs(h))
            n = np.add.reduceat(same.astype(np.int64), at)
            some = np.repeat(n > 1, np.diff(np.append(at, len(h)))) & ~known & same
            wishes.append(pa.table([pa.array(ids[some]), pa.array(place[some])], ["id", "place"]))
        if wishes and (t := pa.concat_tables(wishes)).num_rows:
            yield pack(t, spread(t.column("id").to_numpy(), parts), 0)

    return run


def contexts(parts):
    """A function of packed wishes (id, place), which come first, and texts: the suffixes with what follows KEY and what precedes, backwards (kind 0), and stretches found in the task (kind 1)."""

    def send(held):
        h, g, ids, place, right, left = held
        t = pa.table([pa.array(np.concatenate(h)), pa.array(np.concatenate(g)), pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array(np.concatenate(ids)), pa.array(np.concatenate(place))], ["h", "g", "right", "left", "id", "place"])
        first: dict[tuple, int] = {}
        of = np.array([first.setdefault(k, n) for n, k in enumerate(zip(t.column("h").to_pylist(), t.column("g").to_pylist(), right, left))])
        copies = np.flatnonzero(of != np.arange(len(of)))
        if len(copies):
            i, p = t.column("id").to_numpy(), t.column("place").to_numpy()
            # Rows that repeat an id and a text are one occurrence.
            copies = copies[(i[copies] != i[of[copies]]) | (p[copies] != p[of[copies]])]
            b, r = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
            copies = copies[b[copies] + KEY + r[copies] >= LEAST]
            x, y = np.concatenate((copies, of[copies])), np.concatenate((of[copies], copies))
            yield pack(pa.table([pa.array(i[x]), pa.array(p[x] - b[x]), pa.array(p[x] + KEY + r[x]), pa.array(i[y])], STRETCH), spread(i[x], parts), 1)
        t = t.take(pa.array(np.flatnonzero(of == np.arange(len(of)))))
        yield pack(t, spread(t.column("h").to_numpy(), parts), 0)

    def run(batches):
        one, two = SpanHasher(41), SpanHasher(43)
        held, size = ([], [], [], [], [], []), 0
        for wish, by, t in wished(batches):
            at_place = wish.column("place").to_numpy()
            ids = t.column(0).to_numpy()
            data, off = buffers(t.column(1))
            for i, j in row_blocks(off, BLOCK):
                block, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                spots = [np.unique(at_place[by[x]]).astype(np.int64) if x in by else np.zeros(0, np.int64) for x in ids[i:j].tolist()]
                row, place = np.repeat(np.arange(j - i), [len(x) for x in spots]), np.concatenate(spots)
                # Rows that repeat an id have different texts; a place may lie beyond this one's.
                ok = place + KEY <= at[row + 1] - at[row]
                row, place = row[ok], place[ok]
                if not len(row):
                    continue
                s = place + at[row]
                e, b = np.minimum(s + KEY + WINDOW, at[row + 1]), np.maximum(s - WINDOW, at[row])
                raw, turned, n = block.tobytes(), block[::-1].tobytes(), len(block)
                held[0].append(one.load(block).spans(s, s + KEY))
                held[1].append((two.load(block).spans(s, s + KEY) >> np.uint64(32)).astype(np.uint32))
                held[2].append(ids[i:j][row])
                held[3].append(place)
                held[4].extend(raw[x:y] for x, y in zip((s + KEY).tolist(), e.tolist()))
                held[5].extend(turned[n - y : n - x] for x, y in zip(b.tolist(), s.tolist()))
                size += len(row)
                if size >= HELD:
                    yield from send(held)
                    held, size = ([], [], [], [], [], []), 0
        if size:
            yield from send(held)
        pa.default_memory_pool().release_unused()

    return run


STRETCH = ["id", "start", "end", "partner"]


def _matrix(col):
    """Binary values as rows of WINDOW bytes with their lengths."""
    data, off = buffers(col)
    n = np.diff(off)
    k = np.arange(WINDOW)
    return np.where(k < n[:, None], data[np.minimum(off[:-1][:, None] + k, max(len(data) - 1, 0))] if len(data) else np.uint8(0), 0).astype(np.uint8), n


def _common(m, n, i, j):
    """Bytes that rows i and rows j have in common."""
    differ = m[i] != m[j]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), WINDOW)
    return np.minimum(first, np.minimum(n[i], n[j]))


def compared(t):
    """(id, start, end, partner): each suffix's bytes shared in LEAST or more with those of its KEY that it is compared with."""
    h, ids, place = (t.column(c).to_numpy() for c in ("h", "id", "place"))
    # The same place of one id again is the same occurrence.
    new = np.append(True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]) | (place[1:] != place[:-1]))
    if not new.all():
        t = t.filter(pa.array(new))
        h, ids, place = h[new], ids[new], place[new]
    (right, rn), (left, ln) = (_matrix(t.column(c)) for c in ("right", "left"))
    start, end, partner = place.copy(), place.copy(), np.full(len(h), np.iinfo(np.int64).max)

    def take(i, j):
        r, b = _common(right, rn, i, j), _common(left, ln, i, j)
        ok = b + KEY + r >= LEAST
        i, j, r, b = i[ok], j[ok], r[ok], b[ok]
        for x, y in ((i, j), (j, i)):
            start[x] = np.minimum(start[x], place[x] - b)
            end[x] = np.maximum(end[x], place[x] + KEY + r)
            partner[x] = np.minimum(partner[x], ids[y])

    # x is no place twice in one call of take: each row has one row so many places on.
    for step in range(1, NEAR):
        i = np.flatnonzero(h[step:] == h[:-step])
        if not len(i):
            break
        take(i, i + step)
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(first, len(h)))
    many = np.flatnonzero(np.repeat(size > NEAR, size))
    if len(many):
        group = np.repeat(np.arange(len(size)), size)[many]
        # As text, bytes sort from the left; padding is told from zeros by length.
        order = np.lexsort((np.arange(len(many)), ln[many], np.ascontiguousarray(left[many]).view(f"V{WINDOW}").ravel().view(f"S{WINDOW}"), group))
        i = many[order]
        same = h[i[1:]] == h[i[:-1]]
        take(i[:-1][same], i[1:][same])
    some = end > place
    return pa.table([pa.array(ids[some]), pa.array(start[some]), pa.array(end[some]), pa.array(partner[some])], STRETCH)


def neighbours(parts):
    """A function of packed suffixes: ``compared`` of them in sorted order, packed by document with the stretches that were found before."""

    def run(batches):
        kinds = unpack(batches)
        if 1 in kinds:
            yield pack(kinds[1], spread(kinds[1].column("id").to_numpy(), parts), 0)
        if t := kinds.pop(0, None):
            t = t.take(pc.sort_indices(t, [(c, "ascending") for c in ("h", "g", "right", "left", "id", "place")]))
            # From here on a number names what both hashes do.
            key = np.cumsum(_runs(t.column("h").to_numpy(), t.column("g").to_numpy()))
            t = t.drop_columns(["h", "g"]).append_column("h", pa.array(key))
            at = np.append(np.flatnonzero(_runs(key)), len(key))
            x, held = 0, Held(0)
            while x < len(key):
                y = max(int(at[np.searchsorted(at, x, side="right")]), int(at[np.searchsorted(at, x + HELD, side="right") - 1]))
                out = merged_table(compared(t.slice(x, y - x).combine_chunks()))
                yield from held.add(out, spread(out.column("id").to_numpy(), parts))
                x = y
            yield from held.rest()
        pa.default_memory_pool().release_unused()

    return run


def shared_stretches(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Packed (id, start, end, partner): stretches of retained suffixes that occur again in ``partner``."""
    parts = partitions(docs)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null and t is not null")
    wishes = src.mapInArrow(suffixes(parts), PACKED).repartitionById(parts, "p").mapInArrow(often(parts), PACKED)
    both = wishes.unionByName(src.mapInArrow(sent(parts, 1), PACKED)).repartitionById(parts, "p").sortWithinPartitions("kind")
    return both.mapInArrow(contexts(parts), PACKED).repartitionById(parts, "p").mapInArrow(neighbours(parts), PACKED)


def duplicate_passages(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, start, end, partner_doc_id): maximal stretches of bytes that occur more than once.

    Stretches that overlap or touch are one; ``partner_doc_id`` is the least document
    that it was found to share some part with.
    """
    found = shared_stretches(docs, id_col, text_col).repartitionById(partitions(docs), "p")
    return found.mapInArrow(whole_stretches, "doc_id long, start long, end long, partner_doc_id long")


def merged_table(t):
    """Unions of a table's stretches."""
    t = t.take(pc.sort_indices(t, [("id", "ascending"), ("start", "ascending")])).combine_chunks()
    out = [b for b in merged(t.to_batches()) if b.num_rows]
    return pa.Table.from_batches(out).rename_columns(STRETCH) if out else t


def whole_stretches(batches):
    if t := unpack(batches).get(0):
        for b in merged_table(t).rename_columns(["doc_id", "start", "end", "partner_doc_id"]).to_batches():
            yield b


def merged(batches):
    """Unions of stretches that come sorted by (id, start)."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        i, s, e, p = (batch.column(k).to_numpy() for k in range(4))
        if held is not None:
            i, s, e, p = (np.append(h, x) for h, x in zip(held, (i, s, e, p)))
        # Ends as far as reached in their document: a running maximum that each document starts anew.
        doc = np.cumsum(np.append(0, i[1:] != i[:-1]))
        lift = doc * (int(e.max()) + 1)
        reach = np.maximum.accumulate(e + lift) - lift
        new = np.append(True, (doc[1:] != doc[:-1]) | (s[1:] > reach[:-1]))
        at = np.flatnonzero(new)
        rows = i[at], s[at], reach[np.append(at[1:], len(i)) - 1], np.minimum.reduceat(p, at)
        held = [x[-1:] for x in rows]
        yield pa.record_batch([pa.array(x[:-1]) for x in rows], ["doc_id", "start", "end", "partner_doc_id"])
    if held is not None:
        yield pa.record_batch([pa.array(x) for x in held], ["doc_id", "start", "end", "partner_doc_id"])


def op6_sparse_suffixes(spark, sf_dir):
    return duplicate_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
