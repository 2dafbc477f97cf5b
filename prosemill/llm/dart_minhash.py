"""Near-duplicate documents by DartMinHash (Christiani 2020) and a banded join.

A document is the weighted set of its word 3-grams (lower case; fewer than three
words make one gram), a gram's weight being how often it occurs. Over each element
lies the plane of weight by rank; hashing throws darts on it, one per unit of area on
average. A document keeps the darts under its elements' weights and, of those, the
one of least rank in each of ``K`` coordinates: two documents keep the same dart in a
coordinate with the probability of their weighted Jaccard similarity. The plane is
cut into cells of area 1 (weights dyadic, ranks even), so a document of total weight
W takes about K ln K + 2K darts whatever its length: ranks up to (K ln K + 2K) / W
are looked at first, and further ranks only while a coordinate is empty, which makes
the signature exact.

``BANDS`` bands of ``ROWS`` coordinates name buckets; within a bucket all documents
are compared by the share of equal coordinates, and those of at least ``THRESHOLD``
are joined; connected groups are the result and their least id is kept.

Defined results: null, empty and wordless texts are in no group; exact copies (and
repeated rows with different ids) have equal signatures and always form a group; rows
that repeat one id are one document for the grouping, near whatever one of its texts
is near; rows with a null id are in no group; an empty table has no groups. Texts may be
of any length. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm._common import connected_components, cut, unused
from prosemill.llm._text import SpanHasher, buffers, mix, row_blocks, word_spans

K = 96
BANDS = 24
ROWS = 3
THRESHOLD = 0.5
GRAM = 3

#: P(count <= c) for one expected dart.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(c) for c in range(12)])
_GOLD = 0x9E3779B97F4A7C15


def _unit(h):
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def grams(words, row, n):
    """(hash, row) of word 3-grams; rows of fewer words have one gram of them all."""
    size = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(len(row)) - first[row]
    count = np.where(size >= GRAM, size - GRAM + 1, np.minimum(size, 1))
    take = np.flatnonzero(place < count[row])
    h = np.zeros(len(take), np.uint64)
    for g in range(GRAM):
        inside = place[take] + g < size[row[take]]
        w = words[np.minimum(take + g, len(words) - 1)]
        h = mix(h + np.where(inside, w, np.uint64(0)) + np.uint64((g + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF))
    return h, row[take]


def weigh(h, row):
    """Distinct (hash, row) with their counts as weights."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def throw(h, x, row, low, high, k):
    """Darts of elements (hash, weight, row) with ranks in [low, high) of their row: (row, coordinate, rank, dart)."""
    # One slab of weights per power of two: [0, 1), [1, 2), [2, 4), ...
    slabs = np.where(x > 1, np.ceil(np.log2(np.maximum(x, 2))).astype(np.int64) + 1, 1)
    e = np.repeat(np.arange(len(h)), slabs)
    s = np.arange(len(e)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    base = np.where(s > 0, 2.0 ** (s - 1), 0.0)
    width = np.where(s > 0, base, 1.0)
    # Cells of rank are 1 / width high, so each has an area of 1.
    lo = np.floor(low[row[e]] * width).astype(np.int64)
    hi = np.ceil(high[row[e]] * width).astype(np.int64)
    cells = np.maximum(hi - lo, 0)
    c = np.repeat(np.arange(len(e)), cells)
    cell = lo[c] + np.arange(len(c)) - np.repeat(np.cumsum(cells) - cells, cells)
    seed = mix(h[e[c]] + mix(cell.astype(np.uint64) * np.uint64(64) + s[c].astype(np.uint64)))
    n = np.searchsorted(_POISSON, _unit(mix(seed + np.uint64(1))), side="right")
    d = np.repeat(np.arange(len(c)), n)
    dart = mix(seed[d] + (np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n) + 2).astype(np.uint64) * np.uint64(_GOLD))
    el = e[c[d]]
    weight = base[c[d]] + width[c[d]] * _unit(mix(dart + np.uint64(3)))
    rank = (cell[d] + _unit(mix(dart + np.uint64(5)))) / width[c[d]]
    r = row[el]
    ok = (weight < x[el]) & (rank >= low[r]) & (rank < high[r])
    return r[ok], (mix(dart[ok] + np.uint64(7)) % np.uint64(k)).astype(np.int64), rank[ok], dart[ok]


def signatures(h, row, n, k=K):
    """(n, k) darts' hashes; rows without grams get zeros."""
    out = np.zeros((n, k), np.uint64)
    h, row, x = weigh(h, row)
    total = np.bincount(row, x, minlength=n)
    open_ = total > 0
    low = np.zeros(n)
    step = np.where(open_, (k * math.log(k) + 2 * k) / np.maximum(total, 1), 0.0)
    while open_.any():
        keep = open_[row]
        h, row, x = h[keep], row[keep], x[keep]
        r, coordinate, rank, dart = throw(h, x, row, low, low + step, k)
        order = np.lexsort((dart, rank, coordinate, r))
        slot = (r * k + coordinate)[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        at, dart = slot[first], dart[order][first]
        flat = out.reshape(-1)
        empty = flat[at] == 0
        flat[at[empty]] = np.maximum(dart[empty], np.uint64(1))
        open_ &= (out == 0).any(axis=1)
        low = low + step
    return out


def sign(batches):
    """(id, sig: K low bytes, keys: a hash per band, whole: hash of the signature) of texts in lower case."""
    hasher = SpanHasher(21)
    for batch in batches:
        ids = batch.column(0)
        data, off = buffers(batch.column(1))
        for i, j in row_blocks(off):
            block, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            start, end, row = word_spans(block, at)
            if not len(start):
                continue
            n = j - i
            h, r = grams(hasher.load(block).spans(start, end), row, n)
            sig = signatures(h, r, n)
            has = np.flatnonzero(sig.any(axis=1))
            sig = sig[has]
            keys = np.zeros((len(has), BANDS), np.uint64)
            for b in range(BANDS):
                v = np.full(len(has), b + 1, np.uint64)
                for c in range(b * ROWS, (b + 1) * ROWS):
                    v = mix(v ^ sig[:, c])
                keys[:, b] = v
            whole = np.zeros((len(has), 2), np.uint64)
            for c in range(K):
                whole[:, 0] = mix(whole[:, 0] ^ sig[:, c])
                whole[:, 1] = mix(whole[:, 1] + sig[:, c] * np.uint64(3))
            low = np.ascontiguousarray((sig & np.uint64(255)).astype(np.uint8))
            yield pa.record_batch(
                [
                    ids.slice(i, n).take(pa.array(has)),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(has) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel())),
                    pa.array(whole[:, 0].view(np.int64)),
                    pa.array(whole[:, 1].view(np.int64)),
                ],
                ["id", "sig", "keys", "w1", "w2"],
            )


def least_equal(threshold=THRESHOLD):
    """Equal low bytes that two signatures need; unequal coordinates have equal bytes once in 256."""
    return math.ceil(K * (threshold + (1 - threshold) / 256) - 1e-9)


def bucket_edges(threshold):
    need = least_equal(threshold)

    def walked(ids, sig, group):
        """Pairs of a bucket's documents that join its groups: each document that a walk over close pairs reaches, with its start.

        A walk goes on from all documents of the groups that it reaches, and compares them
        with those of no walk yet, so that no close pair is left unjoined.
        """
        a, b, left = [], [], np.arange(len(ids))
        while len(left) and (group[left] != group[left[0]]).any():
            root = left[0]
            own = group[left] == group[root]
            todo, left = left[own].tolist(), left[~own]
            while todo and len(left):
                at = todo.pop()
                hit = np.concatenate([(sig[left[s : s + 8192]] == sig[at]).sum(axis=1) >= need for s in range(0, len(left), 8192)])
                if hit.any():
                    near = np.unique(group[left[hit]])
                    a.extend(ids[left[hit]].tolist())
                    b.extend([ids[root]] * int(hit.sum()))
                    found = np.isin(group[left], near)
                    todo.extend(left[found].tolist())
                    left = left[~found]
        return a, b

    def edges(batches):
        """Of rows (k, id, group, sig) sorted by k, bucket by bucket."""
        held = None
        for batch in [*batches, None]:
            t = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if t is None or not t.num_rows:
                continue
            k = t.column("k").to_numpy()
            whole = len(k) if batch is None else int(np.searchsorted(k, k[-1]) if (k[1:] >= k[:-1]).all() else 0)
            held = t.slice(whole)
            if not whole:
                continue
            t, k = t.slice(0, whole), k[:whole]
            ids, group = t.column("id").to_numpy(), t.column("group").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, K)
            at = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k)).tolist()
            a, b = [], []
            for x, y in zip(at, at[1:]):
                if y - x > 1:
                    more = walked(ids[x:y], sig[x:y], group[x:y])
                    a += more[0]
                    b += more[1]
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges


def equal_bytes(a, b):
    """A column function: how many bytes two signatures share."""

    def count(pairs):
        for x, y in pairs:
            m = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, K) for c in (x, y)]
            yield pa.array((m[0] == m[1]).sum(axis=1), pa.int32())

    from collections.abc import Iterator

    count.__annotations__ = {"pairs": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(count, "int")(a, b)


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", threshold=THRESHOLD) -> DataFrame:
    """(doc_id, kept_doc_id) for every document that goes: it is near kept_doc_id, directly or through others."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("t")).where("id is not null and t is not null")
    signed = src.mapInArrow(sign, "id long, sig binary, keys array<long>, w1 long, w2 long")
    signed = cut(signed)
    # Equal signatures are one class; only its least id goes on to the buckets.
    classes = cut(signed.groupBy("w1", "w2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n")))
    copies = signed.select("id", "w1", "w2").join(classes.where("n > 1").select("w1", "w2", "rep"), ["w1", "w2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    own = classes.select(F.col("rep").alias("id"), "sig", "keys")
    keys = own.select("id", F.explode("keys").alias("k"))
    # First each document of a bucket is compared with its least one, then those that are in different groups still.
    bucket = keys.groupBy("k").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "least")
    members = cut(keys.join(bucket, "k"))
    sig = own.select("id", "sig")
    first = members.where("id <> least").select("id", "least").distinct().join(sig, "id").join(sig.select(F.col("id").alias("least"), F.col("sig").alias("other")), "least")
    near = cut(first.where(equal_bytes(F.col("sig"), F.col("other")) >= least_equal(threshold)).select(F.col("id").alias("a"), F.col("least").alias("b")))
    group = connected_components(near).select(F.col("node").alias("id"), F.col("component").alias("group"))
    rows = members.select("k", "id").join(group, "id", "left").withColumn("group", F.coalesce("group", "id"))
    mixed = rows.groupBy("k").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("k")
    rest = rows.join(mixed, "k").join(sig, "id").select("k", "id", "group", "sig").repartition("k").sortWithinPartitions("k", "id").mapInArrow(bucket_edges(threshold), "a long, b long")
    groups = connected_components(near.unionByName(rest).unionByName(copies))
    return groups.where("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("kept_doc_id"))


def keep_one_of_each(docs: DataFrame, id_col="doc_id", text_col="text", threshold=THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group; all columns unchanged."""
    (key,) = unused(docs.columns, "gone")
    gone = near_duplicates(docs, id_col, text_col, threshold).select(F.col("doc_id").alias(key))
    return docs.join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti")


def op4_dart_minhash(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
