"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree splits vectors into ``BRANCH`` clusters by k-means, level by level, until a leaf
holds about ``LEAF`` of them; it is fitted on a bounded sample (``PER_LEAF`` vectors for a
leaf, ``SAMPLE`` at most), so that of more than ``SAMPLE`` / ``PER_LEAF`` * ``LEAF``
vectors leaves hold more. Every vector is indexed: it lies in the leaf that it reaches by
the nearest centre at each level. A search keeps the branches not taken in a priority
queue by distance to their centres and visits leaf after leaf from its head.

How many leaves to visit is calibrated: for ``QUERIES`` vectors the true neighbours are
found by brute force, and visits are widened until ``RECALL`` of them lie in visited
leaves. All queries are then searched with that many, and with more where these hold
fewer than k others. Leaves next to each other in the tree share a partition, and one with
very many vectors is split over several, so a query travels once to each partition that
holds some of its leaves, and there meets them one matrix product a leaf.

Defined results: rows with a null id, a null, empty or not finite vector, or one of
another length than most, are neither queries nor neighbours; of rows that repeat an id
the least vector counts; no vector is its own neighbour but equal vectors are each
other's; ties go to the smaller id; with fewer than k other vectors there are fewer
neighbours, and none in an empty table. Vectors may be of any length. Other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm._common import cut
from prosemill.llm._text import mix

K = 10
BRANCH = 16
LEAF = 64
#: Bounds of the training sample: vectors a leaf, and in all.
PER_LEAF = 32
SAMPLE = 200_000
#: Vectors that calibration takes as queries, and the recall it asks for: over 0.9 with room for chance.
QUERIES = 256
RECALL = 0.96
#: Vectors a partition of leaves.
PER_PART = 1 << 14


def kmeans(x, k, rounds=8, seed=7):
    """Centres of at most k clusters; empty ones are dropped."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros((len(c), x.shape[1]))
        np.add.at(sums, own, x)
        c = (sums[n > 0] / n[n > 0][:, None]).astype(np.float32)
    return c


def nearest(x, c):
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[s : s + 8192] @ c.T, axis=1) for s in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


class Tree:
    """Nodes in depth-first order: centre, first child and number of children (none: a leaf)."""

    def __init__(self, x, leaf, branch=BRANCH):
        self.centre, self.children = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1], np.float32)], [[]]
        self._grow(0, x, max(leaf, 1), branch)
        self.centre = np.array(self.centre, np.float32)
        order, todo = [], [0]
        while todo:
            v = todo.pop()
            if self.children[v]:
                todo.extend(reversed(self.children[v]))
            else:
                order.append(v)
        #: Nodes that are leaves, in tree order; a leaf is named by its place here.
        self.leaves = np.array(order, np.int64)
        self.name = np.full(len(self.centre), -1, np.int64)
        self.name[self.leaves] = np.arange(len(order))

    def _grow(self, v, x, leaf, branch):
        if len(x) <= leaf:
            return
        c = kmeans(x, min(branch, -(-len(x) // leaf) + 1))
        own = nearest(x, c)
        sizes = np.bincount(own, minlength=len(c))
        if (sizes == len(x)).any():
            return
        first = len(self.centre)
        self.centre.extend(c)
        self.children.extend([] for _ in c)
        self.children[v] = list(range(first, first + len(c)))
        for i in range(len(c)):
            self._grow(first + i, x[own == i], leaf, branch)

    def visit(self, q, leaves, counts=None, least=0):
        """The first ``leaves`` leaves (by name, -1 for none) of each query's best-bin-first search.

        With ``counts`` of the leaves' vectors it goes on until those visited hold ``least``.
        """
        out = []
        for x in q:
            queue, got, held = [(0.0, 0)], [], 0
            while queue and (len(got) < leaves or counts is not None and held < least):
                _, v = heapq.heappop(queue)
                if self.name[v] >= 0:
                    got.append(int(self.name[v]))
                    held += 0 if counts is None else int(counts[self.name[v]])
                    continue
                c = self.children[v]
                for d, k in zip(((self.centre[c] - x) ** 2).sum(axis=1).tolist(), c):
                    heapq.heappush(queue, (d, k))
            out.append(got)
        return np.array([g + [-1] * (max(map(len, out)) - len(g)) for g in out], np.int64).reshape(len(q), -1)

    def home(self, x):
        """The leaf in which each vector lies: the first that its own search reaches."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            v, rows = todo.pop()
            if self.name[v] >= 0:
                out[rows] = self.name[v]
                continue
            c = np.array(self.children[v])
            own = nearest(x[rows], self.centre[c])
            order = np.argsort(own, kind="stable")
            at = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1])) if len(rows) else []
            todo.extend((int(c[own[r[0]]]), rows[r]) for r in np.split(order, at[1:]) if len(r))
        return out


def _vectors(col, dim):
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(a.flatten(), np.float32).reshape(-1, dim)


def _closest(ids, d, k):
    """For each row of distances the k least with their ids; ties go to the smaller id."""
    if d.shape[1] > k:
        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        return [sorted(zip(d[i, m].tolist(), ids[m].tolist()))[:k] for i, m in enumerate(d <= limit)]
    return [sorted(zip(r.tolist(), ids.tolist())) for r in d]


def _squared(q, x):
    q, x = q.astype(np.float64), x.astype(np.float64)
    return np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * (q @ x.T), 0)


def _exact(ids, q, k):
    """Of a part of the vectors the k nearest to each query."""

    def scan(batches):
        for b in batches:
            x = _vectors(b.column(1), q.shape[1])
            own = b.column(0).to_numpy(zero_copy_only=False)
            d = _squared(q, x)
            d[ids[:, None] == own] = np.inf
            rows = [(i, n, v, h) for i, near in enumerate(_closest(np.arange(len(own)), d, k)) for v, p in near if np.isfinite(v) for n, h in [(int(own[p]), p)]]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([x[r[3]].tolist() for r in rows], pa.list_(pa.float32()))], ["q", "id", "d", "v"])

    return scan


def calibrate(vectors: DataFrame, tree: Tree, dim, k, queries=QUERIES, recall=RECALL):
    """Leaves to visit, and the recall that they gave on the queries drawn."""
    drawn = vectors.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(queries).toArrow()
    ids, q = drawn.column("id").to_numpy(), _vectors(drawn.column("v"), dim)
    near = vectors.mapInArrow(_exact(ids, q, k), "q int, id long, d double, v array<float>").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("r") <= k).select("q", "v").toArrow()
    if not near.num_rows:
        return 1, 1.0
    of, home = near.column("q").to_numpy(), tree.home(_vectors(near.column("v"), dim))
    need, most = int(np.ceil(recall * len(of))), 8
    while True:
        # Ranks of the true neighbours' leaves among those visited; the widest look is all leaves.
        order = tree.visit(q, most)
        rank = np.where((order[of] == home[:, None]).any(axis=1), (order[of] == home[:, None]).argmax(axis=1), np.iinfo(np.int64).max)
        at = np.sort(rank)
        if at[need - 1] < most:
            visits = int(at[need - 1]) + 1
            return visits, float((at < visits).mean())
        most *= 2


def neighbours(table: DataFrame, k: int = K, id_col="vec_id", vec_col="embedding", leaf: int = LEAF, recall: float = RECALL, queries=None) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): for every vector its k nearest others, by Euclidean distance.

    ``queries``, a condition on ``id``, says whose neighbours are asked for; all vectors are neighbours.
    """
    v = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    v = cut(v.groupBy("id").agg(F.min("v").alias("v")))
    empty = v.sparkSession.createDataFrame([], "vec_id long, rank int, neighbor_id long, distance double")
    common = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return empty
    dim, n = common["n"], common["count"]
    v = v.where(F.size("v") == dim)
    leaves = max(1, n // leaf)
    take = min(SAMPLE, max(PER_LEAF * leaves, 1024))
    share = v if take >= n else v.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(1.1 * take / n * (1 << 20)) + 1)
    x = _vectors(share.select("v").toArrow().column("v"), dim)
    tree = Tree(x, max(2, len(x) // leaves))
    visits, _ = calibrate(v, tree, dim, k, recall=recall)

    def at_home(batches):
        for b in batches:
            yield pa.record_batch([pa.array(tree.home(_vectors(b.column(1), dim)))], ["leaf"])

    counts = np.zeros(len(tree.leaves), np.int64)
    for r in v.mapInArrow(at_home, "leaf long").groupBy("leaf").count().collect():  # one row a leaf
        counts[r["leaf"]] = r["count"]
    # A leaf's partitions: those with few vectors share one, those with many have several.
    split = np.maximum(1, -(-counts // PER_PART))
    part_of = np.where(split == 1, np.cumsum(np.where(split == 1, counts, 0)) // PER_PART, 0)
    part_of = np.where(split == 1, part_of, int(part_of.max()) + 1 + np.cumsum(np.where(split == 1, 0, split)) - split)

    def place(batches):
        for b in batches:
            x = _vectors(b.column(1), dim)
            home, ids = tree.home(x), b.column(0)
            part = part_of[home] + mix(ids.to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.int64) % split[home]
            yield pa.record_batch([pa.array(part), pa.array(home), ids, b.column(1)], ["part", "leaf", "id", "v"])

    def ask(batches):
        for b in batches:
            if not b.num_rows:
                continue
            order = tree.visit(_vectors(b.column(1), dim), visits, counts, k + 1)
            row, leaf_ = np.repeat(np.arange(len(order)), order.shape[1]), order.ravel()
            row, leaf_ = row[leaf_ >= 0], leaf_[leaf_ >= 0]
            times = split[leaf_]
            nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            row, leaf_ = np.repeat(row, times), np.repeat(leaf_, times)
            part = part_of[leaf_] + nth
            by = np.lexsort((leaf_, part, row))
            row, leaf_, part = row[by], leaf_[by], part[by]
            start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])))
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(leaf_))
            yield pa.record_batch([pa.array(part[start]), lists, b.column(0).take(pa.array(row[start])), b.column(1).take(pa.array(row[start]))], ["part", "leaves", "id", "v"])

    def meet(base: pa.Table, asked: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        if base.num_rows and asked.num_rows:
            home, ids, x = base.column("leaf").to_numpy(), base.column("id").to_numpy(), _vectors(base.column("v"), dim)
            who, q = asked.column("id").to_numpy(), _vectors(asked.column("v"), dim)
            lists = asked.column("leaves").combine_chunks()
            of = np.repeat(np.arange(len(who)), np.diff(lists.offsets.to_numpy()))
            which = lists.flatten().to_numpy()
            by, order = np.argsort(home, kind="stable"), np.argsort(which, kind="stable")
            for leaf_ in np.unique(home).tolist():
                own = by[slice(*np.searchsorted(home[by], [leaf_, leaf_ + 1]))]
                rows = of[order[slice(*np.searchsorted(which[order], [leaf_, leaf_ + 1]))]]
                for s in range(0, len(rows), 2048):
                    r = rows[s : s + 2048]
                    d = _squared(q[r], x[own])
                    d[who[r][:, None] == ids[own]] = np.inf
                    for i, near in zip(r.tolist(), _closest(ids[own], d, k)):
                        found[i] = sorted(found.get(i, []) + [z for z in near if np.isfinite(z[0])])[:k]
        out = [(int(who[i]), b, a) for i, near in found.items() for a, b in near]
        return pa.table({"vec_id": pa.array([r[0] for r in out], pa.int64()), "d": pa.array([r[2] for r in out], pa.float64()), "n": pa.array([r[1] for r in out], pa.int64())})

    base = v.mapInArrow(place, "part long, leaf long, id long, v array<float>")
    asked = (v if queries is None else v.where(queries)).mapInArrow(ask, "part long, leaves array<long>, id long, v array<float>")
    near = base.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(meet, "vec_id long, d double, n long")
    best = near.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "n"))), 1, k).alias("b"))
    return best.select("vec_id", F.posexplode("b").alias("p", "x")).select("vec_id", (F.col("p") + 1).alias("rank"), F.col("x.n").alias("neighbor_id"), F.sqrt("x.d").alias("distance"))


def op3_kmeans_tree(spark, sf_dir):
    """The neighbours of every vector whose id is divisible by 100, among all vectors."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("id") % 100 == 0)
