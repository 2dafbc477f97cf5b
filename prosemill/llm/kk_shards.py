"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes from indivisible groups.

A group of ``size`` bytes begins as a partial partition: one of its k slots has it, the
others are empty. The two partial partitions with the largest spread (fullest less
emptiest slot) are combined, the fullest slot of one with the emptiest of the other and
so on, until one is left. Differencing is done in levels, the same at every size: groups
of less than a ``UNITS``-th of all bytes are spread over buckets of about ``UNITS``
groups, and a task differences each bucket to one partial partition, whose spread is no
more than one such group. Tasks go on to combine ``FAN`` partial partitions to one, and
the driver the last ones, at most ``FAN``, with the large groups, at most ``UNITS``. One
bucket's groups go to the driver as they are: they come last and even out what the others
leave. So up to ``UNITS`` groups are differenced as in the textbook.

Groups are given by columns, or are documents with all their exact copies, so that
copies never lie in two shards.

Defined results: every row gets a shard, repeated rows the same one; null, empty texts
weigh nothing; null is a group value like others (documents whose text is null are one
group); equal sizes are taken by group; with fewer groups than shards some shards are
empty; an empty table gives an empty one. Texts of any length count by their bytes, which
alone are moved. Other columns are not looked at.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm._common import cut

SHARDS = 16
#: Bounds of what the driver differences, whatever the number of groups.
UNITS = 1 << 15
FAN = 512


def difference(parts, k):
    """Karmarkar-Karp over partial partitions, each a list of slot sums: (sums, slot of each part's each slot).

    Slots of the outcome are numbered from the fullest to the emptiest.
    """
    parent, heap = [], []
    for n, sums in enumerate(parts):
        own = []
        for s in sums:
            own.append((s, len(parent)))
            parent.append(len(parent))
        own = sorted((x for x in own if x[0] > 0), key=lambda x: (-x[0], x[1]))
        spread = (own[0][0] if own else 0) - (own[k - 1][0] if len(own) == k else 0)
        heap.append((-spread, n, own))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, n, a = heapq.heappop(heap)
        _, m, b = heapq.heappop(heap)
        alone = k - len(b)
        new = a[:alone]
        # Fullest of b meets the emptiest of a: slots that are empty there stay as they are.
        for i in range(len(b)):
            at = k - 1 - i
            if at < len(a):
                (s, x), (t, y) = a[at], b[i]
                parent[y] = x
                new.append((s + t, x))
            else:
                new.append(b[i])
        new.sort(key=lambda x: (-x[0], x[1]))
        spread = new[0][0] - (new[k - 1][0] if len(new) == k else 0) if new else 0
        heapq.heappush(heap, (-spread, min(n, m), new))
    last = heap[0][2] if heap else []
    slot = {x: i for i, (_, x) in enumerate(last)}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, at = [], 0
    for sums in parts:
        # A slot without bytes may go anywhere; it takes what is left over in order.
        to = [slot.get(root(at + i), -1) if s > 0 else -1 for i, s in enumerate(sums)]
        free = iter(sorted(set(range(k)) - set(to)))
        out.append([x if x >= 0 else next(free) for x in to])
        at += len(sums)
    return [s for s, _ in last] + [0] * (k - len(last)), out


def slotted(k):
    """A function of one bucket's groups: the slot of each in the bucket's partial partition."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bytes", "descending"), ("gid", "ascending")])
        _, slots = difference([[x] for x in t.column("bytes").to_pylist()], k)
        return t.append_column("s", pa.array([x for x, in slots], pa.int32())).select(["gid", "bytes", "b", "s"])

    return run


def _sums(rows, k):
    """Bucket -> sums of its slots, of (b, s, bytes)."""
    out = {}
    for b, s, size in rows:
        out.setdefault(b, [0] * k)[s] = size
    return dict(sorted(out.items()))


def combined(k):
    """A function of some buckets' slots (b, s, bytes, c): where each goes in the buckets' common partial partition."""

    def run(t: pa.Table) -> pa.Table:
        parts = _sums(zip(*(t.column(c).to_pylist() for c in ("b", "s", "bytes"))), k)
        _, slots = difference(list(parts.values()), k)
        rows = [(b, i, size, z) for (b, sums), to in zip(parts.items(), slots) for i, (size, z) in enumerate(zip(sums, to))]
        b, i, size, z = zip(*rows)
        return pa.table({"b": pa.array(b, pa.int64()), "s": pa.array(i, pa.int32()), "bytes": pa.array(size, pa.int64()), "c": pa.array([t.column("c")[0].as_py()] * len(rows), pa.int64()), "z": pa.array(z, pa.int32())})

    return run


def shards(docs: DataFrame, k: int = SHARDS, group_cols=None, id_col="doc_id", text_col="text", limit: int = UNITS) -> DataFrame:
    """(doc_id, group_id, bytes, shard) of every row; shard 0 is the fullest."""
    spark = docs.sparkSession
    group = F.xxhash64(*[F.col(c) for c in group_cols]) if group_cols else F.xxhash64(F.col(text_col).isNull(), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), group.alias("gid"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    groups = cut(rows.groupBy("gid").agg(F.sum("bytes").alias("bytes")))
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    least, buckets = max(1, -(-total // limit)), max(1, -(-n // limit))
    groups = groups.withColumn("b", F.pmod(F.xxhash64("gid", F.lit(3)), F.lit(buckets)))
    single = (F.col("bytes") >= least) | (F.col("b") == 0)
    member = cut(groups.where(~single).groupBy("b").applyInArrow(slotted(k), "gid long, bytes long, b long, s int"))
    parts, steps = member.groupBy("b", "s").agg(F.sum("bytes").alias("bytes")), []
    while buckets > FAN:
        up = parts.withColumn("c", F.floor(F.col("b") / FAN)).groupBy("c").applyInArrow(combined(k), "b long, s int, bytes long, c long, z int")
        steps.append(cut(up))
        parts = steps[-1].groupBy(F.col("c").alias("b"), F.col("z").alias("s")).agg(F.sum("bytes").alias("bytes"))
        buckets = -(-buckets // FAN)
    # At most ``limit`` large groups, one bucket and FAN partial partitions.
    large = sorted(groups.where(single).collect(), key=lambda g: (-g.bytes, g.gid))
    last = _sums(((r.b, r.s, r.bytes) for r in parts.collect()), k)
    _, slots = difference([[g.bytes] for g in large] + list(last.values()), k)
    own = pa.table([pa.array([g.gid for g in large], pa.int64()), pa.array([x for x, in slots[: len(large)]], pa.int32())], ["gid", "shard"])
    at = [(b, i, x) for b, to in zip(last, slots[len(large) :]) for i, x in enumerate(to)]
    at = pa.table([pa.array([x[c] for x in at], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["b", "s", "shard"])
    where = spark.createDataFrame(at)
    for up in reversed(steps):
        where = up.join(where.select(F.col("b").alias("c"), F.col("s").alias("z"), "shard"), ["c", "z"]).select("b", "s", "shard")
    shard = member.join(where, ["b", "s"]).select("gid", "shard").unionByName(spark.createDataFrame(own))
    return rows.join(shard, "gid").select("doc_id", F.col("gid").alias("group_id"), "bytes", "shard")


def op2_kk_shards(spark, sf_dir):
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
