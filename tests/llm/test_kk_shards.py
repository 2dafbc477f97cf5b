import heapq
import random

from prosemill.llm import kk_shards as K


def textbook(sizes, k):
    """Karmarkar-Karp with whole tuples of sets."""
    heap = [(-s, i, [(s, [i])] + [(0, [])] * (k - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        c = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1])), key=lambda x: -x[0])
        heapq.heappush(heap, (-(c[0][0] - c[-1][0]), min(i, j), c))
    return [s for s, _ in heap[0][2]]


def test_differencing_is_the_textbooks():
    assert K.difference([[8], [7], [6], [5], [4]], 2)[0] == [16, 14]
    r = random.Random(1)
    for k in (2, 3, 5):
        for _ in range(30):
            sizes = sorted((r.randint(1, 10**6) for _ in range(r.randint(1, 40))), reverse=True)
            sums, slots = K.difference([[s] for s in sizes], k)
            assert sums == textbook(sizes, k)
            again = [0] * k
            for s, (x,) in zip(sizes, slots):
                again[x] += s
            assert again == sums


def test_partial_partitions_keep_slots_apart():
    r = random.Random(2)
    parts = [[r.randint(0, 50) for _ in range(4)] for _ in range(20)] + [[0, 0, 0, 0]]
    sums, slots = K.difference(parts, 4)
    again = [0] * 4
    for p, s in zip(parts, slots):
        assert sorted(s) == [0, 1, 2, 3]
        for b, x in zip(p, s):
            again[x] += b
    assert again == sums and max(sums) - min(sums) <= 50


def check(rows, got, k):
    group, size = {}, [0] * k
    for r in got:
        assert group.setdefault(r.group_id, r.shard) == r.shard and 0 <= r.shard < k
        size[r.shard] += r.bytes
    assert sum(size) == sum(len((t or "").encode()) for _, t in rows) and len(got) == len(rows)
    return size


def test_balance_and_cases(spark):
    r = random.Random(5)
    texts = ["é" * r.choice([10, 100, 1000]) + str(i) for i in range(600)]
    rows = [(i, r.choice(texts)) for i in range(1500)] + [(9000, None), (9001, None), (9002, ""), (9003, texts[0]), (9003, texts[0]), (None, texts[1]), (9004, "x" * 200000)]
    df = spark.createDataFrame([(t, i, "s%d" % (i or 0 % 7), 1, 2) for i, t in rows], "text string, doc_id long, source string, shard int, bytes int")
    for limit, spread in ((K.UNITS, 64), (300, 700)):
        got = K.shards(df, 4, limit=limit).collect()
        size = check(rows, got, 4)
        heavy = sorted(size)
        assert heavy[-1] - heavy[0] <= spread
        shard = {}
        for x in got:
            shard.setdefault(x.doc_id, set()).add(x.shard)
        assert shard[9000] == shard[9001] and len(shard[9003]) == 1
    check(rows, K.shards(df, 5, group_cols=["source"]).collect(), 5)
    assert K.shards(df.limit(0), 4).count() == 0
    assert {x.shard for x in K.shards(df.where("doc_id = 9004"), 4).collect()} == {0}


def test_bundles_of_small_groups(spark):
    rows = [(i, "t" * (i % 97 + 1) + str(i)) for i in range(3000)]
    got = K.shards(spark.createDataFrame(rows, "doc_id long, text string"), 3, limit=60).collect()
    size = check(rows, got, 3)
    assert (max(size) - min(size)) / sum(size) < 0.01


def test_levels_are_differencing(spark, monkeypatch):
    """Many buckets, and several levels of them, against the textbook over all groups at once."""
    monkeypatch.setattr(K, "FAN", 4)
    rows = [(i, "t" * (i * 37 % 97 + 1) + str(i)) for i in range(2000)] + [(5000, "y" * 3000)]
    got = K.shards(spark.createDataFrame(rows, "doc_id long, text string"), 3, limit=200).collect()
    size = check(rows, got, 3)
    want = textbook(sorted((len(t) for _, t in rows), reverse=True), 3)
    assert max(size) - min(size) <= max(want) - min(want) + 200
