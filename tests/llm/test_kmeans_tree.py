import heapq

import numpy as np

from prosemill.llm import kmeans_tree as T


def recall(got, ids, x, k):
    d = T._squared(x, x)
    np.fill_diagonal(d, np.inf)
    want = {int(i): {int(ids[j]) for j in np.argsort(r, kind="stable")[:k]} for i, r in zip(ids, d)}
    have = {}
    for r in got:
        have.setdefault(r.vec_id, set()).add(r.neighbor_id)
    return np.mean([len(want[i] & have.get(i, set())) / len(want[i]) for i in want])


def test_visits_follow_a_priority_queue():
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 8)).astype(np.float32)
    t = T.Tree(x, 30, 6)
    got = t.visit(x[:20], 15)
    for q, row in zip(x[:20], got):
        heap, out = [(0.0, 0)], []
        while len(out) < 15:
            _, v = heapq.heappop(heap)
            if t.name[v] >= 0:
                out.append(t.name[v])
            for c in t.children[v]:
                heapq.heappush(heap, (float(((q - t.centre[c]) ** 2).sum()), c))
        assert list(row) == out
    every = t.visit(x[:5], 10**6)
    assert all(sorted(e) == list(range(len(t.leaves))) for e in every)
    assert (t.home(x[:50]) >= 0).all()


def test_recall_over_all_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32)
    got = T.neighbours(df, leaf=32).collect()
    assert len(got) == len(ids) * T.K and recall(got, ids, x, T.K) >= 0.9
    assert T.op3_kmeans_tree(spark, sf_dir).columns == ["vec_id", "rank", "neighbor_id", "distance"]


def test_cases(spark):
    v = [float(i) for i in range(4)]
    rows = [(i, [i * 1.0, 0.0, 0.0, 1.0]) for i in range(40)] + [(50, None), (51, []), (52, [float("nan")] * 4), (53, [1.0]), (54, [1.0, None, 1.0, 1.0]), (None, v), (60, v), (61, v), (62, v), (62, v)]
    df = spark.createDataFrame([(b, a, 1, 2.0) for a, b in rows], "embedding array<float>, vec_id long, rank int, distance double")
    got = T.neighbours(df, k=3, leaf=8, recall=1.0).collect()
    have = {}
    for r in got:
        have.setdefault(r.vec_id, []).append((r.rank, r.neighbor_id, r.distance))
    assert set(have) == set(range(40)) | {60, 61, 62} and all(len(x) == 3 for x in have.values())
    assert sorted(have[60])[:2] == [(1, 61, 0.0), (2, 62, 0.0)] and [x[1] for x in sorted(have[10])][:2] == [9, 11]
    assert T.neighbours(df.limit(0)).count() == 0
    assert T.neighbours(df.where("vec_id = 3")).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    assert T.neighbours(same, k=2, leaf=16).count() == 600


def test_recall_of_the_query_and_a_leaf_of_many(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32)
    got = T.op3_kmeans_tree(spark, sf_dir).collect()
    asked = ids % 100 == 0
    assert {r.vec_id for r in got} == set(ids[asked].tolist()) and len(got) == asked.sum() * T.K
    d = T._squared(x[asked], x)
    d[ids[asked][:, None] == ids] = np.inf
    have = {(r.vec_id, r.neighbor_id) for r in got}
    want = [(int(i), int(ids[j])) for i, r in zip(ids[asked], d) for j in np.argsort(r, kind="stable")[: T.K]]
    assert sum(p in have for p in want) >= 0.9 * len(want)
    # More copies of one vector than a partition takes, and leaves with fewer than k others.
    r, most = np.random.default_rng(5), T.PER_PART
    T.PER_PART = 100
    try:
        many = [(i, [1.0, 2.0]) for i in range(700)] + [(1000 + i, [float(v) for v in r.normal(size=2) * 50]) for i in range(60)]
        got = T.neighbours(spark.createDataFrame(many, "vec_id long, embedding array<float>"), k=5, leaf=4, queries="id >= 698").collect()
    finally:
        T.PER_PART = most
    assert sorted((x.rank, x.neighbor_id, x.distance) for x in got if x.vec_id == 699) == [(k + 1, k, 0.0) for k in range(5)]
    assert len(got) == 62 * 5
