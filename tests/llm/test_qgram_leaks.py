import random
import re

import numpy as np

from prosemill.llm import qgram_leaks as Q


def normal(t):
    return re.sub(rb"[\x00-\x2f:-@\[-`{-\x7f]+", b" ", t.lower().encode()).strip(b" ")


def least_edits(p, t):
    """Edits between p and the closest stretch of t."""
    row = np.arange(len(p) + 1)
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def brute(docs, items):
    out = {}
    for d, t in docs:
        if d is None or t is None:
            continue
        n = normal(t)
        for i, x in items:
            if i is None or x is None or len(b := normal(x)) < Q.LEAST:
                continue
            at = sorted({*range(0, max(1, len(b) - 63), 32), max(0, len(b) - 64)})
            e = [least_edits(b[s : s + 64], n) for s in at]
            ok = [v for v, s in zip(e, at) if v <= int(Q.EDITS * len(b[s : s + 64]) + 1e-9)]
            if ok:
                out[d, i] = (len(at), len(ok), min(ok))
    return out


def edited(r, t, n):
    t = list(t)
    for _ in range(n):
        k = r.randrange(len(t))
        c = r.random()
        if c < 0.4:
            t[k] = r.choice("abcxyz")
        elif c < 0.7:
            t.insert(k, r.choice("abcxyz"))
        else:
            del t[k]
    return "".join(t)


def prose(r, n):
    return " ".join("".join(r.choice(["th", "er", "an", "ou", "é", "in"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_equals_brute_force_and_cases(spark):
    r = random.Random(9)
    items = [(i, prose(r, r.choice([5, 9, 14, 25]))) for i in range(8)] + [(20, None), (21, ""), (22, "short"), (None, "nothing " * 9)]
    items += [(30, items[0][1])]
    docs = []
    for i in range(36):
        t = prose(r, 25)
        if i % 3:
            k = r.randrange(8)
            t = t[: r.randint(0, len(t))] + edited(r, items[k][1], r.choice([0, 1, 3, 5, 9, 14])) + t
        docs.append((i, t.upper().replace(" ", "!! ") if i % 7 == 0 else t))
    docs += [(100, None), (101, ""), (102, "x"), (103, items[2][1]), (104, items[2][1]), (104, items[2][1]), (None, items[2][1])]
    df = spark.createDataFrame([(t, i, "z", 1, 2) for i, t in docs], "text string, doc_id long, item_id string, start int, windows int")
    bench = spark.createDataFrame([(t, i, 0) for i, t in items], "text string, item_id long, doc_id int")
    rows = Q.contaminated(df, bench).collect()
    got = {(x.doc_id, x.item_id): (x.windows, x.found, x.edits) for x in rows}
    want = brute(docs, items)
    assert got == want and len(want) > 15
    assert sum(x.doc_id == 104 for x in rows) == 2
    for x in rows:
        assert 0 <= x.start < x.end <= len(dict(docs)[x.doc_id].encode())
    kept = Q.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(y.doc_id for y in kept.collect() if y.doc_id is not None) == sorted(i for i, _ in docs if i is not None and not any(d == i for d, _ in want))
    assert Q.contaminated(df.limit(0), bench).count() == 0 and Q.contaminated(df, bench.limit(0)).count() == 0
    sliced = {(x.doc_id, x.item_id): (x.windows, x.found, x.edits) for x in Q.contaminated(df, bench, slice_bytes=300).collect()}
    assert sliced == want


def test_very_long_text_and_copies(spark):
    r = random.Random(3)
    items = [(1, prose(r, 30)), (2, prose(r, 30))]
    long = prose(r, 40000)
    docs = [(1, long[:200000] + " " + items[0][1] + " " + long[200000:]), (2, long)] + [(10 + i, items[1][1]) for i in range(500)]
    got = {(x.doc_id, x.item_id) for x in Q.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1)} | {(10 + i, 2) for i in range(500)}
