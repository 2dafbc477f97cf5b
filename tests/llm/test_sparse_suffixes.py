import random
import tracemalloc

import numpy as np
import pyarrow as pa

from prosemill.llm import sparse_suffixes as S


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqré") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_minimisers_equal_brute_force():
    r = np.random.default_rng(1)
    sizes = [0, 5, 40, 200, 31, 90]
    off = np.cumsum([0] + sizes)
    h = r.integers(0, 50, off[-1]).astype(np.uint64)
    want = set()
    for a, b in zip(off[:-1], off[1:]):
        for i in range(a, b - 7 - 10 + 2 - 1):
            w = h[i : i + 10]
            want |= {i + int(k) for k in np.flatnonzero(w == w.min())}
    assert set(S.minimisers(h, off, seed=7 + 1, window=10).tolist()) == want


def repeated(rows):
    """By id, which bytes lie in some stretch of at least k bytes that occurs elsewhere too."""

    def marks(k):
        where, out = {}, {}
        for i, t in rows:
            b = (t or "").encode()
            for s in range(len(b) - k + 1):
                where.setdefault(b[s : s + k], set()).add((i, s))
        for at in where.values():
            if len(at) > 1:
                for i, s in at:
                    out.setdefault(i, set()).update(range(s, s + k))
        return out

    return marks


def test_against_brute_force_and_cases(spark):
    r = random.Random(7)
    shared = [prose(r, 55) for _ in range(4)]
    rows = [(i, prose(r, r.choice([3, 60, 120])) + (" " + r.choice(shared) + " " if i % 3 == 0 else "") + prose(r, 20)) for i in range(45)]
    rows += [(100, None), (101, ""), (102, "a" * 900), (103, shared[0] + "\n" + shared[0]), (104, "tie"), (105, "tie"), (106, rows[1][1]), (107, prose(r, 20000)), (108, rows[0][1][:60])]
    extra = [(200, prose(r, 90)), (200, None), (None, rows[2][1])]
    extra += [extra[0]]
    df = spark.createDataFrame([(t, i, "k", 1) for i, t in rows + extra], "text string, doc_id long, h string, place int")
    got = S.duplicate_passages(df).collect()
    found = {}
    for x in got:
        assert x.end - x.start >= S.LEAST and x.partner_doc_id is not None
        found.setdefault(x.doc_id, set()).update(range(x.start, x.end))
    marks = repeated(rows)
    truth, sure = marks(S.LEAST), marks(S.LEAST + S.WINDOW + S.SEED)
    assert all(v <= truth[i] for i, v in found.items())
    for i, v in sure.items():
        # All but WINDOW bytes at the left end of a run.
        missing = sorted(v - found[i])
        assert len(missing) <= S.WINDOW * sum(x - 1 not in v for x in v), (i, len(missing))
    assert set(range(0, 45, 3)) <= set(found) and not set(found) & ({i for i in range(45) if i % 3} - {1})
    assert {1, 102, 103, 106} <= set(found) and not {100, 101, 104, 105, 107, 108, 200} & set(found)
    # Spans of one document lie apart, in order.
    spans = sorted((x.doc_id, x.start, x.end) for x in got)
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:]))
    assert S.duplicate_passages(df.limit(0)).count() == 0


def test_copies_in_thousands(spark):
    r = random.Random(2)
    t = prose(r, 120)
    rows = [(i, prose(random.Random(i), 10) + t + prose(random.Random(-i), 10)) for i in range(1500)]
    got = S.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1500 and all(x.end - x.start >= len(t.encode()) for x in got)


def test_every_repeat_of_a_hundred_bytes(spark):
    r = random.Random(12)
    rows, want = [], {}
    for k in range(150):
        x = "".join(r.choice("abcdefghijklmnop ") for _ in range(100 + k % 70))
        for i in (2 * k, 2 * k + 1):
            a, z = ("", "") if k < 20 else ("".join(r.choice("ABCDEFGH") for _ in range(r.randint(50, 150))) + "12"[i % 2], "34"[i % 2] + "".join(r.choice("ABCDEFGH") for _ in range(60)))
            rows.append((i, a + x + z))
            want[i] = (len(a), len(a) + len(x), i ^ 1)
    # A key alone is too short a repeat.
    key = "".join(r.choice("qrstuvwxyz") for _ in range(51))
    got = S.duplicate_passages(spark.createDataFrame(rows + [(1000 + k, key + str(k) * 80) for k in range(5)], "doc_id long, text string")).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got if x.doc_id < 1000} == want
    assert all(x.end - x.start >= S.LEAST for x in got)


def test_hashes_many_texts_in_little_memory():
    r = random.Random(8)
    text = prose(r, 30000)
    rows = pa.record_batch([pa.array(range(40), pa.int64()), pa.array([text[3000 * i :][:60000] for i in range(40)])], ["id", "t"])
    whole = [b.num_rows for b in S.suffixes(1)([rows])]
    tracemalloc.start()
    try:
        assert [b.num_rows for b in S.suffixes(1)([rows])] == whole
        assert tracemalloc.get_traced_memory()[1] < 120e6
    finally:
        tracemalloc.stop()
