import random

import numpy as np

from prosemill.llm import gear_chunks as G
from prosemill.llm._text import byte_table


def scalar_ends(b):
    table = [int(x) >> 32 for x in byte_table(31)]
    ends, h, start = [], 0, 0
    for i, x in enumerate(b):
        h = ((h << 1) + table[x]) & 0xFFFFFFFF
        n = i + 1 - start
        if n >= G.SHORTEST and h >> (32 - G.MASK_BITS) == 0 or n == G.LONGEST:
            ends.append(i + 1)
            start = i + 1
    return ends if start == len(b) else [*ends, len(b)]


def brute(rows, run=G.RUN):
    where, order = {}, {}
    for i, t in rows:
        if i is None or t is None:
            continue
        b, s = t.encode(), 0
        for e in scalar_ends(b):
            where.setdefault(b[s:e], []).append((i, s))
            s = e
    out = {}
    for c, at in where.items():
        if len(at) > 1:
            for i, s in at:
                order.setdefault(i, {})[s] = (s + len(c), min(at))
    for i, by in order.items():
        start = end = None
        for s in [*sorted(by), None]:
            if s is None or s != end:
                if start is not None and end - start >= run:
                    out[i, start] = (end, n, gone, first)
                if s is not None:
                    start, n, gone, first = s, 0, 0, by[s][1][0]
            if s is not None:
                end, n = by[s][0], n + 1
                gone += 0 if by[s][1] == (i, s) else end - s
    return {(i, s, *rest) for (i, s), rest in out.items()}


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnoé") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_equals_scalar_version_and_cases(spark):
    r = random.Random(4)
    shared = [prose(r, 60) for _ in range(3)]
    rows = [(i, prose(r, r.choice([3, 50, 200])) + (r.choice(["", "x"]) + r.choice(shared) if i % 3 == 0 else "") + prose(r, 10)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 5000), (103, shared[0] + "\n" + shared[0]), (104, "tie"), (105, "tie"), (106, rows[0][1]), (None, rows[0][1]), (107, prose(r, 60000)), (108, rows[1][1]), (108, rows[1][1])]
    df = spark.createDataFrame([(t, i, "x", 1, 2) for i, t in rows], "text string, doc_id long, id string, off int, len int")
    got = {tuple(x) for x in G.repeated_passages(df).collect()}
    want = brute(rows)
    # Repeated rows with one id are listed once.
    assert {x[:3] for x in got} == {x[:3] for x in want}
    assert {x for x in got if x[0] != 108} == {x for x in want if x[0] != 108}
    found = {x[0] for x in got}
    assert {i for i in range(60) if i % 3 == 0} <= found and not found & {i for i in range(1, 60) if i % 3} - {1}
    assert {102, 103, 106, 108} <= found and not found & {100, 101, 104, 105, 107}
    assert G.repeated_passages(df.limit(0)).count() == 0


def test_cuts_ignore_what_lies_before():
    r = random.Random(1)
    texts = [prose(r, 80).encode() for _ in range(5)]
    off = np.cumsum([0] + [len(t) for t in texts])
    ends = G.cuts(np.frombuffer(b"".join(texts), np.uint8), off)
    want = [o + e for t, o in zip(texts, off) for e in scalar_ends(t)]
    assert list(ends) == want
    moved = G.cuts(np.frombuffer(b"seven b" + texts[0], np.uint8), np.array([0, 7 + len(texts[0])]))
    assert len({e - 7 for e in moved.tolist()} & set(scalar_ends(texts[0]))) >= len(scalar_ends(texts[0])) - 4
