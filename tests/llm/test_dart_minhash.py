import random
from collections import Counter

import numpy as np

from prosemill.llm import dart_minhash as D

R = random.Random(5)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 7))) for _ in range(3000)]


def grams(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def changed(text, share, r):
    w = text.split(" ")
    for i in r.sample(range(len(w)), int(share * len(w))):
        w[i] = r.choice(WORDS)
    return " ".join(w)


def test_signature_is_that_of_all_darts_and_estimates_jaccard():
    h = np.array([3, 99, 12345, 777], np.uint64)
    counts = [1, 2, 5, 40]
    many = np.repeat(h, counts)
    sig = D.signatures(many, np.zeros(len(many), np.int64), 1)[0]
    r, c, rank, dart = D.throw(h, np.array(counts), np.zeros(4, np.int64), np.zeros(1), np.full(1, 60.0), D.K)
    want = [dart[c == k][np.argmin(rank[c == k])] for k in range(D.K)]
    assert list(sig) == want
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    equal, exact = [], []
    for i in range(60):
        a = Counter(rng.choice(pool[i * 50 : i * 50 + 50], 200).tolist())
        b = a.copy()
        b.update(rng.choice(pool[i * 50 : i * 50 + 50], rng.integers(20, 300)).tolist())
        hs = np.array(list(a.elements()) + list(b.elements()), np.uint64)
        s = D.signatures(hs, np.repeat([0, 1], [sum(a.values()), sum(b.values())]), 2)
        equal.append((s[0] == s[1]).mean())
        exact.append(jaccard(a, b))
    assert abs(np.mean(equal) - np.mean(exact)) < 0.02 and np.abs(np.array(equal) - exact).mean() < 0.06


def groups(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    out = {}
    for x in up:
        out.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


def test_groups_match_brute_force_and_cases(spark):
    r = random.Random(8)
    docs = []
    for g in range(25):
        t = " ".join(r.choice(WORDS) for _ in range(r.choice([4, 60, 200, 900])))
        for c in range(r.choice([1, 1, 2, 4])):
            docs.append(changed(t, r.choice([0, 0.02, 0.04]) if c else 0, r) if c < 3 else t.upper())
    r.shuffle(docs)
    rows = [(i, t, "a", 1, 0) for i, t in enumerate(docs)]
    odd = [(900, None, "a", 1, 0), (901, "", "a", 1, 0), (902, " \n ", "a", 1, 0), (903, "", "a", 1, 0), (904, "word", "a", 1, 0), (905, "Word", "a", 1, 0), (906, "word", "a", 1, 0), (906, "word", "a", 1, 0), (None, "word", "a", 1, 0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, id string, sig int, keys int")
    got = D.near_duplicates(df).collect()
    sets = [grams(t) for t in docs]
    want = groups((i, j) for i in range(len(docs)) for j in range(i) if jaccard(sets[i], sets[j]) >= D.THRESHOLD) | {frozenset((904, 905, 906))}
    assert groups((a, b) for a, b in got) == want
    assert all(b == min(next(g for g in want if a in g)) for a, b in got)
    kept = D.keep_one_of_each(df)
    assert kept.columns == df.columns
    ids = [x.doc_id for x in kept.collect()]
    assert {None, 900, 901, 902, 903, 904} <= set(ids) and 905 not in ids and 906 not in ids
    assert D.near_duplicates(df.limit(0)).count() == 0


def test_thousands_of_copies_and_a_very_long_text(spark):
    r = random.Random(2)
    base = " ".join(r.choice(WORDS) for _ in range(120))
    rows = [(i, base if i % 2 else changed(base, 0.02, random.Random(i))) for i in range(2000)]
    long = " ".join(r.choice(WORDS) for _ in range(60000))
    rows += [(5000, long), (5001, changed(long, 0.01, r)), (5002, "one " * 50000), (5003, "one " * 49000)]
    got = {tuple(x) for x in D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, 0) for i in range(1, 2000)} | {(5001, 5000), (5003, 5002)} == got
