import itertools
import random

import numpy as np
import pytest

from prosemill.llm import semicrf_pii as S


@pytest.fixture(scope="module")
def model():
    return S.train()


def paths(n, y=S.TYPES):
    """All segmentations of n tokens."""
    if not n:
        yield []
        return
    for k in range(1, min(n, S.LONGEST) + 1):
        for rest in paths(n - k):
            for t in range(len(y)) if k == 1 else range(1, len(y)):
                yield [(k, t), *rest]


def value(table, trans, path):
    at, last, v = 0, 0, 0.0
    for k, t in path:
        at += k
        v += trans[last, t] + table[at, k - 1, t]
        last = t
    return v + trans[last, 0]


def test_programs_equal_enumeration():
    r = np.random.default_rng(2)
    trans = r.normal(size=(8, 8))
    m = S.Model({}, trans)
    for n in (1, 2, 4):
        table = np.full((n + 1, S.LONGEST, 8), -np.inf)
        for j in range(1, n + 1):
            for k in range(j):
                table[j, k, 0 if k == 0 else 1 :] = r.normal(size=8 if k == 0 else 7)
        every = list(paths(n))
        v = np.array([value(table, trans, p) for p in every])
        z, marginal, moves = S.expectations(table, trans)
        assert np.isclose(z, np.log(np.exp(v).sum()))
        share = np.exp(v - z)
        want = np.zeros_like(table)
        for p, s in zip(every, share):
            at = 0
            for k, t in p:
                at += k
                want[at, k - 1, t] += s
        assert np.allclose(marginal, want) and np.isclose(moves.sum(), sum(s * (len(p) + 1) for p, s in zip(every, share)))
        m.table = lambda toks: table  # noqa: B023
        best, out, at = every[int(v.argmax())], [], 0
        for k, t in best:
            if t:
                out.append((at, at + k, t))
            at += k
        assert m.decode([None] * n) == out
        del m.table


def test_held_out_accuracy(model):
    r = random.Random(1234)
    hit = told = true = 0
    for _ in range(400):
        text, marks = S.sentence(r)
        got = model.find(text)
        hit, told, true = hit + len(set(got) & set(marks)), told + len(got), true + len(marks)
    assert hit / true > 0.96 and hit / told > 0.97


def test_stretches_decide_as_whole_texts_do(spark, model):
    r = random.Random(8)
    rows = []
    for i in range(40):
        text = ""
        for _ in range(r.randint(1, 4)):
            text += S.sentence(r)[0] + " " + " ".join(r.choice(["uno", "été", "and,", "so!"]) for _ in range(r.choice([0, 5, 30]))) + " "
        rows.append((i, text))
    got = {}
    for x in S.entities(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x.doc_id, []).append((x.start, x.end, x.kind))
    for i, t in rows:
        assert sorted(got.get(i, [])) == model.find(t)


def test_cases_and_documents(spark, sf_dir):
    mail = "ask ann.21@mail3.example.com about it"
    odd = [(1, None), (2, ""), (3, " \n "), (4, "no entity, none"), (5, mail), (5, mail), (None, mail), (6, "so " * 60000 + mail + " so" * 60000), (7, "1" * 500), (8, "@ @@ 7 7 7 7"), (9, "é 10.0.12.255!! €")]
    df = spark.createDataFrame([(t, i, "k", 1, 2) for i, t in odd], "text string, doc_id long, kind string, start int, end int")
    got = [tuple(x) for x in S.entities(df).collect()]
    assert got.count((5, "email", 4, 28)) == 2 and (6, "email", 180004, 180028) in got and (9, "ip", 2, 13) in got
    assert not {x[0] for x in got} & {1, 2, 3, 4, 8, None}
    assert S.entities(df.limit(0)).count() == 0
    import re

    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    have = {(x.doc_id, x.start, x.end) for x in S.op1_semicrf_pii(spark, sf_dir).collect()}
    sure = {(i, m.start(), m.end()) for i, t in docs.items() for m in re.finditer(r"[\w.]+@[\w.]+\w|\b\d+\.\d+\.\d+\.\d+\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b[0-9a-f]{40}\b", t)}
    assert len(have & sure) >= 0.97 * len(sure) and len(have & sure) >= 0.97 * len(have)


def test_addresses_of_any_length_are_whole():
    m = S.train()
    for address in ("a.b.c.d.e.f.g.h.i@x.y.com", "first.second.third.fourth.fifth.sixth.seventh@mail.one.two.three.four.five.six.example.com", ".".join("abcdefgh" * 10) + "@mail1.example.com"):
        text = f"Write to {address} soon, or not."
        assert [text[a:b] for a, b, k in m.find(text) if k == "email"] == [address]


def test_blocks_decode_alike(monkeypatch):
    m, r = S.train(), random.Random(4)
    for _ in range(30):
        text = " ".join(S.sentence(r)[0] for _ in range(3))
        toks = S.tokens(text)
        whole = m.decode(toks)
        for size in (1, 7, 16):
            monkeypatch.setattr(S, "BLOCK", size)
            assert m.decode(toks) == whole
        monkeypatch.undo()
