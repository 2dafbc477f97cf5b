import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from prosemill.llm import nbest_pieces as P

CONTENT = open(P.MODEL, "rb").read()


@pytest.fixture(scope="module")
def unigram():
    """The same pieces under the library's own lattice, by declaring the model one of unigrams."""
    at = CONTENT.index(b"\x12\x06tok_v0\x18\x02") + 9
    return sentencepiece.SentencePieceProcessor(model_proto=CONTENT[:at] + b"\x01" + CONTENT[at + 1 :])


def run(texts, want=P.N):
    b = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["a", "b"])
    return [r for x in P.encoder(CONTENT, want)([b]) for r in x.to_pylist()]


def brute(text, want):
    """All segmentations of a short text, by score."""
    p = sentencepiece.SentencePieceProcessor(model_proto=CONTENT)
    t = "▁" + text.replace(" ", "▁")
    ids = {p.id_to_piece(i): i for i in range(259, p.get_piece_size())}
    low = min(p.get_score(i) for i in ids.values()) - 10
    out = []
    for cuts in itertools.product([0, 1], repeat=len(t) - 1):
        parts, s = [], 0
        for k, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(t[s:k])
                s = k
        if all(x in ids or len(x) == 1 for x in parts):
            seq, score = [], 0.0
            for x in parts:
                score += p.get_score(ids[x]) if x in ids else low
                seq += [ids[x]] if x in ids else [3 + b for b in x.encode()]
            out.append((-score, seq))
    return sorted(out)[:want]


def test_equals_all_segmentations_of_short_texts():
    texts = ["abab abc", "the there", "été\nno", "x  y z", "aaaaaaa", "q", "12.5 %"]
    for t, r in zip(texts, run(texts, 6)):
        want = brute(t, 6)
        got = P.nbest_ids(r["ids"], r["nbest"])
        assert [x["score"] for x in r["nbest"]] == [-s for s, _ in want]
        every = {(-s, tuple(i)) for s, i in brute(t, 10**6)}
        assert len({tuple(g) for g in got}) == len(got)
        assert all((x["score"], tuple(g)) in every for x, g in zip(r["nbest"], got))


def test_scores_equal_the_librarys_lattice(unigram):
    r = random.Random(2)
    syllables = ["an", "the", "er", "ou", "ti", "on", "ê", "ß", "q", "zz", "12", "-", "##"]
    texts = [" ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 6))) for _ in range(60)]
    p = sentencepiece.SentencePieceProcessor(model_proto=CONTENT)
    for t, x in zip(texts, run(texts)):
        best = unigram.nbest_encode_as_ids(t, P.N)
        score = [sum(p.get_score(i) for i in b) for b in best]
        assert len(x["nbest"]) == len(best)
        assert np.allclose([y["score"] for y in x["nbest"]], score, rtol=1e-6)
        assert all(p.decode(ids) == t for ids in P.nbest_ids(x["ids"], x["nbest"]))


def test_round_trip_and_cases(spark, sf_dir):
    odd = [None, "", " ", "   ", "\n\n", "▁ own ▁▁", "퟿\U0001f600\x00 z", "a" * 3000, "word " * 30000, "x", "x", "é\t\r\n"]
    df = spark.createDataFrame([(t, i, "k", 1.0) for i, t in enumerate(odd)], "text string, doc_id long, ids string, score double")
    rows = {r.doc_id: r for r in P.decode(P.encode(df)).collect()}
    assert len(rows) == len(odd)
    for i, t in enumerate(odd):
        assert rows[i].text == t and rows[i].decodes == (None if t is None else True)
    assert rows[0].ids is None and rows[0].nbest is None and rows[1].ids == [] and len(rows[1].nbest) == 1 and rows[1].score == 0
    assert rows[9].ids == rows[10].ids and len(rows[8].nbest) == P.N
    assert P.encode(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = P.decode(P.encode(docs), out_col="again").join(docs, "doc_id")
    assert got.where("not decodes or again <> text").count() == 0 and got.count() == docs.count()


def test_scores_that_are_fractions():
    p = P.Pieces(CONTENT)
    r = np.random.default_rng(3)
    p.score[259:-2] = -r.random(len(p.score) - 261) * 3 - 0.1
    p.score[-2] = p.score[259:-2].min() - 10
    ids = {p_: i for i, p_ in enumerate(sentencepiece.SentencePieceProcessor(model_proto=CONTENT).id_to_piece(list(range(p.size)))) if i >= 259}
    for text in ("x", "ab", "enough", "tzschü", "of words"):
        raw = text.encode()
        b = P.Block(p, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        _, upto, score = b.best()
        got = [float(score[b.first_word[1]])] + [float(score[b.first_word[1]]) - lost for lost, _ in b.alternatives(0, 4, upto)]
        t = "▁" + text.replace(" ", "▁")
        want = []
        for cuts in itertools.product([0, 1], repeat=len(t) - 1):
            at = [0, *(k for k, c in enumerate(cuts, 1) if c), len(t)]
            parts = [t[a:z] for a, z in zip(at, at[1:])]
            if all(x in ids or len(x) == 1 for x in parts):
                want.append(sum(p.score[ids.get(x, p.unk)] for x in parts))
        np.testing.assert_allclose(got, sorted(want, reverse=True)[:4], atol=1e-9)


def test_a_long_word_without_spaces():
    import time

    r = random.Random(4)
    t = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.time()
    (got,) = run([t])
    assert got["decodes"] and len(got["nbest"]) == P.N and time.time() - began < 60
    short = run([t[:300]])[0]
    assert short["nbest"][0]["score"] >= short["nbest"][1]["score"]
