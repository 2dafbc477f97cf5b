import random

from prosemill.llm import language_id as L

WORDS = {"a": ["alpha", "arrow", "apple", "amber", "ashes"], "b": ["bolt", "bridge", "brown", "birch", "bloom"]}


def prose(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "ing", "ed"]) for _ in range(n))


def test_held_out_accuracy_and_cases(spark):
    rows = [(i, prose("ab"[i % 2], 60, i), "ab"[i % 2], "x", i) for i in range(40)]
    odd = [(100, None, "a", "x", 0), (101, "", None, "x", 0), (102, "!!! 123", "a", "x", 0), (103, "zzz", None, None, 0), (103, "zzz", None, None, 0), (104, prose("a", 30000, 9), "a", "x", 0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, margin string, id long")
    model = L.train(df)
    assert set(model) == {"a", "b"}
    fresh = spark.createDataFrame([(i, prose("ab"[i % 2], 20, 1000 + i), "ab"[i % 2]) for i in range(50)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.detected_lang for r in L.identify(fresh, model).collect()}
    assert all(got[i] == "ab"[i % 2] for i in range(50))
    out = {r.doc_id: r for r in L.identify(df, model).collect()}
    assert all(out[i].detected_lang is None and out[i].margin == 0 for i in (100, 101, 102))
    assert out[104].detected_lang == "a"
    kept = L.keep_identified(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= set(range(40)) | {104}
    assert L.identify(df.limit(0), model).count() == 0 and L.train(df.limit(0)) == {}
    assert all(r.detected_lang is None for r in L.identify(df, {}).collect())


def test_matches_scalar_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.train(docs)
    enc = {k: L.encoder(v) for k, v in model.items()}
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    right = 0
    for d in docs.collect():
        b = L.normalise(d.text)
        s = sorted((sum(len(e.compress(b[i : i + L.BLOCK])) for i in range(0, len(b), L.BLOCK)), k) for k, e in enc.items())
        ok = bool(b) and (s[1][0] - s[0][0]) / s[0][0] >= L.MARGIN
        assert got[d.doc_id].detected_lang == (s[0][1] if ok else None)
        right += got[d.doc_id].detected_lang == d.lang
    assert right >= 0.95 * len(got)
