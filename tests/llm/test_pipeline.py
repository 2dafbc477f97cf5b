import zlib

import corpus_pipeline as C
from prosemill.llm import language_id as L
from tests.llm.test_dart_minhash import grams, groups, jaccard
from tests.llm.test_fuzzy_lines import brute as brute_lines
from tests.llm.test_qgram_leaks import brute as brute_leaks, prose
import random


def texts(r, words, n):
    return " ".join(r.choice(words) + r.choice(["", "ing", "ed"]) for _ in range(n))


def test_stages_equal_brute_force(spark, tmp_path):
    r = random.Random(12)
    words = {"a": [prose(r, 1) + "al" for _ in range(400)], "b": [zlib.adler32(str(i).encode()).to_bytes(4, "big").hex().translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(400)]}
    items = [(i, texts(r, words["a"], 14)) for i in range(3)]
    rows = []
    for i in range(50):
        lang = "ab"[i % 2]
        rows.append((i, "\n".join(texts(r, words[lang], 30) for _ in range(4)), lang))
    rows += [(60, rows[3][1].replace("ing", "ed", 2), "b"), (61, rows[4][1] + " " + items[1][1], "a"), (62, texts(r, words["a"], 40) + "\n" + items[0][1] + "\n" + texts(r, words["a"], 40), "a")]
    rows += [(63, rows[5][1].split("\n")[0] + "\n" + texts(r, words["b"], 60), "b"), (64, "!!! 12", "a"), (65, None, "a"), (66, "", "b"), (67, rows[6][1], "a"), (67, rows[6][1], "a")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {x.doc_id: x for x in C.run(spark, str(tmp_path)).collect()}

    model = L.train(docs)
    enc = {k: L.encoder(v) for k, v in model.items()}
    now = []
    for i, t, _ in rows:
        b = L.normalise(t) if t else b""
        s = sorted(sum(len(e.compress(b[k : k + L.BLOCK])) for k in range(0, len(b), L.BLOCK)) for e in enc.values())
        if b and (s[1] - s[0]) / s[0] >= L.MARGIN:
            now.append((i, t))
    gone = {}
    for d, n, *_ in brute_lines(now):
        gone.setdefault(d, set()).add(n)
    now = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ()))) for i, t in now]
    now = [(i, t) for i, t in now if t.strip()]
    sets = [grams(t) for _, t in now]
    pairs = [(now[x][0], now[y][0]) for x in range(len(now)) for y in range(x) if now[x][0] != now[y][0] and jaccard(sets[x], sets[y]) >= 0.5]
    drop = {x for g in groups(pairs) for x in g if x != min(g)}
    now = [(i, t) for i, t in now if i not in drop]
    leaks = {d for d, _ in brute_leaks(now, items)}
    want = {i for i, _ in now if i not in leaks}
    assert set(out) == want and leaks >= {61, 62} and len(want) > 40
    assert all(x.decodes for x in out.values())
    stages = docs
    for _, f in C.STAGES[:-1]:
        stages = f(spark, stages, str(tmp_path))
        assert stages.columns == docs.columns


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns_and_a_very_long_text(spark, tmp_path):
    r = random.Random(8)
    words = [prose(r, 1) for _ in range(500)]
    item = texts(r, words, 14)
    long = texts(r, words, 30_000)
    rows = [(i, texts(r, words, 60) + "\n" + texts(r, words, 9)) for i in range(6)] + [(10, long), (11, long + " end"), (12, texts(r, words, 20) + " " + item), (13, None), (14, "")]
    names = ["_gone", "gone", "_id", "id", "kept", "line", "lang_", "_V", "component", "a"]
    docs = spark.createDataFrame([(i, t, "a", "s", len(t or ""), *range(len(names))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, f in C.STAGES[1:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        got = {x.doc_id: x for x in out.collect()}
        assert all(got[i]._gone == 0 and got[i].a == len(names) - 1 for i in got)
        assert set(got) == {i for i, _ in rows} - ({11} if name != "decontamination" else {12})
    assert C.STAGES[-1][1](spark, docs, str(tmp_path)).where("decodes").count() == len(rows) - 1
