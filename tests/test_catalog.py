import pytest

from prosemill.plans import catalog
from tests.checking import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf_dir, con, name):
    compare(spark, sf_dir, con, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_overlaps_equal_brute_force(spark, sf_dir):
    from difflib import SequenceMatcher

    from prosemill.operators import compare as C

    docs = catalog.dialog_docs(spark, sf_dir).where("doc_id < 40")
    from prosemill.operators import segment as S

    a, b = S.sentences(docs).drop("raw"), S.simple_sentences(docs)
    regions = C.regions_step_two(a).select("doc_id", "first", "text")
    got = {(r.doc_id, r.first, r.sent_index) for r in C.overlapping(regions, b).collect()}
    by = {}
    for r in b.collect():
        by.setdefault(r.doc_id, []).append((r.sent_index, r.sentence))
    want = set()
    for r in regions.collect():
        for i, s in by.get(r.doc_id, []):
            if r.first - 5 <= i <= r.first + 20:
                words = {w for w in s.lower().split() if len(w) > 4}
                share = len(words & set(r.text.lower().split())) / len(words) if words else 0
                if s in r.text or share > 0.5 or SequenceMatcher(None, r.text, s).ratio() > 0.7:
                    want.add((r.doc_id, r.first, i))
    assert got == want and want


def test_similarity_is_difflibs(spark, sf_dir):
    from difflib import SequenceMatcher

    rows = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "x"), ("the cat sat", "the cat sits")], "a string, b string")
    from prosemill.operators import compare as C

    got = [r.r for r in rows.select(C.similarity_ratio("a", "b").alias("r")).collect()]
    assert got == [0.75, 1.0, None, SequenceMatcher(None, "the cat sat", "the cat sits").ratio()]


def test_chunks_follow_the_cursor(spark):
    from prosemill.operators import compare as C

    text = ["He ran.", "She said.", "It was.", '"So."', "Then."] + ["And so on."] * 25
    line = [1, 2, 5, 5, 6] + list(range(7, 32))
    rows = [(1, i, t, (n, 1, n, 9)) for i, (t, n) in enumerate(zip(text, line))] + [(2, 0, "One.", (1, 1, 1, 5))]
    df = spark.createDataFrame(rows, "doc_id long, sent_index int, sentence string, span struct<start_line:int,start_col:int,end_line:int,end_col:int>")
    want, i, n = [], 0, len(text)
    while i < n:
        first = i
        while i < n - 1:
            now, after = text[i], text[i + 1]
            if line[i + 1] > line[i] + 1 or now.lower().rstrip(".!? ").endswith(("said", "asked")) or (now.endswith('"') and not after.startswith('"')) or i - first >= 10:
                break
            i += 1
        if i == first:
            i += 1
        want.append((first, i - 1))
    got = sorted((r.doc_id, r.first, r.last) for r in C.chunks(df).collect())
    assert [x[1:] for x in got if x[0] == 1] == want and [x for x in got if x[0] == 2] == [(2, 0, 0)]


def test_similarity_ratio_takes_all_sentences(spark, tmp_path):
    from difflib import SequenceMatcher

    from prosemill.plans import catalog

    texts = [(0, "en", "src0", "It rained. He ran.  She sat.\n\nThey slept."), (1, "en", "src1", 'It rained. "Go on," he said. She sat.'), (2, "en", "src1", "Mr. Smith ran. He sat."), (4, "en", "src1", "")]
    spark.createDataFrame(texts, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    x = catalog._array_columns(spark, str(tmp_path)).collect()
    want = {r.doc_id: SequenceMatcher(None, *(" ".join(" ".join(s).split()) for s in (r.own, r.b))).ratio() for r in x}
    assert any(len(r.own) > 2 for r in x)
    assert {r.doc_id: r.ratio for r in catalog.similarity_ratio(spark, str(tmp_path)).collect()} == want


def test_word_overlap_pairs_are_all(spark, tmp_path):
    r = ["apple orchard grows slowly", "River banks; orchard", "a b c", "apple APPLE river slowly orchard"]
    spark.createDataFrame([(i, t, "en", "src0") for i, t in enumerate(r)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(0, "the orchard"), (39, "apple"), (40, "slowly river"), (199, "grows Apple")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {}
    for i, t in enumerate(r):
        w = {x for x in t.lower().split() if len(x) > 4}
        for k, o in items:
            want[i, k] = round(len(w & set(o.lower().split())) / len(w), 6) if w else 0.0
    assert {(x.doc_id, x.item_id): x.overlap for x in catalog.word_overlap_pairs(spark, str(tmp_path)).collect()} == want


def test_throughput_by_source_has_all_sources(spark, tmp_path):
    rows = [(0, "src0", 5), (1, "src1", 7), (2, "src1", 10), (3, None, 4)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(x) for x in catalog.throughput_by_source(spark, str(tmp_path)).collect()}
    assert got == {("src0", 5, 5, 5.0, 5), ("src1", 7, 10, 8.5, 17), (None, 4, 4, 4.0, 4)}


def test_similar_sentences_are_as_many_and_alike(spark, tmp_path):
    from difflib import SequenceMatcher

    texts = [(0, "It rained. He ran.  She sat.\n\nThey slept."), (1, 'It rained. "Go on," he said. She sat.'), (2, "Mr. Smith ran. He sat."), (4, ""), (5, "He ran. She sat.")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {r.doc_id: len(r.own) == len(r.b) and SequenceMatcher(None, " ".join(r.own), " ".join(r.b)).ratio() >= 0.9 for r in catalog._array_columns(spark, str(tmp_path)).collect()}
    assert {r.doc_id: r.similar for r in catalog.sentences_similar(spark, str(tmp_path)).collect()} == want and set(want.values()) == {True, False}


def test_shuffling_is_reproducible(spark, sf_dir):
    one, two = ([r.doc_id for r in catalog.shuffled_documents(spark, sf_dir).collect()] for _ in range(2))
    assert one == two and one != sorted(one)


def test_equal_gold_sentences_count_each(spark):
    from prosemill.operators import compare as C
    from prosemill.operators import segment as S

    gold = spark.createDataFrame([("He ran.", "normal"), ("He ran.", "normal"), ("He ran.", None), ("He ran. She sat.", "normal"), (None, "normal")], "text string, complexity string")
    got = {r.complexity: (r.total, r.correct, r.over_segmented, r.under_segmented) for r in C.evaluate(gold, S.SEGMENTERS["dialog"], "dialog").collect()}
    assert got == {"normal": (4, 2, 2, 0), None: (1, 1, 0, 0)}


def test_overlaps_compare_few_pairs_by_difflib(spark, sf_dir, monkeypatch):
    import random
    from difflib import SequenceMatcher

    from prosemill.operators import likeness as L

    r = random.Random(3)
    strings = ["".join(r.choice("abcdefgh é’𝒳,"[: r.randint(1, 13)]) for _ in range(r.choice([0, 1, 63, 64, 65, r.randint(0, 400), 1100]))) for _ in range(400)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    a, b = strings[:200], strings[200:]
    got = L.lcs_lengths(a, b).tolist()
    assert got[:60] == [lcs(x, y) for x, y in zip(a[:60], b[:60])]
    assert all(2 * g >= SequenceMatcher(None, x, y).ratio() * (len(x) + len(y)) - 1e-6 for g, x, y in zip(got, a, b))
    # Prose that is no more alike than its letters make it never gets to the quadratic comparison.
    prose = ["".join(r.choice("aaeeiinnrrsttdhlou  ") for _ in range(r.randint(150, 200))) for _ in range(60)]
    asked = []
    monkeypatch.setattr(L, "SequenceMatcher", lambda *x: asked.append(x) or SequenceMatcher(*x))
    like = "".join("#" if k % 5 == 4 and c != " " else c for k, c in enumerate(prose[0]))
    docs = [(0, s, s.lower()) for s in prose[:30]], [(k, s, s.lower()) for k, s in enumerate([*prose[30:], like])]
    assert L.neighbours([docs[0]], [docs[1]], 0, 40, 0.7) == [[(0, 30)]] and 1 <= len(asked) <= 3
    assert L.neighbours([None, [(0, None, None)], []], [docs[1], docs[1], None], 5, 20, 0.7) == [[], [], []]


def test_equal_texts_need_no_comparison(monkeypatch):
    import random
    from difflib import SequenceMatcher

    import pyarrow as pa

    from prosemill.operators import compare as C
    from prosemill.operators import likeness as L

    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghij éçàüößœ.,"[: r.randint(1, 20)]) for _ in range(r.randint(0, 600))) for _ in range(300)]
    texts.append("".join(chr(r.randint(97, 900)) for _ in range(2000)))
    assert all(SequenceMatcher(None, x, x).ratio() == 1.0 for x in texts)
    monkeypatch.setattr(L, "SequenceMatcher", None)
    monkeypatch.setattr("difflib.SequenceMatcher", None)
    got = [x for p in C._ratio().func(iter([(pa.array([*texts, None]), pa.array([*texts, "x"]))])) for x in p.to_pylist()]
    assert got == [1.0] * len(texts) + [None]


def test_word_overlaps_in_slices(spark):
    from prosemill.operators import compare as C

    docs = spark.createDataFrame([(0, "apple Orchard slowly é éclair"), (1, None), (2, "a b c"), (3, ""), (0, "orchard orchard"), (None, "apple")], "doc_id long, text string")
    items = [(0, "the orchard"), (5, None), (7, "éclair  apple\tslowly"), (7, "éclair  apple\tslowly"), (None, "apple"), (9, "")]
    table = spark.createDataFrame(items, "item_id int, text string")
    want = []
    for d, t in [tuple(r) for r in docs.collect()]:
        long = None if t is None else {w for w in t.lower().split() if len(w) > 4}
        want += [(d, i, None if long is None else 0.0 if not long else None if o is None else len(long & set(o.lower().split())) / len(long)) for i, o in items]
    for size in (1 << 20, 16):
        found = C.word_overlaps(docs, table, slice_bytes=size)
        assert found.schema.simpleString() == "struct<doc_id:bigint,item_id:int,overlap:double>"
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
        # No pair of texts is a row of a join.
        assert "Join" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert C.word_overlaps(docs, table.limit(0)).count() == 0


def test_only_left_needs_no_shuffle_and_minds_repeated_ids(spark, tmp_path):
    texts = [(0, "He ran. She sat. He ran."), (1, 'It rained. "Go on," he said. She sat.'), (2, None), (3, "")]
    more = [(1, "It rained. Go on. Mr. Smith ran."), (0, '"So it is." He ran.'), (None, '"Ah. No." He said.'), (None, "Mr. Hall sat. Ah. No.")]
    for name, rows in (("once", texts), ("twice", texts + more)):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        a, b = catalog._pair(spark, str(tmp_path / name))
        want = {tuple(r) for r in a.select("doc_id", "sentence").collect()} - {tuple(r) for r in b.select("doc_id", "sentence").collect()}
        df = catalog.seg_only_left(spark, str(tmp_path / name))
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        plan = df._jdf.queryExecution().toString()
        assert ("Join" in plan) == (name == "twice")


def test_bounds_of_likeness_lose_no_pair():
    import random
    from difflib import SequenceMatcher

    from prosemill.operators import likeness as L

    r = random.Random(11)
    texts = ["".join(r.choice("eeeettaaoinshr é,𝒳\0"[: r.randint(1, 18)]) for _ in range(r.randint(0, 160))) for _ in range(40)]
    sentences = [t[: r.randint(0, 90)] + "".join(r.choice("etaoins ") for _ in range(r.randint(0, 40))) for t in texts]
    i, j = zip(*((x, y) for x in range(40) for y in range(40)))
    for over in (0.3, 0.55, 0.7):
        want = [SequenceMatcher(None, texts[x], sentences[y]).ratio() > over for x, y in zip(i, j)]
        assert L.alike(texts, sentences, i, j, over).tolist() == want and any(want) and not all(want)
