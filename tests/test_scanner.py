import json
import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prosemill.functions import patterns as P
from prosemill.operators import segment as S
from prosemill.operators.scanner import _narrative_id, break_rejected, line_breaks, position, scan


def cut(t):
    return [t[a:b] for a, b in scan(t)]


def norm(t):
    return re.sub(r"\s+", " ", t).strip()


COUNTS = [
    ("This is a sentence. This is another sentence.", 2),
    ('He said, "Stop it, sir! Ding-a-ling!" The headway ran out.', 2),
    ("Dr. Smith saw the patient. The results were clear.", 2),
    ("Mr. and Mrs. Hill arrived. They were late.", 2),
    ("The U.S.A. declared it. It was then.", 2),
    ("It is 2.5 mi. from here. We can walk.", 2),
    ("He said, 'Dr. Smith will see you.' She nodded.", 2),
    ('"Hello," she said quietly.', 1),
    ('"Yes" followed by more.', 1),
    ("(thinking) and then he spoke.", 1),
    ('"Wait!" he shouted loudly. Then he left.', 2),
    ("It was I. He left.", 1),
    ('Text "word"! More text.', 1),
    ("", 0),
    (" \n\t \r\n ", 0),
    ("One.\n\nTwo.", 2),
    ("One.\r\n\r\nTwo.", 2),
    ("He wrote this,\n\nand that.", 1),
    ("He wrote:\n\n\"So it is.\" Then he left.", 1),
    ('One.\n"Two." three', 1),
    ("(Mr. Smith", 2),
]


@pytest.mark.parametrize("text,n", COUNTS)
def test_counts(text, n):
    assert len(scan(text)) == n


def test_exact_texts():
    assert cut('He came. "Well," she said.') == ["He came.", '"Well," she said.']
    assert cut("He said ”so” The end. Next.")[0] == "He said ”so” The end."
    # A smart quote closed without an end mark is dropped between its neighbours.
    assert cut("He said, “so” The end.") == ["He said, “so", "The end."]
    # The next slice begins right behind the first break of several.
    assert cut("One.\n\n\nTwo.") == ["One.", "\nTwo."]
    assert cut("One.\n\n\n\"Two.\" And three.")[1].startswith("\n\"Two")


def test_look_back_is_in_bytes():
    assert not break_rejected("é" + " " * 18 + "\n\n", 19)
    assert break_rejected("é" + " " * 19 + "\n\n", 20)
    assert break_rejected("a,\n\n", 2) and not break_rejected("\n\n", 0) and break_rejected("a" + " " * 20 + "\n\n", 21)
    assert break_rejected("x…\n\n", 2) and not break_rejected("x”\n\n", 2)


def test_trace_of_the_known_example():
    t = []
    scan('He said "Hello world!" and left. She replied "Goodbye!" quickly.', t)
    assert [(x[0], x[1], x[2], x[3], x[4], x[5]) for x in t] == [
        (0, "Narrative", "DialogDoubleQuote", "Continue", ' "', "IndependentDialog[0]"),
        (0, "DialogDoubleQuote", "Narrative", "Continue", '!" a', "DialogSoftEnd"),
        (1, "Narrative", "Narrative", "Split", ". S", "NarrativeSentenceBoundary"),
        (1, "Narrative", "DialogDoubleQuote", "Continue", ' "', "IndependentDialog[0]"),
        (1, "DialogDoubleQuote", "Narrative", "Continue", '!" q', "DialogSoftEnd"),
    ]
    assert t[0][6] == "He said \"Hello worl"


ALPHABET = ["a", "B", "é", ".", "!", "?", ",", ";", ":", " ", "\t", "\n", "\n\n", "\r\n", "\r\n\r\n", '"', "'", "“", "”", "‘", "’", "(", ")", "[", "]", "{", "}", "Mr.", " The ", "\xa0", "\x1c"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
def test_invariants(t):
    got = scan(t)
    assert all(a < b and t[a:b].strip(P.SPACES) for a, b in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    breaks = line_breaks(t)
    for a, _ in got:
        assert position(breaks, a) == (1 + t.count("\n", 0, a), a - t.rfind("\n", 0, a))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join))
def test_one_narrative_pattern_stands_for_all(t):
    from prosemill.operators.scanner import _NARRATIVE, _python

    every = re.compile("|".join(f"({_python(p)})" for p, *_ in P.JOINTS[0]))
    a, b = every.search(t), _NARRATIVE.search(t)
    assert (a is None) == (b is None)
    if a:
        assert a.span() == b.span() and a.lastindex - 1 == _narrative_id(b[0])


def test_arrow_batches_split_as_the_scanner_does(spark):
    r = random.Random(3)
    bits = ["a", "Bo", "é.", ".", "!", "?", ",", " ", "\t", "\n", "\r\n", " Mr.", "Dr. X", "I.", "'s", '"', "”", "\xa0Jr.", "\x1cSt. "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(3000)] + [None, "", "\x01a. B"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.s for x in df.select("doc_id", S.raw_sentences("text").alias("s")).collect()}
    assert all(got[i] == ([] if t is None else cut(t)) for i, t in enumerate(texts))


def test_segment_gives_spans_raw_text_and_normal_text(spark):
    t = "First line\nends here. Second\tone.\n\n“Third,” he said.  Last "
    df = spark.createDataFrame([(7, "x", t), (8, "y", None)], "doc_id long, sent_index string, text string")
    rows = S.segment(df.select("doc_id", "text")).collect()
    assert [x.raw for x in rows] == cut(t) and [x.sentence for x in rows] == [norm(x) for x in cut(t)]
    assert tuple(rows[0].span) == (1, 1, 2, 11) and rows[0].sent_index == 0
    S.register(spark)
    df.createOrReplaceTempView("books")
    assert spark.sql("SELECT doc_id, s.* FROM books, LATERAL segment_text(text) s").count() == len(rows)
    assert spark.sql("SELECT sentences(text) AS s FROM books WHERE doc_id = 7").first().s == cut(t)


def test_rule_cases_scan_without_error(spark):
    from prosemill.operators import rules as R
    from prosemill.plans import catalog

    cases = R.expand(catalog._rules(spark)).collect()
    assert len(cases) > 20
    for c in cases:
        assert "".join(c.full_text.split()) and len(scan(c.full_text)) >= 1
        assert c.context_before + c.pattern + c.context_after == c.full_text


def test_rules_are_read_from_json(spark, tmp_path):
    from prosemill.operators import rules as R

    rule = {"id": "r", "description": "d", "end_chars": ["."], "separators": [" "], "start_chars": ["A", "a"], "context_template": "x{end}{sep}{start}y", "expected_match_type": "m", "expected_next_state": "n", "creates_sentence_boundary": True, "validated": False}
    (tmp_path / "one.json").write_text(json.dumps({"category": "c", "description": "", "rules": [rule]}))
    (tmp_path / "known_issues.json").write_text(json.dumps({"category": "k", "rules": [rule]}))
    got = R.expand(R.read_rules(spark, str(tmp_path))).collect()
    assert {x.id for x in got} == {"c_r_period_space_upper", "c_r_period_space_lower"} and got[0].current_state == "Narrative"
    assert os.path.exists(tmp_path / "one.json")


def test_long_texts_take_time_by_length(spark):
    import time

    from prosemill.operators import segment as S

    text = 'He ran to Mr. Hill. "So," she said. They sat\nthere. ' * 40_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    S.segment(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    began = time.time()
    assert S.segment(df).agg({"raw": "count"}).first()[0] > 100_000
    assert time.time() - began < 20


def test_a_title_behind_many_quotes_is_one():
    from prosemill.operators.scanner import ends_with_title

    for n in (0, 10, 70, 300):
        assert ends_with_title("x " + '"' * n + "Mr.") and ends_with_title('"' * n + "Mr.")
    assert not ends_with_title("x" + '"' * 70 + "Mr.")


def test_batches_are_worked_on_in_portions(spark):
    import pyarrow as pa

    from prosemill.operators import segment as S
    from prosemill.operators.portions import BYTES, portions

    texts = ['He ran. "Go on," she said. ' * 4000, None, "", *["It rained. He sat."] * 100_000]
    f = S._scanned("traced").func
    parts = list(f(iter([pa.array(texts)])))
    assert sum(map(len, parts)) == len(texts) and len(parts) > 3
    # No portion makes more than its bytes of text do.
    assert max(len(p.flatten()) for p in parts) <= BYTES // 8
    assert list(portions([pa.array(["ab", "c", None, "defghi", "", ""])], 5)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(portions([pa.array([], pa.string())])) == []
    assert list(portions([pa.array([[(1, "ab")], None, [(1, "c"), (2, "d")], []], pa.list_(pa.struct([("k", pa.int32()), ("s", pa.string())])))], 7)) == [(0, 2), (2, 3), (3, 4)]
    whole = [x for p in parts for x in p.to_pylist()]
    assert whole[1:3] == [None, []] or whole[1:3] == [[], []]
    assert [x["raw"] for x in whole[-1]] == ["It rained.", "He sat."] and len(whole[0]) > 8000
