import json
import os

import pytest

from prosemill import __main__ as cli
from prosemill.operators import stats
from prosemill.sources import corpus as K
from prosemill.streaming import books


@pytest.fixture
def shelf(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a-0.txt").write_bytes(b"One here.\r\nTwo here. Three.")
    (tmp_path / "sub" / "b-0.txt").write_bytes("Élan. \"Well,\" he said. End.".encode())
    (tmp_path / "sub" / "c-1.txt").write_bytes(b"Not a book.")
    (tmp_path / "bad-0.txt").write_bytes(b"\xff\xfe\xfd")
    (tmp_path / "empty-0.txt").write_bytes(b"")
    return tmp_path


def test_discovery_and_reading(spark, shelf):
    found = K.discover(spark, str(shelf))
    assert {os.path.basename(r.path) for r in K.valid_paths(found).collect()} == {"a-0.txt", "b-0.txt", "bad-0.txt"}
    local = K.discover_local(spark, str(shelf))
    assert local.count() == 4 and K.discovery_counts(local).first() == (4, 0)
    assert K.discover(spark, str(shelf / "nowhere")).first().error
    with pytest.raises(NotADirectoryError):
        K.discover(spark, str(shelf / "nowhere"), fail_fast=True)
    rows = {os.path.basename(r.path): r for r in K.read_texts(spark, str(shelf)).collect()}
    assert rows["a-0.txt"].text == "One here.\r\nTwo here. Three." and rows["bad-0.txt"].text is None and "UTF-8" in rows["bad-0.txt"].error
    with pytest.raises(Exception, match="UTF-8"):
        K.read_texts(spark, str(shelf), fail_fast=True).collect()
    for bad, kind in (("nowhere", FileNotFoundError), ("sub", IsADirectoryError), ("sub/c-1.txt", ValueError)):
        with pytest.raises(kind):
            K.check_single(str(shelf / bad))


def test_run_restart_and_round_trip(spark, shelf):
    first = K.run(spark, str(shelf), stats_out=str(shelf / "stats.json"), debug=True, length_stats=True)
    assert (first["files_processed"], first["files_failed"], first["files_skipped"]) == (3, 1, 0) and first["total_sentences_detected"] == 6
    assert json.loads((shelf / "stats.json").read_text())["run_start"].isdigit()
    out = (shelf / "a-0_sentences.txt").read_text()
    assert out == "0\tOne here.\t(1,1,1,10)\n1\tTwo here.\t(2,1,2,10)\n2\tThree.\t(2,11,2,17)\n"
    assert (shelf / "a-0_sentences-debug.txt").read_text().startswith(K.DEBUG_HEADER + "\n0\tOne here.")
    assert [s for s in first["file_stats"] if s["path"].endswith("a-0.txt")][0]["sentence_length_stats"]["max"] == 9
    again = K.run(spark, str(shelf))
    assert (again["files_processed"], again["files_skipped"], again["files_failed"]) == (0, 3, 1)
    os.remove(shelf / "a-0_sentences.txt")
    assert K.run(spark, str(shelf))["files_processed"] == 1
    assert K.run(spark, str(shelf), overwrite=True)["files_processed"] == 3
    assert K.run(spark, str(shelf / "a-0.txt"))["files_processed"] == 1
    back = K.read_sentences(spark, str(shelf / "a-0_sentences.txt")).collect()
    assert [(r.sent_index, r.sentence, tuple(r.span)) for r in back][1] == (1, "Two here.", (2, 1, 2, 10))
    (shelf / K.LOG).write_text("{broken")
    assert K.load_log(str(shelf)) == set()


def test_two_field_lines_and_gold(spark, tmp_path):
    (tmp_path / "x.txt").write_text("# note\n\n0\tOne.\n1\tTwo.\t(1,2,3,4)\n")
    p = str(tmp_path / "x.txt")
    assert K.read_sentences(spark, p).count() == 1
    assert tuple(K.read_sentences(spark, p, True).where("sent_index = 0").first().span) == (-1,) * 4
    (tmp_path / "g.json").write_text(json.dumps({"sentences": [{"text": "A.", "source_file": "f", "method": "m", "complexity": "normal", "line_number": 3}]}))
    gold = K.read_gold(spark, str(tmp_path / "g.json"))
    assert gold.first().line_number == 3
    report = json.loads(K.gold_report(gold, "complexity", "method").first().json)
    assert report["total"] == 1 and len(report["distributions"]) == 2 and report["examples"][0]["text"] == "A."


def test_known_statistics(spark):
    df = spark.createDataFrame([(1, x) for x in (4, 1, 3, 2)] + [(2, 5)], "k int, length int")
    got = {r.k: r for r in stats.length_stats(df, "k").collect()}
    assert tuple(got[1])[2:] == (1, 4, 2.5, 2.5, 2.0, 4.0, 4.0, 1.118033988749895)
    assert tuple(got[2])[2:] == (5, 5, 5.0, 5.0, 5.0, 5.0, 5.0, 0.0)
    assert stats.length_stats(df.limit(0), "k").count() == 0


def test_streams(spark, shelf, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    books.segment_stream(spark, str(shelf), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 6
    (shelf / "new-0.txt").write_text("Late. Later.")
    books.segment_stream(spark, str(shelf), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 8


def test_command_line(spark, shelf, capsys, monkeypatch):
    assert cli.main(["--debug-text", "A b. C d."]) == 0
    assert "NarrativeSentenceBoundary" in capsys.readouterr().out
    assert cli.main([str(shelf / "nowhere")]) == 1
    assert cli.main([str(shelf), "-q", "--stats-out", str(shelf / "s.json")]) == 0 and (shelf / "s.json").exists()
    assert cli.main([str(shelf / "bad-0.txt"), "-q", "--stats-out", str(shelf / "s.json")]) == 1
    for bad in ([], ["--debug-text", "x", "--debug-stdin"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_generated_cases_are_one_document(spark, tmp_path, monkeypatch):
    from prosemill.operators import rules
    from prosemill.plans import catalog

    cases = rules.expand(catalog._rules(spark))
    n = rules.write_generated(cases, ["narrative.json"], str(tmp_path / "a.json"))
    doc = json.loads((tmp_path / "a.json").read_text(encoding="utf-8"))
    assert doc["schema_version"] == "2.0" and doc["generated_from"] == ["narrative.json"] and n == cases.count()
    assert sorted(map(str, doc["test_cases"])) == sorted(str(r.asDict()) for r in cases.collect())
    monkeypatch.setenv("BOUNDARY_TEST_OUTPUT", str(tmp_path / "b.json"))
    assert rules.write_generated(cases.limit(0), [], str(tmp_path / "c.json")) == 0
    assert json.loads((tmp_path / "b.json").read_text())["test_cases"] == [] and not (tmp_path / "c.json").exists()
