"""Corpora of text files: discovery, reading, per-file results, restart and run statistics."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = "*-0.txt"
SUFFIX = "_sentences.txt"
LOG = ".prosemill_restart.json"


def discover(spark: SparkSession, root: str, pattern: str = PATTERN, fail_fast: bool = False) -> DataFrame:
    """(path, error) of files under ``root`` by Spark's parallel listing. Files are not read, so not decoded yet."""
    if not root.split(":")[0].isalpha() and not os.path.isdir(root):
        if fail_fast:
            raise NotADirectoryError(root)
        return spark.createDataFrame([(root, "not a directory")], "path string, error string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.lit(None).cast("string").alias("error"))


def discover_local(spark: SparkSession, root: str, pattern: str = PATTERN) -> DataFrame:
    """Discovery on the driver's own disk that also lists hidden and empty files, which Spark's listing leaves out."""
    import fnmatch

    rows = sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if fnmatch.fnmatch(f, pattern))
    return spark.createDataFrame([(p, None if os.path.isfile(p) else "not a file") for p in rows], "path string, error string")


def valid_paths(files: DataFrame) -> DataFrame:
    return files.where("error is null").select("path")


def discovery_counts(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(F.col("error").isNull()).alias("valid"), F.count_if(F.col("error").isNotNull()).alias("invalid"))


def check_single(path: str) -> str:
    """The path, if it is one readable book; otherwise an error that says what is wrong."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no such file: {path}")
    if not os.path.isfile(path):
        raise IsADirectoryError(f"not a file: {path}")
    if not path.endswith("-0.txt"):
        raise ValueError(f"not a book (its name must end in -0.txt): {path}")
    return path


def read_texts(spark: SparkSession, root: str, pattern: str = PATTERN, fail_fast: bool = False) -> DataFrame:
    """(path, text, bytes, error): texts exactly as they are; a file that isn't UTF-8 has an error instead, or stops the job."""
    reader = spark.read.format("binaryFile")
    if os.path.isdir(root) or not os.path.isfile(root):
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return _decoded(reader.load(root), fail_fast)


def _decoded(files: DataFrame, fail_fast: bool = False) -> DataFrame:
    good = F.is_valid_utf8(F.col("content").cast("string"))
    error = F.when(~good, F.lit("not valid UTF-8"))
    if fail_fast:
        error = F.when(~good, F.raise_error(F.concat(F.lit("not valid UTF-8: "), F.col("path"))).cast("string"))
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.when(good, F.col("content").cast("string")).alias("text"), F.col("length").alias("bytes"), error.alias("error"))


def literal(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("literal", text)], "path string, text string")


def result_path(c, suffix: str = SUFFIX):
    """Where a book's sentences go: beside it, under its name without the extension."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.regexp_replace(c, r"\.[^./]*$", ""), F.lit(suffix))


def debug_path(c, suffix: str = SUFFIX):
    return F.regexp_replace(result_path(c, suffix), r"\.txt$", "-debug.txt")


def sentence_lines(segmented: DataFrame):
    """A segmented frame as lines of index, sentence and span."""
    from prosemill.functions.text import format_span

    return segmented.select("*", F.concat_ws("\t", F.col("sent_index").cast("string"), "sentence", format_span("span")).alias("line"))


DEBUG_HEADER = "index\tsentence\tspan\tstate_before\tstate_after\ttransition_type\tmatched_pattern\tpattern_name\tseam_text"


def debug_lines(traced: DataFrame) -> DataFrame:
    from prosemill.functions.text import format_span, tsv_escape

    cols = [F.col("sent_index").cast("string"), tsv_escape("sentence"), format_span("span"), "state_before", "state_after", "transition", tsv_escape("matched"), "pattern", tsv_escape("seam")]
    return traced.select("*", F.concat_ws("\t", *cols).alias("line"))


def fixed_width_lines(s: DataFrame, text="sentence"):
    return s.select("*", F.format_string("%-5d %-5d %s", F.col("sent_index") + 1, F.octet_length(text), F.col(text)).alias("line"))


def write_beside(lines: DataFrame, key="path", order=("sent_index",), suffix: str = SUFFIX, header: str | None = None) -> DataFrame:
    """Writes each path's lines to the file beside it, where all workers see it; (path, out, lines, error).

    A file is written under another name and then renamed, so a task that is run again replaces it whole.
    """
    import pyarrow as pa

    def save(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order])
        path = t.column(key)[0].as_py()
        stem, out, error = os.path.splitext(path)[0], None, None
        try:
            with open(f"{stem}{suffix}.{os.getpid()}.tmp", "w", encoding="utf-8", newline="") as f:
                if header:
                    f.write(header + "\n")
                for line in t.column("line").to_pylist():
                    if line is not None:
                        f.write(line + "\n")
            os.replace(f.name, stem + suffix)
            out = stem + suffix
        except OSError as e:
            error = str(e)
        return pa.table({key: pa.array([path]), "out": pa.array([out], pa.string()), "lines": pa.array([t.num_rows], pa.int64()), "error": pa.array([error], pa.string())})

    return lines.select(key, *order, "line").groupBy(key).applyInArrow(save, f"{key} string, out string, lines long, error string")


def complete_file(path: str, content: str, suffix: str = SUFFIX) -> str:
    out = os.path.splitext(path)[0] + suffix
    with open(out, "w", encoding="utf-8", newline="") as f:
        f.write(content if content.endswith("\n") else content + "\n")
    return out


def read_sentences(spark: SparkSession, path: str, keep_without_span: bool = False) -> DataFrame:
    """(path, sent_index, sentence, span) of written files; blank and # lines are skipped.

    Lines of two fields have no span: they count, with -1 everywhere, only on request.
    """
    from prosemill.functions.text import parse_span

    t = spark.read.text(path).select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"), "value").where("trim(value) <> '' and not startswith(value, '#')")
    t = t.withColumn("f", F.split("value", "\t", -1)).where(F.size("f") >= (2 if keep_without_span else 3))
    none = F.struct(*[F.lit(-1).alias(n) for n in ("start_line", "start_col", "end_line", "end_col")])
    span = parse_span(F.get("f", F.lit(2)))
    if keep_without_span:
        span = F.when(F.size("f") == 2, none).otherwise(span)
    return t.select("path", F.get("f", F.lit(0)).try_cast("int").alias("sent_index"), F.get("f", F.lit(1)).alias("sentence"), span.alias("span"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    kind = "text string, source_file string, method string, complexity string, line_number int"
    return spark.read.schema(f"sentences array<struct<{kind.replace(' ', ':').replace(',:', ', ')}>>").option("multiLine", True).json(path).select(F.inline("sentences"))


def gold_report(examples: DataFrame, *dimensions) -> DataFrame:
    """One JSON string: distributions and the examples themselves."""
    from prosemill.operators.compare import distribution

    counts = distribution(examples, *dimensions).agg(F.collect_list(F.struct("dimension", "value", "n")).alias("distributions"))
    rows = examples.agg(F.collect_list(F.struct("*")).alias("examples"), F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(rows).select(F.to_json(F.struct("total", "distributions", "examples")).alias("json"))


# Restart: what is done, kept as a small JSON file at the root.


def load_log(root: str) -> set[str]:
    """Completed paths; a missing or broken log is an empty one."""
    try:
        with open(os.path.join(root, LOG), encoding="utf-8") as f:
            return set(json.load(f)["completed_files"])
    except (OSError, ValueError, KeyError, TypeError):
        return set()


def save_log(root: str, done) -> None:
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, LOG), "w", encoding="utf-8") as f:
        json.dump({"completed_files": sorted(done), "last_updated": int(time.time())}, f, indent=2)


def pending(files: DataFrame, completed: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Files to do: all but those that are completed and whose result exists. ``completed``: path; ``existing``: out."""
    if overwrite:
        return files
    done = completed.select("path").withColumn("out", result_path("path")).join(existing.select("out"), "out", "left_semi")
    return files.join(done.select("path"), "path", "left_anti")


def prune(completed: DataFrame, sources: DataFrame, existing: DataFrame) -> DataFrame:
    """Completed paths whose source and result both still exist."""
    return completed.withColumn("out", result_path("path")).join(sources.select("path"), "path", "left_semi").join(existing.select("out"), "out", "left_semi").select("path")


def run(spark: SparkSession, root: str, overwrite: bool = False, fail_fast: bool = False, stats_out: str | None = None, debug: bool = False, length_stats: bool = False, clear: bool = False) -> dict:
    """Segments every pending book under ``root``, writes results beside them, and returns the run's statistics."""
    from prosemill.operators import segment as S
    from prosemill.operators import stats

    began = time.time()
    single = os.path.isfile(root)
    done = set() if single or clear else load_log(root)
    found = [check_single(root)] if single else [r.path for r in valid_paths(discover_local(spark, root)).collect()]
    exists = lambda p: os.path.exists(os.path.splitext(p)[0] + SUFFIX)
    done = {p for p in done if os.path.exists(p) and exists(p)}
    todo = [p for p in found if overwrite or single or p not in done]
    rows, failed = [], []
    if todo:
        # Empty files are left out by the reader; they have no sentences.
        full = [p for p in todo if os.path.getsize(p)]
        for p in set(todo) - set(full):
            complete_file(p, "\n")
            rows.append({"path": p, "chars_processed": 0, "sentences_detected": 0, "status": "success", "error": None})
        if full:
            texts = _decoded(spark.read.format("binaryFile").load(full), fail_fast)
            seg = S.segment(texts.where("text is not null"), ("path", "bytes"), "text")
            written = write_beside(sentence_lines(texts.select("path").join(seg, "path", "left").where("sent_index is not null")))
            wrote = {r.path: r for r in written.collect()}
            if debug:
                write_beside(debug_lines(S.traced_sentences(texts.where("text is not null"), ("path",))), order=("sent_index", "step"), suffix=SUFFIX.replace(".txt", "-debug.txt"), header=DEBUG_HEADER).collect()
            by = {r.path: r for r in (stats.file_stats(seg, "path").collect() if length_stats else [])}
            for t in texts.select("path", F.length("text").alias("chars"), "bytes", "error").collect():
                w = wrote.get(t.path)
                error = t.error or (w.error if w else None)
                row = {"path": t.path, "chars_processed": t.chars or 0, "bytes": t.bytes, "sentences_detected": 0 if error or not w else w.lines, "status": "failed" if error else "success", "error": error}
                if t.path in by:
                    row["sentence_length_stats"] = {k: by[t.path][k] for k in stats.NAMES}
                if not error and not w:
                    complete_file(t.path, "\n")
                rows.append(row)
                failed += [t.path] if error else []
    if not single:
        save_log(root, (done | set(todo)) - set(failed))
    skipped = [p for p in found if p not in set(todo)]
    took = time.time() - began
    rows += [{"path": p, "chars_processed": 0, "sentences_detected": 0, "status": "skipped", "error": None} for p in skipped]
    total = sum(r.get("bytes", 0) for r in rows)
    out = {
        "run_start": str(int(began)),
        "total_processing_time_ms": int(took * 1000),
        "total_chars_processed": total,
        "total_sentences_detected": sum(r["sentences_detected"] for r in rows),
        "overall_chars_per_sec": total / took if took else 0.0,
        "files_processed": sum(r["status"] == "success" for r in rows),
        "files_skipped": len(skipped),
        "files_failed": len(failed),
        "file_stats": rows,
    }
    if stats_out:
        with open(stats_out, "w", encoding="utf-8") as f:
            json.dump(out, f, indent=2)
    return out
