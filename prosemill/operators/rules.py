"""Boundary rules: every combination of end, separator and start as a test case."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE = "id string, description string, end_chars array<string>, separators array<string>, start_chars array<string>, context_template string, expected_match_type string, expected_next_state string, creates_sentence_boundary boolean, validated boolean, current_state string, notes string"
CATEGORY = f"category string, description string, rules array<struct<{RULE.replace(', ', ',').replace(' ', ':').replace(',', ', ')}>>"

_END = {"": "none", ".": "period", "!": "excl", "?": "quest", '"': "dquote", "'": "squote"}
_GAP = {"": "none", " ": "space", "\t": "tab", "\n": "newline", "\n\n": "dnewline"}
_START = {**dict.fromkeys("ABHS", "upper"), **dict.fromkeys("abc", "lower"), **dict.fromkeys("129", "digit")} | {'"': "dquote", "'": "squote", "(": "lparen", ")": "rparen", "[": "lbracket", "]": "rbracket", "{": "lbrace", "}": "rbrace"}


def _label(c, table, other):
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), other)


def expand(rules: DataFrame, category="category") -> DataFrame:
    """One row a case of rules (a frame with RULE's columns and the category); empty lists of ends and separators count as one empty string."""

    def some(c):
        return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.array(F.lit(""))).otherwise(F.col(c))

    r = rules.withColumn("e", F.explode(some("end_chars"))).withColumn("g", F.explode(some("separators"))).withColumn("s", F.explode("start_chars"))
    r = r.withColumn("pattern", F.concat("e", "g", "s")).where(r"pattern rlike '(?U)\\S'")
    full = F.replace(F.replace(F.replace("context_template", F.lit("{end}"), F.col("e")), F.lit("{sep}"), F.col("g")), F.lit("{start}"), F.col("s"))
    r = r.withColumn("full_text", full).withColumn("p", F.greatest(F.expr("locate(pattern, full_text)"), F.lit(1)))
    start = _label(F.col("s"), _START, F.when(F.ascii("s") > 127, "unicode").otherwise("other"))
    ident = F.concat_ws("_", category, "id", _label(F.col("e"), _END, F.lit("other")), _label(F.col("g"), _GAP, F.lit("complex")), start)
    return r.select(
        ident.alias("id"),
        "pattern",
        F.coalesce("current_state", F.lit("Narrative")).alias("current_state"),
        "full_text",
        F.expr("substr(full_text, 1, p - 1)").alias("context_before"),
        F.expr("substr(full_text, p + length(pattern))").alias("context_after"),
        "expected_match_type",
        "expected_next_state",
        "creates_sentence_boundary",
        "validated",
        F.col("id").alias("source_rule"),
        F.col(category).alias("source_category"),
        F.concat("description", F.lit(" | Pattern: '"), "pattern", F.lit("'")).alias("notes"),
    )


def category_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("source_category").agg(F.count(F.lit(1)).alias("cases"))


def read_rules(spark, folder: str) -> DataFrame:
    """Rules of all JSON files of a folder but lists of known issues."""
    files = spark.read.schema(CATEGORY).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).where(~F.col("_metadata.file_name").eqNullSafe("known_issues.json"))
    return files.select("category", F.inline("rules"))


def write_generated(cases: DataFrame, sources: list[str], path: str, order="id") -> int:
    """Writes expanded cases as one JSON document of schema 2.0 to ``path``, or where BOUNDARY_TEST_OUTPUT says; returns their number.

    Cases come to the driver a partition at a time and go to the file one by one.
    """
    path, n = os.environ.get("BOUNDARY_TEST_OUTPUT", path), 0
    head = {"schema_version": "2.0", "description": "Cases expanded from boundary rules", "generated_from": sources}
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(json.dumps(head, ensure_ascii=False)[:-1] + ', "test_cases": [')
        for row in cases.orderBy(order).toLocalIterator():
            f.write((",\n" if n else "\n") + json.dumps(row.asDict(recursive=True), ensure_ascii=False))
            n += 1
        f.write("\n]}\n")
    os.replace(f"{path}.tmp", path)
    return n
