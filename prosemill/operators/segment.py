"""Segmentation of narrative text into sentences.

``sentences`` gives order and text, ``segment`` adds exact spans, ``transitions`` the
trace of states. Each is one pass of the scanner over Arrow batches, and nothing is
shuffled. (Splitting the texts that can't leave the narrative state by regular
expressions in the JVM gave the same rows in four times the scanner's time.) The
dictionary and simple segmenters are Column expressions. A null text has no sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions import patterns as P
from prosemill.functions.text import normalize
from prosemill.operators.portions import hand_back, portions
from prosemill.operators.scanner import line_breaks, position, scan

_SPAN = "struct<raw:string,start_line:int,start_col:int,end_line:int,end_col:int>"
_TRACED = _SPAN[:-1] + ",sent_index:int,step:int,state_before:string,state_after:string,transition:string,matched:string,pattern:string,seam:string>"
_STEP = "struct<sent_index:int,state_before:string,state_after:string,transition:string,matched:string,pattern:string,seam:string>"
#: Noncharacters that mark boundaries in between; texts have no use for them.
_STOP, _GO = "\ufdd0", "\ufdd1"

_ARRAYS = {"raw": "array<string>", "spans": f"array<{_SPAN}>", "trace": f"array<{_STEP}>", "traced": f"array<{_TRACED}>", "count": "int"}


def _with_steps(spans, trace):
    """Each sentence with its transitions, of which it has none or more; those behind the last sentence belong to none."""
    k = 0
    for n, s in enumerate(spans):
        first = k
        while k < len(trace) and trace[k][0] == n:
            yield (*s, n, k, *trace[k][1:])
            k += 1
        if k == first:
            yield (*s, n, None, "Unknown", "Unknown", "Unknown", "", "Unknown", "no_seam_text")


def _scanned(kind):
    """An Arrow function text -> array of raw sentences, sentences with spans, transitions, or sentences with both; or the count of sentences."""

    def run(cols):
        for col in (c.slice(a, b - a) for c in cols for a, b in portions([c])):
            out, sizes = [], [0]
            for t in col.to_pylist():
                if kind == "count":
                    sizes.append(0 if t is None else len(scan(t)))
                    continue
                if t is None:
                    sizes.append(sizes[-1])
                    continue
                if kind == "trace":
                    scan(t, out)
                elif kind == "raw":
                    out.extend(t[a:b] for a, b in scan(t))
                else:
                    breaks = line_breaks(t)
                    trace = [] if kind == "traced" else None
                    spans = [(t[a:b], *position(breaks, a), *position(breaks, b)) for a, b in scan(t, trace)]
                    out.extend(spans if trace is None else _with_steps(spans, trace))
                sizes.append(len(out))
            if kind == "count":
                yield pa.array(sizes[1:], pa.int32())
                continue
            if kind == "raw":
                values = pa.array(out, pa.string())
            else:
                names, kinds = zip(*(f.split(":") for f in _ARRAYS[kind][len("array<struct<") : -2].split(",")))
                columns = zip(*out) if out else [()] * len(names)
                values = pa.StructArray.from_arrays([pa.array(c, pa.int32() if k == "int" else pa.string()) for c, k in zip(columns, kinds)], names)
            yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
        hand_back()

    run.__annotations__ = {"cols": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _ARRAYS[kind])


def raw_sentences(text) -> Column:
    """Raw sentences in order, as an array; none for a null text."""
    return _scanned("raw")(F.col(text) if isinstance(text, str) else text)


def sentence_spans(text) -> Column:
    """Raw sentences with their lines and columns in order, as an array; none for a null text."""
    return _scanned("spans")(F.col(text) if isinstance(text, str) else text)


def sentence_count(text) -> Column:
    """How many sentences a text has. It passes for nondeterministic, lest a filter on it scan the text once more."""
    return _scanned("count").asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def _exploded(df: DataFrame, id_cols, name, index="sent_index") -> DataFrame:
    """One row an element of ``_s``. An inner explode would have its array checked for elements below it, and so scanned twice."""
    return df.select(*id_cols, F.posexplode_outer("_s").alias(index, name)).where(F.col(index).isNotNull())


def sentences(df: DataFrame, id_cols=("doc_id",), text_col="text") -> DataFrame:
    """(ids, sent_index, raw, sentence): one row a sentence; ``sentence`` is normalized."""
    s = _exploded(df.select(*id_cols, raw_sentences(text_col).alias("_s")), id_cols, "raw")
    return s.withColumn("sentence", normalize("raw"))


def segment(df: DataFrame, id_cols=("doc_id",), text_col="text") -> DataFrame:
    """``sentences`` with ``span``: start_line, start_col, end_line, end_col from 1, the end column excluded."""
    # The scanner hands out the sentences themselves: cutting them from a text in every row would take its length for each.
    s = _exploded(df.select(*id_cols, _scanned("spans")(F.col(text_col)).alias("_s")), id_cols, "_s")
    return s.select(*id_cols, "sent_index", "_s.raw", _span("_s")).withColumn("sentence", normalize("raw"))


def _span(c) -> Column:
    return F.struct(*[F.col(f"{c}.{n}") for n in ("start_line", "start_col", "end_line", "end_col")]).alias("span")


def transitions(df: DataFrame, id_cols=("doc_id",), text_col="text") -> DataFrame:
    """(ids, step, sent_index, state_before, state_after, transition, matched, pattern, seam): the scanner's trace."""
    t = _exploded(df.select(*id_cols, _scanned("trace")(F.col(text_col)).alias("_s")), id_cols, "_t", "step")
    return t.select(*id_cols, "step", "_t.*")


def traced_sentences(df: DataFrame, id_cols=("doc_id",), text_col="text") -> DataFrame:
    """Every sentence with its transitions, of one scan; one without gets a row of unknowns."""
    t = _exploded(df.select(*id_cols, _scanned("traced")(F.col(text_col)).alias("_s")), id_cols, "_s", "_at")
    return t.select(*id_cols, "_s.sent_index", normalize("_s.raw").alias("sentence"), _span("_s"), *[f"_s.{n}" for n in ("step", "state_before", "state_after", "transition", "matched", "pattern", "seam")])


def dictionary_sentences(df: DataFrame, id_cols=("doc_id",), text_col="text") -> DataFrame:
    """The dictionary segmenter: a boundary at end mark, white space and capital or opener, but for seven titles. All in the JVM.

    A boundary's closing quote belongs to the sentence before it.
    """
    few = "|".join(t[:-1] for t in P.FEW_TITLES)
    q = P.QUOTES
    marked = F.regexp_replace(text_col, r"(?U)([.!?]['\"”’]?)(\s+)(?=[A-Z'\"“‘])|([.!?])(\s+)(?=[(\[{])", f"$1$3{_STOP}$2$4{_GO}")
    # Marks behind titles are taken back.
    titles = rf"(?<![^{P.SPACE_CLASS[1:-1]}{_GO}])([{q}]{{0,4}}(?:{few})\.['\"”’]?){_STOP}([^{_GO}]*){_GO}"
    parts = F.split(F.regexp_replace(marked, titles, "$1$2"), _GO, -1)
    kept = F.filter(F.transform(parts, lambda p: F.regexp_replace(F.substring_index(p, _STOP, 1), r"(?U)\A\s+|\s+\z", "")), lambda s: s != "")
    return df.select(*id_cols, F.posexplode(kept).alias("sent_index", "sentence"))


def simple_parts(text) -> Column:
    """The simple splitter's sentences in order, as an array."""
    return F.filter(F.transform(F.split(F.col(text) if isinstance(text, str) else text, r"(?<=[.!?])\s+(?=[A-Z])", -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def simple_sentences(df: DataFrame, id_cols=("doc_id",), text_col="text") -> DataFrame:
    """Splits at white space between an end mark and a capital."""
    return df.select(*id_cols, F.posexplode(simple_parts(text_col)).alias("sent_index", "sentence"))


#: Segmenters by name; further ones, such as wrappers of libraries, can be added as functions of the same form.
SEGMENTERS = {
    "dialog": lambda df, ids=("doc_id",), text="text": sentences(df, ids, text).drop("raw"),
    "dictionary": dictionary_sentences,
    "simple": simple_sentences,
}


def register(spark) -> None:
    """SQL names: ``sentences(text)`` as an array and ``segment_text(text)`` as a table function for LATERAL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="sent_index int, raw string, start_line int, start_col int, end_line int, end_col int")
    class SegmentText:
        def eval(self, text: str):
            if text is not None:
                breaks = line_breaks(text)
                for i, (a, b) in enumerate(scan(text)):
                    yield i, text[a:b], *position(breaks, a), *position(breaks, b)

    spark.udtf.register("segment_text", SegmentText)
    spark.udf.register("sentences", _scanned("raw"))
