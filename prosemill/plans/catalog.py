"""All queries of the base engine, with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosemill.functions import patterns as P
from prosemill.functions import text as T
from prosemill.operators import compare as C
from prosemill.operators import rules as R
from prosemill.operators import segment as S
from prosemill.operators import stats as A
from prosemill.plans import oracle as O
from prosemill.sources import corpus as K
from prosemill.sources.tables import read_table
from prosemill.streaming import books

_QUERIES, _SQL = {}, {}


def query(sql=None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql() if callable(sql) else sql
        return f

    return add


def docs(spark, d):
    return read_table(spark, d, "documents")


def dialog_docs(spark, d):
    """documents with ``text`` made rich in dialog, as the SQL has it."""
    out = None
    for k, rules in enumerate(O.DIALOG_RULES):
        e = F.col("text")
        for a, b in rules:
            e = F.replace(e, F.lit(a), F.lit(b))
        out = F.when(F.col("doc_id") % len(O.DIALOG_RULES) == k, e) if out is None else out.when(F.col("doc_id") % len(O.DIALOG_RULES) == k, e)
    return docs(spark, d).withColumn("text", out)


_DOCS = "SELECT doc_id, lang, source, text AS t FROM documents"
_DIALOG = f"SELECT doc_id, lang, source, {O.dialog_text()} AS t FROM documents"
_PLAIN = O.sentences("SELECT doc_id, text AS t FROM documents")
_RICH = O.sentences(_DIALOG)
_NORM = O.normalize("raw")

# Scalar functions.


@query(lambda: f"SELECT doc_id, {O.normalize('text')} AS normalized FROM documents")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", T.normalize("text").alias("normalized"))


@query("SELECT doc_id, length(text) AS chars, strlen(text) AS bytes FROM documents")
def char_byte_len(spark, d):
    return docs(spark, d).select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT doc_id, replace(replace(text, chr(10), '\\n'), chr(9), '\\t') AS escaped FROM documents")
def tsv_escape(spark, d):
    return docs(spark, d).select("doc_id", T.tsv_escape("text").alias("escaped"))


@query(
    lambda: _PLAIN
    + f"SELECT doc_id, sent_index, '(' || {O.line_col('s')[0]} || ',' || {O.line_col('s')[1]} || ',' || {O.line_col('e')[0]} || ',' || {O.line_col('e')[1]} || ')' AS span, {O.line_col('s')[0]} AS start_line, {O.line_col('e')[1]} AS end_col FROM sent"
)
def span_format_parse(spark, d):
    s = S.segment(docs(spark, d)).select("doc_id", "sent_index", T.format_span("span").alias("span"))
    return s.withColumn("_p", T.parse_span("span")).select("doc_id", "sent_index", "span", "_p.start_line", "_p.end_col")


_LAST = f"trim(regexp_extract(regexp_replace(raw, '{O.WS}+$', ''), '([^\\s]+)$', 1), {O.q(P.QUOTES)})"


@query(lambda: _RICH + f"SELECT doc_id, sent_index, {_LAST} IN {O.in_list(P.TITLES)} AS title, {_LAST} IN {O.in_list(P.FEW_TITLES + P.OTHER_ABBREVIATIONS)} AS abbreviation FROM sent")
def title_abbrev_flag(spark, d):
    s = S.sentences(dialog_docs(spark, d))
    return s.select("doc_id", "sent_index", T.ends_with_title(F.col("raw")).alias("title"), T.ends_with_abbreviation(F.col("raw")).alias("abbreviation"))


@query(lambda: f"SELECT word, count(*) AS n FROM (SELECT unnest(string_split(replace({O.dialog_text()}, chr(10), ' '), ' ')) AS word FROM documents) WHERE word IN {O.in_list(P.TITLES)} GROUP BY word")
def abbrev_word_freq(spark, d):
    w = dialog_docs(spark, d).select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1)).alias("word"))
    return w.where(T.is_title("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[.!?](?:\\r?\\n|[ \\t]+)[A-Z]')) AS joints FROM documents")
def seam_candidates(spark, d):
    return docs(spark, d).select("doc_id", F.regexp_count("text", F.lit(r"[.!?](?:\r?\n|[ \t]+)[A-Z]")).cast("long").alias("joints"))


@query(
    "SELECT lang, CAST(sum(len(regexp_extract_all(text, '[.!?]\\r?\\n[A-Z]'))) AS BIGINT) AS line_joints, CAST(sum(len(regexp_extract_all(text, '[.!?][ \\t]+[A-Z]'))) AS BIGINT) AS space_joints, CAST(sum(len(regexp_extract_all(text, '[,:;][ \\t]+'))) AS BIGINT) AS soft FROM documents GROUP BY lang"
)
def seam_kind_counts(spark, d):
    def n(p):
        return F.sum(F.regexp_count("text", F.lit(p))).cast("long")

    return docs(spark, d).groupBy("lang").agg(n(r"[.!?]\r?\n[A-Z]").alias("line_joints"), n(r"[.!?][ \t]+[A-Z]").alias("space_joints"), n(r"[,:;][ \t]+").alias("soft"))


# Segmenters.

_SIMPLE = "SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sent_index FROM (SELECT doc_id, regexp_replace(regexp_replace(p[i], '\\s+$', ''), '^\\s+', '') AS s, i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(2) || '\\2', 'g'), chr(2)) AS p FROM documents), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)) WHERE s <> ''"


@query(f"SELECT doc_id, CAST(sent_index AS INT) AS sent_index, s AS sentence FROM ({_SIMPLE})")
def simple_split(spark, d):
    return S.simple_sentences(docs(spark, d))


@query(f"SELECT doc_id, count(*) AS n FROM ({_SIMPLE}) GROUP BY doc_id")
def simple_split_counts(spark, d):
    return S.simple_sentences(docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _dictionary_sql(text):
    # Boundaries one by one: a match, then on behind its end mark and quote; titles don't count.
    word = f"trim(regexp_extract(substr(t, 1, cut_at), '([^\\s]+)$', 1), {O.q(P.QUOTES)})"
    return f"""WITH RECURSIVE src AS MATERIALIZED (SELECT doc_id, {text} AS t FROM documents),
b AS (
  SELECT doc_id, 1 AS pos, NULL::BIGINT AS cut_at, FALSE AS fin FROM src
  UNION ALL
  SELECT doc_id, CASE WHEN m = '' THEN pos ELSE pos + strpos(rest, m) - 1 + length(m) END, CASE WHEN m <> '' THEN pos + strpos(rest, m) - 2 + length(regexp_extract(m, '^[.!?][''"”’]?')) END, m = ''
  FROM (SELECT b.doc_id, b.pos, substr(t, b.pos) AS rest, regexp_extract(substr(t, b.pos), '[.!?]\\s+[A-Z''"“‘(\\[{{]|[.!?][''"”’]\\s+[A-Z''"“‘]') AS m FROM b JOIN src USING (doc_id) WHERE NOT fin)
),
cuts AS (SELECT doc_id, cut_at FROM b JOIN src USING (doc_id) WHERE cut_at IS NOT NULL AND {word} NOT IN {O.in_list(P.FEW_TITLES)} UNION ALL SELECT doc_id, length(t) FROM src),
parts AS (SELECT doc_id, cut_at, {O.trimmed("substr(t, lag(cut_at, 1, 0) OVER w + 1, cut_at - lag(cut_at, 1, 0) OVER w)")} AS sentence FROM cuts JOIN src USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY cut_at))
"""


@query(lambda: _dictionary_sql(O.dialog_text()) + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cut_at) - 1 AS INT) AS sent_index, sentence FROM parts WHERE sentence <> ''")
def dictionary_segment(spark, d):
    return S.dictionary_sentences(dialog_docs(spark, d))


@query(lambda: _dictionary_sql("text") + "SELECT doc_id, count(*) AS n FROM parts WHERE sentence <> '' GROUP BY doc_id")
def dictionary_counts(spark, d):
    return S.dictionary_sentences(docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(lambda: _PLAIN + f"SELECT doc_id, CAST(sent_index AS INT) AS sent_index, raw, {_NORM} AS sentence FROM sent")
def narrative_segment(spark, d):
    return S.sentences(docs(spark, d))


def _span_sql():
    (a, b), (c, e) = O.line_col("s"), O.line_col("e")
    return f"SELECT doc_id, CAST(sent_index AS INT) AS sent_index, {a} AS start_line, {b} AS start_col, {c} AS end_line, {e} AS end_col FROM sent"


@query(lambda: _PLAIN + _span_sql())
def narrative_spans(spark, d):
    return S.segment(docs(spark, d)).select("doc_id", "sent_index", "span.*")


@query(lambda: _RICH + f"SELECT doc_id, CAST(sent_index AS INT) AS sent_index, raw, {_NORM} AS sentence FROM sent")
def dialog_segment(spark, d):
    return S.sentences(dialog_docs(spark, d))


@query(lambda: _RICH + _span_sql())
def dialog_spans(spark, d):
    return S.segment(dialog_docs(spark, d)).select("doc_id", "sent_index", "span.*")


_STATE = "CASE {} " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(P.STATES)) + " END"
_KIND = "CASE WHEN eff IN ('split', 'close', 'hard') THEN 'Split' ELSE 'Continue' END"


@query(
    lambda: _RICH
    + f", seam AS (SELECT *, lag(nst, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS st_was FROM step WHERE k > 0) SELECT doc_id, CAST(k - 1 AS INT) AS step, CAST(n AS INT) AS sent_index, {_STATE.format('st')} AS state_before, {_STATE.format('nst')} AS state_after, {_KIND} AS transition, m AS matched, name AS pattern FROM seam WHERE pid >= 0"
)
def dialog_transitions(spark, d):
    return S.transitions(dialog_docs(spark, d)).drop("seam")


@query(lambda: _RICH + f"SELECT {_STATE.format('st')} AS state_before, {_STATE.format('nst')} AS state_after, {_KIND} AS transition, count(*) AS n FROM step WHERE pid >= 0 GROUP BY ALL")
def transition_matrix(spark, d):
    return S.transitions(dialog_docs(spark, d)).groupBy("state_before", "state_after", "transition").agg(F.count(F.lit(1)).alias("n"))


@query(
    lambda: _RICH
    + f"SELECT doc_id, CAST(s.sent_index AS INT) AS sent_index, {O.normalize('s.raw')} AS sentence, coalesce({_STATE.format('p.st')}, 'Unknown') AS state_before, coalesce({_STATE.format('p.nst')}, 'Unknown') AS state_after, coalesce(p.m, '') AS matched, coalesce(p.name, 'Unknown') AS pattern FROM sent s LEFT JOIN (SELECT * FROM step WHERE pid >= 0) p USING (doc_id) WHERE p.n = s.sent_index UNION ALL SELECT doc_id, CAST(sent_index AS INT), {_NORM}, 'Unknown', 'Unknown', '', 'Unknown' FROM sent s WHERE NOT EXISTS (SELECT 1 FROM step p WHERE p.pid >= 0 AND p.doc_id = s.doc_id AND p.n = s.sent_index)"
)
def traced_sentences(spark, d):
    return S.traced_sentences(dialog_docs(spark, d)).select("doc_id", "sent_index", "sentence", "state_before", "state_after", "matched", "pattern")


@query()
def seam_contexts(spark, d):
    """Joints with ten bytes of context to either side; tested against bytes in Python."""
    return S.transitions(dialog_docs(spark, d)).select("doc_id", "step", "matched", "seam")


@query(lambda: O.sentences("SELECT conv_id * 1000 + turn AS doc_id, text AS t FROM conversations") + f"SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, CAST(sent_index AS INT) AS sent_index, {_NORM} AS sentence FROM sent")
def conversation_segments(spark, d):
    return S.sentences(read_table(spark, d, "conversations"), ("conv_id", "turn")).drop("raw")


@query(lambda: O.sentences("SELECT page_id AS doc_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages") + f"SELECT doc_id AS page_id, CAST(sent_index AS INT) AS sent_index, {_NORM} AS sentence FROM sent")
def page_text_segments(spark, d):
    p = read_table(spark, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return S.sentences(p, ("page_id",)).drop("raw")


@query(lambda: _RICH + f"SELECT doc_id, sent_index || chr(9) || {_NORM} || chr(9) || '(' || {O.line_col('s')[0]} || ',' || {O.line_col('s')[1]} || ',' || {O.line_col('e')[0]} || ',' || {O.line_col('e')[1]} || ')' AS line FROM sent")
def sentence_file_lines(spark, d):
    return K.sentence_lines(S.segment(dialog_docs(spark, d))).select("doc_id", "line")


@query(lambda: _PLAIN + f"SELECT doc_id, rpad(CAST(sent_index + 1 AS VARCHAR), greatest(5, length(CAST(sent_index + 1 AS VARCHAR)))::INT, ' ') || ' ' || rpad(CAST(strlen({_NORM}) AS VARCHAR), greatest(5, length(CAST(strlen({_NORM}) AS VARCHAR)))::INT, ' ') || ' ' || {_NORM} AS line FROM sent")
def fixed_width_lines(spark, d):
    return K.fixed_width_lines(S.sentences(docs(spark, d))).select("doc_id", "line")


# Statistics.

_LENGTHS = f", len AS (SELECT doc_id, length({_NORM}) AS x FROM sent)"


def _stats_sql(by, values, prefix=""):
    """Statistics of the list ``v`` by group."""
    rank = lambda p: f"CAST(v[CAST(least(floor(len(v) * {p}), len(v) - 1) AS BIGINT) + 1] AS DOUBLE)"
    return f"SELECT {by + ', ' if by else ''}CAST(len(v) AS BIGINT) AS n, v[1]::BIGINT AS min, v[-1]::BIGINT AS max, round(list_avg(v), 6) AS mean, CAST(list_median(v) AS DOUBLE) AS median, {rank(0.25)} AS p25, {rank(0.75)} AS p75, {rank(0.9)} AS p90, round(list_stddev_pop(v), 6) AS std_dev FROM ({values})"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std_dev")})


@query(lambda: _PLAIN + _LENGTHS + _stats_sql("doc_id", "SELECT doc_id, list_sort(list(x)) AS v FROM len GROUP BY doc_id"))
def doc_length_stats(spark, d):
    return _rounded(A.file_stats(S.sentences(docs(spark, d))))


@query(lambda: _PLAIN + _LENGTHS + _stats_sql("doc_id", "SELECT doc_id, list_sort(list(x)) AS v FROM len GROUP BY doc_id").replace("CAST(len(v) AS BIGINT) AS n, ", "").replace("SELECT doc_id, v[1]", "SELECT doc_id, s.* EXCLUDE (doc_id) FROM documents LEFT JOIN (SELECT doc_id, v[1]") + ") s USING (doc_id)")
def doc_length_stats_arrays(spark, d):
    """The same from each document's array, without a shuffle; a document without sentences has nulls."""
    lengths = F.transform(S.raw_sentences("text"), lambda s: F.length(T.normalize(s)))
    return _rounded(docs(spark, d).select("doc_id", lengths.alias("_l")).select("doc_id", *A.array_stats(F.col("_l"))))


@query(lambda: _PLAIN + _LENGTHS + _stats_sql("", "SELECT list_sort(flatten(list(list_transform(range(n), lambda i: m)))) AS v FROM (SELECT doc_id, CAST(floor(avg(x)) AS BIGINT) AS m, count(*) AS n FROM len GROUP BY doc_id)"))
def aggregate_length_stats(spark, d):
    return _rounded(A.aggregate_length_stats(A.file_stats(S.sentences(docs(spark, d)))))


@query(lambda: _PLAIN + _LENGTHS + _stats_sql("", "SELECT list_sort(list(x)) AS v FROM len"))
def exact_aggregate_length_stats(spark, d):
    return _rounded(A.aggregate_length_stats(None, S.sentences(docs(spark, d)).select(F.length("sentence").alias("length"))))


@query(lambda: _PLAIN + ", c AS (SELECT lang, doc_id, count(*) AS x FROM sent JOIN documents USING (doc_id) GROUP BY lang, doc_id)" + _stats_sql("lang", "SELECT lang, list_sort(list(x)) AS v FROM c GROUP BY lang"))
def sentence_count_stats(spark, d):
    s = docs(spark, d).select("lang", S.sentence_count("text").alias("length")).where("length > 0")
    return _rounded(A.length_stats(s, "lang"))


_FILES = ", f AS (SELECT d.doc_id, source, length(text) AS chars, strlen(text) AS bytes, CASE WHEN d.doc_id % 17 = 0 THEN 'skipped' WHEN contains(text, '|') THEN 'failed' ELSE 'success' END AS status, coalesce(x.n, 0) AS sentences FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id) x USING (doc_id))"


def _files(spark, d):
    status = F.when(F.col("doc_id") % 17 == 0, "skipped").when(F.contains("text", F.lit("|")), "failed").otherwise("success")
    return docs(spark, d).select("doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), status.alias("status"), S.sentence_count("text").alias("sentences"))


@query(lambda: _PLAIN + _FILES + "SELECT count(*) AS files, CAST(sum(sentences) AS BIGINT) AS sentences, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM f")
def run_totals(spark, d):
    return A.run_totals(_files(spark, d))


@query(lambda: _PLAIN + _FILES + "SELECT status, count(*) AS files, CAST(sum(sentences) AS BIGINT) AS sentences FROM f GROUP BY status")
def status_counts(spark, d):
    return _files(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("sentences").alias("sentences"))


@query(lambda: _PLAIN + _FILES + "SELECT doc_id, round(CASE WHEN sentences % 5 = 0 THEN 0 ELSE chars / (sentences % 5) END, 6) AS chars_per_sec, round(CASE WHEN sentences % 5 = 0 THEN 0 ELSE bytes / (sentences % 5) END, 6) AS bytes_per_sec FROM f")
def throughput_fields(spark, d):
    f = A.with_throughput(_files(spark, d).withColumn("seconds", F.col("sentences") % 5))
    return f.select("doc_id", F.round("chars_per_sec", 6).alias("chars_per_sec"), F.round("bytes_per_sec", 6).alias("bytes_per_sec"))


@query("SELECT count(*) FILTER (NOT contains(text, '|')) AS valid, count(*) FILTER (contains(text, '|')) AS invalid FROM documents")
def discovery_counts(spark, d):
    return K.discovery_counts(docs(spark, d).select(F.when(F.contains("text", F.lit("|")), "table").alias("error")))


@query("SELECT source AS tool, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 6) AS avg, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def throughput_by_source(spark, d):
    """Least, greatest, mean and total of the documents of every source, one row each."""
    t = A.throughput_summary(docs(spark, d).groupBy(F.col("source").alias("tool")), "n_chars", "n_chars")
    return t.select("tool", "min", "max", F.round("avg", 6).alias("avg"), "chars")


# Restart.

_PATHS = "'/books/' || source || '/' || doc_id || '-0.txt'"
_OUT = "'/books/' || source || '/' || doc_id || '-0_sentences.txt'"


def _paths(spark, d):
    return docs(spark, d).select("doc_id", F.concat(F.lit("/books/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("-0.txt")).alias("path"))


@query(f"SELECT {_PATHS} AS path, {_OUT} AS out, replace({_OUT}, '.txt', '-debug.txt') AS debug FROM documents")
def result_paths(spark, d):
    return _paths(spark, d).select("path", K.result_path("path").alias("out"), K.debug_path("path").alias("debug"))


@query(f"SELECT {_PATHS} AS path FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0)")
def pending_files(spark, d):
    p = _paths(spark, d)
    return K.pending(p.select("path"), p.where("doc_id % 3 = 0").select("path"), p.where("doc_id % 2 = 0").select(K.result_path("path").alias("out")))


@query(f"SELECT {_PATHS} AS path FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0 AND doc_id % 5 <> 0")
def prune_completed(spark, d):
    p = _paths(spark, d)
    return K.prune(p.where("doc_id % 3 = 0").select("path"), p.where("doc_id % 5 <> 0"), p.where("doc_id % 2 = 0").select(K.result_path("path").alias("out")))


# Comparison of segmentations: the dialog scanner against the simple splitter, on dialog.

_SIMPLE_RICH = _SIMPLE.replace("text,", O.dialog_text().replace("\\", "\\\\") + ",", 1)
_PAIR = f", a AS (SELECT doc_id, sent_index, {_NORM} AS sentence FROM sent), b AS (SELECT doc_id, sent_index, {O.normalize('s')} AS sentence FROM ({_SIMPLE_RICH}))"


def _pair(spark, d):
    rich = dialog_docs(spark, d)
    return S.sentences(rich).drop("raw"), S.simple_sentences(rich).withColumn("sentence", T.normalize("sentence"))


@query(lambda: _RICH + _PAIR + "SELECT doc_id, sentence FROM a EXCEPT SELECT doc_id, sentence FROM b")
def seg_only_left(spark, d):
    own, simple = (F.transform(x, T.normalize) for x in (S.raw_sentences("text"), S.simple_parts("text")))
    return C.only_left_within(dialog_docs(spark, d), "doc_id", own, simple, "sentence")


@query(lambda: _RICH + _PAIR + "SELECT doc_id, sentence FROM a INTERSECT SELECT doc_id, sentence FROM b")
def seg_both(spark, d):
    return C.in_both(*_pair(spark, d), ["doc_id", "sentence"])


@query(lambda: _RICH + _PAIR + "SELECT doc_id, sentence FROM a UNION SELECT doc_id, sentence FROM b")
def seg_union(spark, d):
    return C.in_either(*_pair(spark, d), ["doc_id", "sentence"])


@query(lambda: _RICH + _PAIR + "SELECT doc_id, a.sent_index::INT AS sent_index, a.sentence AS own, b.sentence AS other FROM a JOIN b USING (doc_id, sent_index)")
def paired_sentences(spark, d):
    a, b = _pair(spark, d)
    return C.pair_by_key(a.withColumnRenamed("sentence", "own"), b.withColumnRenamed("sentence", "other"), ["doc_id", "sent_index"])


@query(lambda: _RICH + _PAIR + "SELECT doc_id, sent_index // 3 AS region, string_agg(sentence, ' ' ORDER BY sent_index) AS text, count(*)::INT AS sentences FROM a GROUP BY ALL HAVING count(*) = 3")
def regions_of_three(spark, d):
    return C.regions_of_three(_pair(spark, d)[0])


@query(
    lambda: _RICH
    + _PAIR
    + "SELECT doc_id, a.sent_index::INT AS first, string_agg(b.sentence, ' ' ORDER BY b.sent_index) AS text, count(*)::INT AS sentences FROM a JOIN a b USING (doc_id) JOIN (SELECT doc_id, count(*) AS n FROM a GROUP BY doc_id) c USING (doc_id) WHERE b.sent_index BETWEEN a.sent_index AND a.sent_index + 2 AND a.sent_index % 2 = 0 AND a.sent_index < n - 1 GROUP BY doc_id, a.sent_index"
)
def regions_step_two(spark, d):
    return C.regions_step_two(_pair(spark, d)[0])


@query(lambda: _RICH + f"SELECT doc_id, sent_index::INT AS sent_index, coalesce(lead({O.line_col('s')[0]}) OVER w > {O.line_col('e')[0]} + 1, FALSE) AS gap FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY sent_index)")
def line_gap_chunks(spark, d):
    return C.line_gaps(S.segment(dialog_docs(spark, d))).select("doc_id", "sent_index", "gap")


@query()
def chunk_with_cap(spark, d):
    """Chunks of at most ten sentences; the cursor's state is beyond SQL, so it is tested in Python."""
    return C.chunks(S.segment(dialog_docs(spark, d)))


_ARRAYS = ", x AS (SELECT doc_id, list(sentence ORDER BY sent_index) AS v FROM a GROUP BY doc_id), y AS (SELECT doc_id, list(sentence ORDER BY sent_index) AS v FROM b GROUP BY doc_id)"


def _array_columns(spark, d):
    rich = dialog_docs(spark, d)
    clean = lambda c: F.transform(c, T.normalize)
    simple = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+(?=[A-Z])", -1), T.normalize), lambda s: s != "")
    return rich.select("doc_id", clean(S.raw_sentences("text")).alias("own"), simple.alias("a"), F.filter(F.split(T.normalize("text"), r"(?<=[.!?]) "), lambda s: s != "").alias("b"))


@query(lambda: _RICH + _PAIR + _ARRAYS + "SELECT doc_id, len(x.v) <> len(y.v) OR trim(array_to_string(x.v, ' ')) <> trim(array_to_string(y.v, ' ')) AS differs FROM x JOIN y USING (doc_id)")
def seg_differs(spark, d):
    return _array_columns(spark, d).select("doc_id", C.segmentations_differ("own", "a").alias("differs"))


_THREE = f", z AS (SELECT doc_id, list_filter(string_split(regexp_replace({O.normalize('t')}, '([.!?]) ', '\\1' || chr(2), 'g'), chr(2)), lambda s: s <> '') AS v FROM src), w AS (SELECT doc_id, len(x.v) <> len(y.v) OR trim(array_to_string(x.v, ' ')) <> trim(array_to_string(y.v, ' ')) AS oa, len(x.v) <> len(z.v) OR trim(array_to_string(x.v, ' ')) <> trim(array_to_string(z.v, ' ')) AS ob, len(y.v) <> len(z.v) OR trim(array_to_string(y.v, ' ')) <> trim(array_to_string(z.v, ' ')) AS ab, len(x.v) AS nx, len(y.v) AS ny FROM x JOIN y USING (doc_id) JOIN z USING (doc_id))"


@query(lambda: _RICH + _PAIR + _ARRAYS + _THREE + "SELECT doc_id, CASE WHEN oa AND ob AND NOT ab THEN 'own_vs_both' WHEN oa AND NOT ob THEN 'own_vs_a' WHEN ob AND NOT oa THEN 'own_vs_b' WHEN oa AND ob AND ab THEN 'all_disagree' ELSE 'no_disagreement' END AS kind FROM w")
def disagreement_3way(spark, d):
    x = _array_columns(spark, d)
    return x.select("doc_id", C.disagreement_three_way(C.segmentations_differ("own", "a"), C.segmentations_differ("own", "b"), C.segmentations_differ("a", "b")).alias("kind"))


@query(lambda: _RICH + _PAIR + _ARRAYS + _THREE + "SELECT CASE WHEN nx > ny THEN 'over_split' WHEN nx < ny THEN 'under_split' ELSE 'different_boundaries' END AS kind, count(*) AS n FROM w GROUP BY kind")
def disagreement_count_class(spark, d):
    x = _array_columns(spark, d).select(F.size("own").alias("o"), F.size("a").alias("x"))
    return x.groupBy(C.disagreement_by_count("o", "x").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(lambda: _RICH + _PAIR + _ARRAYS + _THREE + "SELECT count(*) FILTER (oa AND ob AND NOT ab) AS high_priority, count(*) FILTER (oa) AS vs_a, count(*) FILTER (ob) AS vs_b, count(*) FILTER (oa AND ob) AS vs_all FROM w")
def conditional_counts(spark, d):
    x = _array_columns(spark, d).select(C.segmentations_differ("own", "a").alias("a"), C.segmentations_differ("own", "b").alias("b"), C.segmentations_differ("a", "b").alias("c"))
    return x.agg(F.count_if(F.expr("a and b and not c")).alias("high_priority"), F.count_if("a").alias("vs_a"), F.count_if("b").alias("vs_b"), F.count_if(F.expr("a and b")).alias("vs_all"))


@query(
    lambda: _RICH
    + _PAIR
    + "SELECT doc_id, sent_index::INT AS sent_index, regexp_matches(sentence, '[a-z]') AND length(trim(sentence)) >= 20 AS keep FROM a"
)
def example_filter(spark, d):
    s = _pair(spark, d)[0]
    return s.select("doc_id", "sent_index", (F.col("sentence").rlike("[a-z]") & C.long_enough("sentence", 20)).alias("keep"))


@query()
def similarity_ratio(spark, d):
    """Gestalt similarity of each document's two segmentations, all sentences joined; tested against difflib."""
    x = _array_columns(spark, d)
    return x.select("doc_id", C.similarity_ratio(C.joined("own"), C.joined("b")).alias("ratio"))


@query(f"SELECT doc_id, n, length(trim(s)) >= n AS keep, sent_index FROM (SELECT doc_id, CAST(sent_index AS INT) AS sent_index, s FROM ({_SIMPLE})), (SELECT unnest([10, 20, 21, 50]) AS n)")
def length_filters(spark, d):
    """Which sentences pass each of the length filters in use."""
    flags = F.array(*[F.struct(F.lit(n).alias("n"), C.long_enough("sentence", n).alias("keep")) for n in (10, 20, 21, 50)])
    return S.simple_sentences(docs(spark, d)).select("doc_id", "sent_index", F.inline(flags))


@query()
def sentences_similar(spark, d):
    """Whether each document's two segmentations have as many sentences and a ratio of 0.9 or more; tested against difflib."""
    return _array_columns(spark, d).select("doc_id", C.sentences_similar("own", "b").alias("similar"))


@query("SELECT doc_id, lang, source FROM documents")
def shuffled_documents(spark, d):
    """All documents in a reproducible random order."""
    return C.shuffled(docs(spark, d).select("doc_id", "lang", "source"), "doc_id", 7)


@query(lambda: _RICH + "SELECT doc_id, CAST(sent_index AS INT) AS sent_index, raw AS region FROM sent")
def region_verbatim(spark, d):
    """Each sentence's text by its lines and columns, line breaks kept."""
    # A text's lines are split once for all of its spans.
    x = dialog_docs(spark, d).select("doc_id", F.split("text", "\n", -1).alias("lines"), S.sentence_spans("text").alias("spans"))
    return S._exploded(x.select("doc_id", F.transform("spans", lambda s: T.region_verbatim(F.col("lines"), s)).alias("_s")), ("doc_id",), "region")


@query()
def overlap_matches(spark, d):
    """Regions of one segmentation with the other's sentences near them that they hold or resemble."""
    a, b = _pair(spark, d)
    return C.overlapping(C.regions_step_two(a).select("doc_id", "first", "text"), b).select("doc_id", "first", "sent_index")


@query(
    "WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 4)) AS v FROM documents), b AS (SELECT item_id, string_split_regex(lower(text), '\\s+') AS o FROM benchmark) SELECT doc_id, item_id, round(CASE WHEN len(v) = 0 THEN 0 ELSE len(list_intersect(v, o)) / len(v) END, 6) AS overlap FROM w CROSS JOIN b"
)
def word_overlap_pairs(spark, d):
    """The word overlap of every document with every benchmark item; words are split once a text and looked up once for all items."""
    pairs = C.word_overlaps(docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))
    return pairs.withColumn("overlap", F.round("overlap", 6))


# Classification and samples.

_A = f"CASE WHEN regexp_matches(s, {O.regex(r'(?i)"[^"]*"|' + "'[^']*'" + r'|\b(?:answered|asked|exclaimed|replied|said|shouted|whispered)\b|^\s*"|--')}) THEN 'dialog' WHEN regexp_matches(s, {O.regex(r'\b(?:Ave|Dr|Mr|Mrs|Prof|Rd|St|e\.g|etc|i\.e|vs)\.|\b[A-Z]\.|\b\w+\.\w+\.')}) THEN 'abbreviation' WHEN regexp_matches(s, {O.regex(r'[;:]|\([^)]*\)|--|\b(?:furthermore|however|moreover|nevertheless|therefore)\b')}) THEN 'complex' ELSE 'normal' END"
_B = f"CASE WHEN regexp_matches(s, {O.regex('(?i)[' + chr(34) + chr(39) + ']|' + r'\b(?:asked|replied|said)\b')}) THEN 'dialog' WHEN regexp_matches(s, {O.regex(r'\b(?:Dr|Mr|Mrs|e\.g|etc|i\.e|vs)\.|[A-Z]\.')}) THEN 'abbreviation' WHEN regexp_matches(s, {O.regex('(?i)[;:()-]|however|therefore')}) THEN 'complex' ELSE 'normal' END"
_CLASSES = f", c AS (SELECT doc_id, sent_index, s, {_A} AS a, {_B} AS b FROM (SELECT doc_id, sent_index, {_NORM} AS s FROM sent))"


def _classes(spark, d):
    s = S.sentences(dialog_docs(spark, d)).drop("raw")
    return s.select("doc_id", "sent_index", "sentence", T.complexity_a("sentence").alias("a"), T.complexity_b("sentence").alias("b"))


@query(lambda: _RICH + _CLASSES + "SELECT doc_id, sent_index::INT AS sent_index, a FROM c")
def complexity_a(spark, d):
    return _classes(spark, d).select("doc_id", "sent_index", "a")


@query(lambda: _RICH + _CLASSES + "SELECT doc_id, sent_index::INT AS sent_index, b FROM c")
def complexity_b(spark, d):
    return _classes(spark, d).select("doc_id", "sent_index", "b")


@query(
    lambda: "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {O.regex(p)}) THEN {O.q(n)} END" for n, p in T.INDICATORS) + f"], lambda x: x IS NOT NULL), ',') AS indicators FROM ({_DIALOG})"
)
def complexity_indicators(spark, d):
    return dialog_docs(spark, d).select("doc_id", F.array_join(T.indicators("text"), ",").alias("indicators"))


@query(lambda: _RICH + _CLASSES + "SELECT 'a' AS dimension, a AS value, count(*) AS n FROM c GROUP BY a UNION ALL SELECT 'b', b, count(*) FROM c GROUP BY b")
def class_distribution(spark, d):
    return C.distribution(_classes(spark, d), "a", "b")


_SHARES = {"dialog": 0.3, "normal": 0.4, "abbreviation": 0.2, "complex": 0.1}


@query(
    lambda: _RICH
    + _CLASSES
    + f"SELECT doc_id, sent_index::INT AS sent_index, a FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY doc_id, sent_index) > CASE a {' '.join(f'WHEN {O.q(k)} THEN {int(500 * v)}' for k, v in _SHARES.items())} ELSE 0 END AS extra FROM c) ORDER BY extra, doc_id, sent_index LIMIT 500"
)
def stratified_sample(spark, d):
    return C.stratified_sample(_classes(spark, d).select("doc_id", "sent_index", "a"), "a", _SHARES, 500, ["doc_id", "sent_index"])


@query(lambda: _RICH + _CLASSES + "SELECT doc_id, sent_index::INT AS sent_index, b FROM c QUALIFY row_number() OVER (PARTITION BY b ORDER BY doc_id, sent_index) <= 50")
def equal_share_sample(spark, d):
    return C.equal_share_sample(_classes(spark, d).select("doc_id", "sent_index", "b"), "b", 50, ["doc_id", "sent_index"])


@query(lambda: _RICH + _CLASSES + "SELECT doc_id, sent_index::INT AS sent_index, a FROM c ORDER BY CASE a WHEN 'dialog' THEN 0 WHEN 'abbreviation' THEN 1 WHEN 'complex' THEN 2 ELSE 3 END, doc_id, sent_index LIMIT 100")
def priority_topk(spark, d):
    order = F.when(F.col("a") == "dialog", 0).when(F.col("a") == "abbreviation", 1).when(F.col("a") == "complex", 2).otherwise(3)
    return C.priority_top(_classes(spark, d).select("doc_id", "sent_index", "a"), order, 100, ["doc_id", "sent_index"])


@query(lambda: f"SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10))[2:4], lambda x: regexp_replace(x, '\\r+$', '')), ' ') AS region FROM ({_DIALOG})")
def region_lines(spark, d):
    return dialog_docs(spark, d).select("doc_id", T.lines_joined("text", 2, 4).alias("region"))


# Evaluation: benchmark items as gold sentences.


def _gold(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split("text", r"(?<=\.)\s+")).alias("text")).where("text <> ''").distinct()
    return b.select("text", F.when(F.contains("text", F.lit(",")), "complex").otherwise("normal").alias("complexity"))


_GOLD = "gold AS MATERIALIZED (SELECT *, CASE WHEN contains(text, ',') THEN 'complex' ELSE 'normal' END AS complexity, row_number() OVER (ORDER BY text) AS doc_id FROM (SELECT DISTINCT unnest(string_split(regexp_replace(text, '\\.\\s+', '.' || chr(2), 'g'), chr(2))) AS text FROM benchmark) WHERE text <> '')"


def _eval_sql():
    base = O.sentences("SELECT doc_id, 'Previous sentence. ' || text || ' Next sentence.' AS t FROM gold").replace("WITH RECURSIVE", f"WITH RECURSIVE {_GOLD},", 1)
    base += f", dia AS (SELECT doc_id, {_NORM} AS s FROM sent), sim AS (SELECT doc_id, unnest(string_split(regexp_replace('Previous sentence. ' || text || ' Next sentence.', '([.!?])\\s+([A-Z])', '\\1' || chr(2) || '\\2', 'g'), chr(2))) AS s FROM gold), every AS (SELECT 'dialog' AS algorithm, * FROM dia UNION ALL SELECT 'simple', * FROM sim)"
    base += ", hit AS (SELECT algorithm, g.doc_id, count(*) AS hits, min(s) AS s FROM every e JOIN gold g ON e.doc_id = g.doc_id AND contains(e.s, g.text) GROUP BY ALL)"
    base += ", j AS (SELECT x.algorithm, complexity, hits, coalesce(hits = 1 AND (trim(s) = text OR replace(replace(trim(s), 'Previous sentence. ', ''), ' Next sentence.', '') = text), FALSE) AS ok, coalesce(hits > 1, FALSE) AS under FROM (SELECT unnest(['dialog', 'simple']) AS algorithm) x CROSS JOIN gold g LEFT JOIN hit h ON h.algorithm = x.algorithm AND h.doc_id = g.doc_id)"
    return base + ", r AS (SELECT algorithm, complexity, count(*) AS total, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok AND NOT under) AS over_segmented, count(*) FILTER (under) AS under_segmented FROM j GROUP BY ALL)"


def _evaluated(spark, d):
    g = _gold(spark, d)
    return C.evaluate(g, S.SEGMENTERS["dialog"], "dialog").unionByName(C.evaluate(g, S.SEGMENTERS["simple"], "simple"))


@query(lambda: _eval_sql() + "SELECT algorithm, complexity, total, correct, over_segmented, under_segmented, round(correct / total, 6) AS precision, round(correct / total, 6) AS recall, round(correct / total, 6) AS f1 FROM r")
def eval_by_class(spark, d):
    return _evaluated(spark, d).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(lambda: _eval_sql() + "SELECT algorithm, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(total) AS BIGINT) AS total, round(avg(correct / total), 6) AS mean_f1 FROM r GROUP BY algorithm")
def eval_summary(spark, d):
    return C.evaluation_summary(_evaluated(spark, d)).withColumn("mean_f1", F.round("mean_f1", 6))


@query("SELECT tool, v, CAST(rank() OVER (ORDER BY v DESC) AS INT) AS place, round(v / max(v) OVER (), 6) AS relative, round(v / max(CASE WHEN tool = 'src3' THEN v END) OVER (), 6) AS speed_up FROM (SELECT source AS tool, CAST(sum(n_chars) AS DOUBLE) AS v FROM documents GROUP BY source)")
def leaderboard(spark, d):
    t = docs(spark, d).groupBy(F.col("source").alias("tool")).agg(F.sum("n_chars").cast("double").alias("v"))
    return A.leaderboard(t, "v", "src3").withColumns({c: F.round(c, 6) for c in ("relative", "speed_up")})


_TOOLS = "SELECT doc_id AS path, 'dialog' AS tool, n_chars AS v FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'simple', n_chars FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'dictionary', n_chars FROM documents WHERE doc_id % 5 <> 0"


def _tools(spark, d):
    x = docs(spark, d).select(F.col("doc_id").alias("path"), F.col("n_chars").alias("v"))
    parts = [x.where(c).withColumn("tool", F.lit(t)) for t, c in (("dialog", "path % 2 = 0"), ("simple", "path % 3 = 0"), ("dictionary", "path % 5 <> 0"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH t AS ({_TOOLS}) SELECT path, tool, v FROM t WHERE path IN (SELECT path FROM t GROUP BY path HAVING count(DISTINCT tool) = 3)")
def common_files(spark, d):
    return C.common_files(_tools(spark, d), 3).select("path", "tool", "v")


@query(f"WITH t AS ({_TOOLS}) SELECT tool, count(*) AS files, CAST(sum(v) AS BIGINT) AS total FROM t WHERE path IN (SELECT path FROM t GROUP BY path HAVING count(DISTINCT tool) = 3) GROUP BY tool")
def common_file_totals(spark, d):
    return C.common_files(_tools(spark, d), 3).groupBy("tool").agg(F.count(F.lit(1)).alias("files"), F.sum("v").alias("total"))


# Boundary rules.

_RULES = [
    ("narrative", "spaced", "End, space, capital", [".", "!", "?"], [" ", "\t"], ["A", "B"], "One{end}{sep}{start}nd two.", "NarrativeGestureBoundary", "Narrative", True, "Narrative"),
    ("narrative", "broken", "End, break, start", [".", "?"], ["\n", "\n\n"], ["H", '"', "9", "é"], "He went{end}{sep}{start}e came.", "NarrativeGestureBoundary", "Narrative", True, None),
    ("dialog", "opened", "Opener alone", [], [" "], ['"', "'", "(", "[", "{"], "He said{end}{sep}{start}so it is.", "DialogOpen", "DialogDoubleQuote", False, "Narrative"),
    ("dialog", "blank", "Nothing at all", [], [], [" ", ")"], "It{end}{sep}{start}ends.", "DialogEnd", "Narrative", False, "DialogParenthheticalRound"),
]


def _rule_sql():
    arr = lambda v: "[" + ", ".join(O.chr_literal(x) for x in v) + "]::VARCHAR[]"
    rows = ", ".join(f"({O.q(c)}, {O.q(i)}, {O.q(t)}, {arr(e)}, {arr(s)}, {arr(b)}, {O.q(x)}, {O.q(m)}, {O.q(n)}, {k}, {O.q(st) if st else 'NULL'})" for c, i, t, e, s, b, x, m, n, k, st in _RULES)
    label = lambda c, table, other: f"CASE {c} " + " ".join(f"WHEN {O.chr_literal(k)} THEN {O.q(v)}" if k else f"WHEN '' THEN {O.q(v)}" for k, v in table.items()) + f" ELSE {other} END"
    some = lambda c: f"unnest(CASE WHEN len({c}) = 0 THEN [''] ELSE {c} END)"
    return f"""WITH r(category, id, description, ends, gaps, starts, template, match, next, boundary, state) AS (VALUES {rows}),
e AS (SELECT * EXCLUDE (ends, gaps, starts), {some("ends")} AS e, gaps, starts FROM r), g AS (SELECT * EXCLUDE (gaps), {some("gaps")} AS g FROM e), s AS (SELECT * EXCLUDE (starts), unnest(starts) AS s FROM g),
c AS (SELECT *, e || g || s AS pattern, replace(replace(replace(template, '{{end}}', e), '{{sep}}', g), '{{start}}', s) AS full_text FROM s WHERE trim(e || g || s, ' ' || chr(9) || chr(10)) <> ''),
cases AS (SELECT category || '_' || id || '_' || {label("e", R._END, "'other'")} || '_' || {label("g", R._GAP, "'complex'")} || '_' || {label("s", R._START, "CASE WHEN ord(s) > 127 THEN 'unicode' ELSE 'other' END")} AS id, pattern, coalesce(state, 'Narrative') AS current_state, full_text, substr(full_text, 1, greatest(strpos(full_text, pattern), 1) - 1) AS context_before, substr(full_text, greatest(strpos(full_text, pattern), 1) + length(pattern)) AS context_after,
 match AS expected_match_type, next AS expected_next_state, boundary AS creates_sentence_boundary, FALSE AS validated, id AS source_rule, category AS source_category, description || ' | Pattern: ''' || pattern || '''' AS notes FROM c)
"""


def _rules(spark):
    rows = [(c, i, t, e, s, b, x, m, n, k, False, st, None) for c, i, t, e, s, b, x, m, n, k, st in _RULES]
    return spark.createDataFrame(rows, "category string, " + R.RULE)


@query(lambda: _rule_sql() + "SELECT * FROM cases")
def rule_expansion(spark, d):
    return R.expand(_rules(spark))


@query(lambda: _rule_sql() + "SELECT source_category, count(*) AS cases FROM cases GROUP BY source_category")
def rule_category_counts(spark, d):
    return R.category_counts(R.expand(_rules(spark)))


@query(lambda: _rule_sql() + f"SELECT id, state, pid, name FROM (SELECT id, 0 AS state, pid, CASE pid {' '.join(f'WHEN {i} THEN {O.q(n)}' for i, (*_, n) in enumerate(P.JOINTS[0]))} END AS name FROM (SELECT id, CASE {' '.join(f'WHEN regexp_full_match(pattern, {O.q(p)}) THEN {i}' for i, (p, *_) in enumerate(P.JOINTS[0]))} END::INT AS pid FROM cases))")
def rule_patterns(spark, d):
    """The narrative seam that each case's pattern is, by the first that matches it whole."""
    c = R.expand(_rules(spark))
    pid = None
    for i, (p, *_) in enumerate(P.JOINTS[0]):
        hit = F.col("pattern").rlike(rf"\A(?:{p})\z")
        pid = F.when(hit, i) if pid is None else pid.when(hit, i)
    return c.select("id", F.lit(0).alias("state"), pid.alias("pid")).withColumn("name", F.when(F.col("pid").isNotNull(), T.pattern_name(F.lit("Narrative"), F.col("pid"))))


@query(lambda: _PLAIN + "SELECT lang, CAST(sum(n) AS BIGINT) AS sentences, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id) USING (doc_id) GROUP BY lang")
def streamed_totals(spark, d):
    """Totals by language of a stream over the table, run to its end."""
    import uuid

    name = f"totals_{uuid.uuid4().hex}"
    table = docs(spark, d)
    stream = spark.readStream.schema(table.schema).parquet(f"{d}/documents.parquet*")
    books.running_totals(stream, "lang").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query(lambda: _PLAIN + ", len AS (SELECT lang, length(" + _NORM + ") AS x FROM sent JOIN documents USING (doc_id))" + _stats_sql("lang", "SELECT lang, list_sort(list(x)) AS v FROM len GROUP BY lang"))
def flagship(spark, d):
    """Sentences and length statistics by language."""
    arrays = docs(spark, d).select("lang", F.transform(S.raw_sentences("text"), lambda s: F.length(T.normalize(s))).alias("_l"))
    lengths = arrays.select("lang", F.explode_outer("_l").alias("length"))
    return _rounded(A.length_stats(lengths, "lang"))


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
