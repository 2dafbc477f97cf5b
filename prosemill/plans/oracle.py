"""DuckDB SQL that states the segmenters' results: the state machine as a recursive query, built from the same tables."""

from __future__ import annotations

from prosemill.functions import patterns as P


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


#: White space as Spark's (?U)\s has it.
WS = r"[\s\x{0b}\x{85}\p{Z}]"


def regex(p):
    """A pattern of Unicode words in RE2's syntax, whose own \\b, \\w and \\s are ASCII's."""
    edge, word = r"[^\pL\pN\pM_]", r"[\pL\pN\pM_]"
    p = p.replace(r")\b", rf")(?:{edge}|$)").replace(r"\b", rf"(?:^|{edge})").replace(r"\w", word).replace(r"\s", WS)
    return q(p)


def normalize(c):
    return f"trim(regexp_replace({c}, {q(WS + '+')}, ' ', 'g'))"


def trimmed(c):
    return f"regexp_replace(regexp_replace({c}, {q(WS + '+$')}, ''), {q('^' + WS + '+')}, '')"


def in_list(values):
    return "(" + ", ".join(map(q, values)) + ")"


#: Dialog made from plain prose, by doc_id, so that every state is entered: the catalog builds the same in Spark.
DIALOG_RULES = [
    [(", ", ', "'), (".\n", '." ')],
    [(", ", " ("), (". ", "). ")],
    [("\n", "\n\n")],
    [(", ", ", “"), (". ", ".” ")],
    [(". ", ". Mr. ")],
    [(", ", ", '"), (". ", ".' ")],
    [(", ", " ["), (". ", ".] ")],
    [(", ", " {"), (". ", ".} "), ("\n", "\n\n")],
    [(", ", ", ‘"), (". ", ".’ ")],
    [("\n", "\r\n\r\n"), (", ", ', "'), (". ", '" ')],
    [(", ", ',\n\n"'), (". ", '!" "')],
    [(". ", '." “'), (", ", "”, "), ("\n", "\n\n(")],
]


def dialog_text(text="text", key="doc_id"):
    out = []
    for k, rules in enumerate(DIALOG_RULES):
        e = text
        for a, b in rules:
            e = f"replace({e}, {chr_literal(a)}, {chr_literal(b)})"
        out.append(f"WHEN {k} THEN {e}")
    return f"CASE {key} % {len(DIALOG_RULES)} " + " ".join(out) + " END"


def chr_literal(s):
    """A literal in which line ends are spelt out."""
    return " || ".join("chr(10)" if c == "\n" else "chr(13)" if c == "\r" else q(c) for c in _pieces(s))


def _pieces(s):
    out, now = [], ""
    for c in s:
        if c in "\n\r":
            out += [now] * bool(now) + [c]
            now = ""
        else:
            now += c
    return out + [now] * bool(now)


def _by_state(f):
    return "CASE st " + " ".join(f"WHEN {k} THEN {f(k)}" for k in range(len(P.STATES))) + " END"


def _opener_state(c):
    return f"CASE {c} " + " ".join(f"WHEN {q(o)} THEN {k}" for o, k in P.STATE_OF.items()) + " ELSE 0 END"


def machine(source: str, text="t", key="doc_id") -> str:
    """CTEs ``src`` and ``step``: one row a seam, then one for the end (pid -1).

    Columns: key, k, st, pid, eff, nst, m, ms (start, from 1), me, es and ee (emitted sentence, from 1, end
    excluded; null: none), n (sentences so far), name.
    """
    alt = [f"(?:{'|'.join(p for p, *_ in joints)})" for joints in P.JOINTS]
    full = lambda k: "CASE " + " ".join(f"WHEN regexp_full_match(m, {q(p)}) THEN {i}" for i, (p, *_) in enumerate(P.JOINTS[k])) + " END"
    effect = lambda k: "CASE pid " + " ".join(f"WHEN {i} THEN {q(e)}" for i, (_, e, *_) in enumerate(P.JOINTS[k])) + " END"
    target = lambda k: "CASE pid " + " ".join(f"WHEN {i} THEN {t}" for i, (_, _, t, _) in enumerate(P.JOINTS[k])) + " END"
    name = lambda k: "CASE pid " + " ".join(f"WHEN {i} THEN {q(n)}" for i, (*_, n) in enumerate(P.JOINTS[k])) + " END"
    seen = r"[.!?\"')\]}>]"
    unseen = r"[^.!?\"')\]}>]"
    hard = "CASE WHEN contains(m, chr(13) || chr(10) || chr(13) || chr(10)) THEN strpos(m, chr(13) || chr(10) || chr(13) || chr(10)) - 1 WHEN contains(m, chr(10) || chr(10)) THEN strpos(m, chr(10) || chr(10)) - 1 END"
    hard_len = "CASE WHEN contains(m, chr(13) || chr(10) || chr(13) || chr(10)) THEN 4 ELSE 2 END"
    return rf"""
src AS MATERIALIZED (SELECT {key}, {text} AS t FROM ({source}) WHERE {text} IS NOT NULL),
step AS (
  SELECT {key}, 0 AS k, 1 AS pos, 1 AS s, 0 AS st, NULL::INT AS pid, NULL::VARCHAR AS eff, 0 AS nst, NULL::VARCHAR AS m, NULL::BIGINT AS ms, NULL::BIGINT AS me,
         NULL::BIGINT AS es, NULL::BIGINT AS ee, 0 AS n, NULL::VARCHAR AS name, FALSE AS fin FROM src
  UNION ALL
  SELECT {key}, k + 1, CASE WHEN pid < 0 THEN pos ELSE me END, s2, st0, pid, eff2, nst2, m, ms, me, CASE WHEN emit THEN s END, CASE WHEN emit THEN e END, n + emit::INT, name, pid < 0 FROM (
    SELECT *, CASE WHEN pid < 0 THEN s WHEN eff2 = 'split' THEN CASE WHEN emit THEN onward ELSE s END WHEN eff2 IN ('close', 'hard') THEN onward ELSE s END AS s2 FROM (
      SELECT *, filled AND (eff2 IN ('close', 'hard', 'end') OR (eff2 = 'split' AND NOT trim(regexp_extract(regexp_replace(body, '{WS}+$', ''), '([^\s]+)$', 1), {q(P.QUOTES)}) IN {in_list(P.TITLES)})) AS emit FROM (
        SELECT *, e > s AND {trimmed("substr(t, s, e - s)")} <> '' AS filled, substr(t, s, e - s) AS body FROM (
          SELECT *, CASE WHEN pid < 0 THEN length(t) + 1 WHEN eff2 = 'hard' THEN ms ELSE ms + coalesce(gs, 0) END AS e, CASE WHEN pid < 0 THEN s ELSE coalesce(ms + ge, me) END AS onward FROM (
            SELECT *,
              CASE WHEN pid < 0 THEN 'end' WHEN eff = 'hard' AND rejected THEN 'soft' ELSE eff END AS eff2,
              CASE WHEN pid < 0 THEN st0 WHEN eff = 'hard' THEN CASE WHEN rejected THEN st0 ELSE {_opener_state("right(m, 1)")} END WHEN tgt = {P.BY_SECOND_LAST} THEN {_opener_state("substr(m, length(m) - 1, 1)")} ELSE tgt END AS nst2,
              coalesce(hs, CASE WHEN regexp_matches(m, '^{unseen.replace("'", "''")}*{seen.replace("'", "''")}[^\s]*\s') THEN length(regexp_extract(m, '^({unseen.replace("'", "''")}*{seen.replace("'", "''")}[^\s]*)\s', 1)) END) AS gs,
              coalesce(hs + hl, CASE WHEN regexp_matches(m, '\s') THEN length(regexp_extract(m, '^([^\s]*\s+)', 1)) END) AS ge
            FROM (
              SELECT *, {hard} AS hs, {hard_len} AS hl,
                {_by_state(effect).replace("CASE st", "CASE st0")} AS eff, {_by_state(target).replace("CASE st", "CASE st0")} AS tgt, {_by_state(name).replace("CASE st", "CASE st0")} AS name,
                CASE WHEN ms = 1 THEN FALSE ELSE coalesce(nullif(regexp_extract(substr(t, greatest(1, ms - {P.LOOK_BACK}), least(ms - 1, {P.LOOK_BACK})), '([^ \t\n\r])[ \t\n\r]*$', 1), '') IN {in_list(P.BREAK_REJECTED)}, TRUE) END AS rejected
              FROM (
                SELECT *, CASE WHEN m = '' THEN -1 ELSE {_by_state(full).replace("CASE st", "CASE st0")} END AS pid, pos + strpos(rest, m) - 1 AS ms, pos + strpos(rest, m) - 1 + length(m) AS me FROM (
                  SELECT {key}, t, k, pos, s, n, st AS st0, rest, {_by_state(lambda k: f"regexp_extract(rest, {q(alt[k])})")} AS m FROM (
                    SELECT r.{key}, src.t, r.k, r.pos, r.s, r.n, r.nst AS st, substr(src.t, r.pos) AS rest FROM step r JOIN src USING ({key}) WHERE NOT r.fin)))))))))
)"""


def sentences(source, text="t", key="doc_id"):
    """WITH clause up to ``sent``: (key, sent_index, raw, s, e)."""
    return f"WITH RECURSIVE {machine(source, text, key)},\nsent AS (SELECT step.{key}, n - 1 AS sent_index, substr(t, es, ee - es) AS raw, es AS s, ee AS e, t FROM step JOIN src USING ({key}) WHERE es IS NOT NULL)\n"


def line_col(at):
    before = f"substr(t, 1, {at} - 1)"
    return f"CAST(length({before}) - length(replace({before}, chr(10), '')) + 1 AS INT)", f"CAST(length({before}) - coalesce(length({before}) - length(regexp_extract({before}, '[^\\n]*$')), 0) + 1 AS INT)"
