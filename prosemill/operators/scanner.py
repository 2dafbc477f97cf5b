"""The boundary scanner: one pass over a text with a state for open quotations and brackets (Python workers)."""

from __future__ import annotations

import re
from bisect import bisect_left

from prosemill.functions import patterns as P

_WS = "[" + "".join(re.escape(c) for c in P.SPACES) + "]"


def _python(p):
    return p.replace(r"\s", _WS)


_OPENERS = frozenset(P.OPENERS)
# In the narrative a seam's first and last characters tell which one it is, so one pattern serves for all 27.
_NARRATIVE = re.compile(
    rf"[.!?](?:[ \t]+[A-Z\"'“‘(\[{{]|\r?\n[A-Z]|{_WS}*(?:\r\n\r\n|\n\n){_WS}*[A-Z])|[,:;][ \t]+[\"'“‘(\[{{]|[ \t\n][\"'“‘(\[{{]|(?:\r\n\r\n|\n\n)(?:.|\n)?"
)
_DIALOG = [None] + [re.compile("|".join(f"({_python(p)})" for p, *_ in joints)) for joints in P.JOINTS[1:]]
_TITLES = frozenset(P.TITLES)


def _narrative_id(m):
    first, last = m[0], m[-1]
    if first in ".!?":
        if last in _OPENERS:
            return P.STATE_OF[last] - 1
        gap = m[1:-1]
        return 21 if gap in ("\n", "\r\n") else 22 if not gap.strip(" \t") else 23
    if first in ",:;":
        return 7 + P.STATE_OF[last] - 1
    if len(m) == 2 and last in _OPENERS:
        return 14 + P.STATE_OF[last] - 1
    if m in ("\n\n", "\r\n\r\n"):
        return 26
    return 24 if last in _OPENERS else 25


def _hard(m):
    for h in ("\r\n\r\n", "\n\n"):
        if (k := m.find(h)) >= 0:
            return k, k + len(h)
    return None


def gap_start(m):
    """Where a seam's separator begins, or None."""
    if h := _hard(m):
        return h[0]
    seen = False
    for i, c in enumerate(m):
        if c in P.BEFORE_GAP:
            seen = True
        elif seen and c in P.SPACES:
            return i
    return None


def gap_end(m):
    """Where a seam's separator ends, or None."""
    if h := _hard(m):
        return h[1]
    inside = False
    for i, c in enumerate(m):
        if c in P.SPACES:
            inside = True
        elif inside:
            return i
    return len(m) if inside else None


def break_rejected(text, at):
    """Whether a paragraph break at ``at`` goes on with the sentence before it."""
    if at == 0:
        return False
    left, i = P.LOOK_BACK, at
    while i:
        c = text[i - 1]
        left -= 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
        if left < 0:
            break
        if c not in " \t\n\r":
            return c in P.BREAK_REJECTED
        i -= 1
    return True


def ends_with_title(content):
    """Whether trimmed content's last word, without quotes around it, is a title or an initial."""
    words = _words(content[-64:])
    if len(words) == 1 and len(content) > 64:
        # The last word may begin before that.
        words = _words(content)
    return bool(words) and words[-1].strip(P.QUOTES) in _TITLES


def _words(s):
    return s.replace("\x1c", "_").replace("\x1d", "_").replace("\x1e", "_").replace("\x1f", "_").split()


def _context(text, a, b):
    n = 0
    while a and n < P.CONTEXT:
        a -= 1
        n += len(text[a].encode("utf-8", "surrogatepass"))
    n = 0
    while b < len(text) and n < P.CONTEXT:
        n += len(text[b].encode("utf-8", "surrogatepass"))
        b += 1
    return text[a:b]


def scan(text, trace=None):
    """[(start, end)] of a text's sentences in characters; transitions are appended to ``trace`` if given."""
    out, pos, start, state = [], 0, 0, 0
    search, spaces = _NARRATIVE.search, P.SPACES
    while True:
        hit = search(text, pos)
        if hit is None:
            break
        m, ms, me = hit[0], hit.start(), hit.end()
        pid = _narrative_id(m) if not state else hit.lastindex - 1
        _, effect, target, name = P.JOINTS[state][pid]
        if effect == P.HARD:
            if break_rejected(text, ms):
                effect, target = P.SOFT, state
            else:
                target = P.STATE_OF.get(m[-1], 0)
        elif target == P.BY_SECOND_LAST:
            target = P.STATE_OF.get(m[-2], 0) if len(m) > 1 else 0
        if effect in P.SPLITTING:
            if effect == P.HARD:
                end = ms
            else:
                k = gap_start(m)
                end = ms if k is None else ms + k
            k = gap_end(m)
            onward = me if k is None else ms + k
            if end > start and (content := text[start:end].strip(spaces)):
                if effect == P.SPLIT and ends_with_title(content):
                    onward = start
                else:
                    out.append((start, end))
            elif effect == P.SPLIT:
                onward = start
            start = onward
        if trace is not None:
            trace.append((len(out), P.STATES[state], P.STATES[target], "Split" if effect in P.SPLITTING else "Continue", m, name, _context(text, ms, me)))
        pos = me
        if target != state:
            state = target
            search = _DIALOG[state].search if state else _NARRATIVE.search
    if start < len(text) and text[start:].strip(spaces):
        out.append((start, len(text)))
    return out


def line_breaks(text):
    out, k = [], text.find("\n")
    while k >= 0:
        out.append(k)
        k = text.find("\n", k + 1)
    return out


def position(breaks, at):
    """(line, column), both from 1, of a character."""
    k = bisect_left(breaks, at)
    return k + 1, at - (breaks[k - 1] if k else -1)
