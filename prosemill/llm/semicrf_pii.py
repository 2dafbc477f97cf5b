"""Personal data by a semi-Markov conditional random field.

A text is cut into tokens (runs of letters and digits, single other marks) and
segmented: a segment is one token outside, or up to ``LONGEST`` tokens of one type of
entity. Features look at a whole candidate span: its shape from end to end, exact and
coarse, its length, digits and inner spaces, its ends and the tokens around it. Their
weights and those of transitions between types are trained here by conditional
likelihood (forward-backward over segments) on sentences written with known entities
and with look-alikes such as versions, dates, amounts and codes. Decoding is by dynamic
programming over segments, which chooses boundaries and types together.

An entity holds a digit or an @ and at most ``SPACES`` inner spaces. So candidates lie
within ``SPACES`` words of such a token; all else is outside, and as transitions between
outside tokens never vary, the best segmentation of the whole text is that of the
stretches around such tokens. Only those are decoded; whole texts are scanned. Chains of
more than ``CHAIN`` tokens beside an @ are one token, so addresses of any length fit.

Defined results: null, empty and digitless texts without an @ have no entity; equal
scores go to the segmentation with shorter last segment and first type by name; rows are
judged one by one, so rows that repeat an id are each reported; an empty table gives an
empty result. Texts may be of any length: of stretches full of digits scores are held for
``BLOCK`` ends at a time. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm._text import _SPACE, buffers, row_blocks

TYPES = ("out", "card", "email", "iban", "ip", "phone", "secret", "ssn")
LONGEST = 15
SPACES = 8
#: More tokens than this before or behind an @ are one; ends of segments that are scored at once.
CHAIN = 9
BLOCK = 2048
#: Training sentences, and passes over them.
SENTENCES = 800
PASSES = 4
SCHEMA = "doc_id long, kind string, start long, end long"

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_CUES = {"token", "key", "secret", "password", "api", "phone", "tel", "call", "card", "ip", "email", "mail", "iban", "ssn", "host", "version", "page", "isbn", "order", "id"}
_HEX = re.compile(r"[0-9a-fA-F]+\Z")


def shape(t: str) -> str:
    """What features see of one token."""
    if t.isascii() and t.isdigit():
        return f"d{len(t)}{'b' if len(t) <= 3 and int(t) < 256 else ''}"
    if not t[0].isalnum():
        return t
    if not any(c.isdigit() for c in t):
        low = t.lower()
        return "w" + low if low in _CUES else "l" if len(t) == 1 else "a2" if len(t) == 2 else "a"
    n = len(t)
    size = 1 if n < 8 else 2 if n < 16 else 3 if n < 24 else 4 if n < 40 else 5
    if n > 14 and t[:2].isalpha() and t[2:4].isdigit() and t.isupper():
        return f"i{size}"
    return f"{'h' if _HEX.match(t) else 'x'}{size}" if n > 4 or not t[:2].isalpha() or not t[2:].isdigit() else "c4"


def features(parts, before, after):
    """Names of a candidate span's features. parts: shapes, each with " " in front where a space precedes."""
    whole = "".join(parts)
    coarse = re.sub(r"(?<=[dhx])\d+b?", "", whole)
    digits = sum(int(p.strip()[1:].rstrip("b")) for p in parts if p.strip()[0] == "d" and len(p.strip()) > 1)
    first, last = parts[0].strip(), parts[-1].strip()
    inner = sum(p[0] == " " for p in parts[1:])
    return (
        "S" + whole, "C" + coarse, f"n{len(parts)}", f"g{inner}", f"D{min(digits, 20)}", "f" + first, "l" + last, f"fp{first}|{before}", f"lx{last}|{after}", "p" + before, "x" + after,
        f"@{'@' in whole}{inner > 0}{'.' in parts[-2:][0] if len(parts) > 1 else ''}", f"e{first[0]}{last[0]}{len(parts) > 1}", f"bx{before[:1] == ' '}{after[:1] == ' '}{coarse[:12]}",
    )


def tokens(text):
    """[(start, end, shape with a space in front where one precedes, whether it holds a digit or @)]."""
    out, end = [], 0
    for m in _TOKEN.finditer(text):
        t = m[0]
        out.append((m.start(), m.end(), (" " if m.start() > end or not m.start() else "") + shape(t), t == "@" or any(c.isdigit() for c in t)))
        end = m.end()
    return _joined(out, text) if "@" in text else out


def _joined(toks, text):
    """Tokens with long chains beside an @ (``a.b.c.d.e@``) as one, so that no address is too long for a segment."""
    out, done = [], 0
    for k, (start, end, s, _) in enumerate(toks):
        if k < done or text[start:end] != "@":
            continue
        a, b = k, k + 1
        while a > done and toks[a][2][0] != " " and (text[toks[a - 1][0]].isalnum() or text[toks[a - 1][0]] in "._+-%"):
            a -= 1
        while b < len(toks) and toks[b][2][0] != " " and (text[toks[b][0]].isalnum() or text[toks[b][0]] in ".-"):
            b += 1
        while b > k + 1 and not text[toks[b - 1][0]].isalnum():
            b -= 1
        out += toks[done:a]
        if k - a > CHAIN:
            # Only what stands before the chain is left out of it.
            while not text[toks[a][0]].isalnum() and text[toks[a][0]] != "_" and a < k - 1:
                out.append(toks[a])
                a += 1
            out.append((toks[a][0], toks[k - 1][1], toks[a][2][:-len(toks[a][2].strip())] + "a", True))
        else:
            out += toks[a:k]
        out.append(toks[k])
        if b - k - 1 > CHAIN:
            out.append((toks[k + 1][0], toks[b - 3][1], "a", True))
            out += toks[b - 2 : b]
        else:
            out += toks[k + 1 : b]
        done = b
    return out + toks[done:]


def spans(toks, low=0, high=None):
    """Candidate segments (i, j, parts, before, after) with low < j <= high: those that can be entities, and single tokens."""
    n = len(toks)
    base, high = max(0, low - LONGEST), n if high is None else high
    upto = [0] * (base + 1)
    for t in toks[base:high]:
        upto.append(upto[-1] + t[3])
    for i in range(base, high):
        before = toks[i - 1][2].strip() + ("_" if toks[i][2][0] == " " else "") if i else "^"
        gaps = 0
        for j in range(i + 1, min(high, i + LONGEST) + 1):
            if j > i + 1 and toks[j - 1][2][0] == " ":
                gaps += 1
                if gaps > SPACES:
                    break
            if j > low and (j == i + 1 or upto[j] > upto[i]):
                after = toks[j][2] if j < n else "$"
                yield i, j, [t[2] for t in toks[i:j]], before, after


class Model:
    """Weights by feature and type, transitions between types; scores of spans are kept once known."""

    def __init__(self, weights: dict[str, np.ndarray], trans: np.ndarray):
        self.weights, self.trans, self.known = weights, trans, {}

    def score(self, parts, before, after):
        key = ("".join(parts), before, after)
        if (s := self.known.get(key)) is None:
            s = np.zeros(len(TYPES))
            for f in features(parts, before, after):
                if (w := self.weights.get(f)) is not None:
                    s = s + w
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[key] = s
        return s

    def table(self, toks, low=0, high=None):
        """Scores of segments by end, from low on, and length: (ends + 1, LONGEST, types); -inf for what is no candidate."""
        high = len(toks) if high is None else high
        out = np.full((high - low + 1, LONGEST, len(TYPES)), -np.inf)
        for i, j, parts, before, after in spans(toks, low, high):
            s = self.score(parts, before, after)
            if j == i + 1:
                out[j - low, 0, 0] = s[0]
                if toks[i][3]:
                    out[j - low, 0, 1:] = s[1:]
            else:
                out[j - low, j - i - 1, 1:] = s[1:]
        return out

    def decode(self, toks):
        """The best segmentation's entities: [(first token, end token, type)]."""
        n = len(toks)
        come = np.full((n + 1, len(TYPES)), -np.inf)  # best score with a segment of each type starting here
        come[0] = self.trans[0]
        size, kind = np.zeros((n + 1, len(TYPES)), np.int8), np.zeros((n + 1, len(TYPES)), np.int8)
        for j in range(1, n + 1):
            if (at := (j - 1) % BLOCK) == 0:
                # Scores are held for so many ends at a time, however long a text is.
                table = self.table(toks) if n <= BLOCK else self.table(toks, j - 1, min(n, j - 1 + BLOCK))
            k = min(LONGEST, j)
            c = come[j - k : j][::-1] + table[at + 1, :k]
            size[j] = c.argmax(axis=0)
            best = c[size[j], np.arange(len(TYPES))]
            onward = best[:, None] + self.trans
            kind[j] = onward.argmax(axis=0)
            come[j] = onward.max(axis=0)
        out, j = [], n
        # What follows the stretch is outside.
        y = int(kind[n, 0]) if n else 0
        while j:
            i = j - 1 - int(size[j, y])
            if y:
                out.append((i, j, y))
            j, y = i, int(kind[i, y]) if i else 0
        return out[::-1]

    def find(self, text):
        """[(start, end, type)] of a text's entities, in characters."""
        toks = tokens(text)
        return [(toks[i][0], toks[j - 1][1], TYPES[y]) for i, j, y in self.decode(toks)]


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def expectations(table, trans):
    """(log partition, marginals like table, expected transitions)."""
    n, t = len(table) - 1, len(trans)
    come, done = np.full((n + 1, t), -np.inf), np.full((n + 1, t), -np.inf)
    come[0] = trans[0]
    for j in range(1, n + 1):
        k = min(LONGEST, j)
        done[j] = _logsum(come[j - k : j][::-1] + table[j, :k], 0)
        come[j] = _logsum(done[j][:, None] + trans, 0)
    z = come[n, 0]
    after, left = np.full((n + 1, t), -np.inf), np.full((n + 1, t), -np.inf)  # of what follows a segment's end, and from its start on
    after[n] = trans[:, 0]
    marginal = np.zeros_like(table)
    moves = np.zeros((t, t))
    moves[:, 0] += np.exp(done[n] + trans[:, 0] - z)
    for i in range(n - 1, -1, -1):
        k = min(LONGEST, n - i)
        ends = np.arange(i + 1, i + k + 1)
        seg = table[ends, np.arange(k)] + after[ends]
        left[i] = _logsum(seg, 0)
        marginal[ends, np.arange(k)] = np.exp(come[i] + seg - z)
        if i:
            after[i] = _logsum(trans + left[i], 1)
            moves += np.exp(done[i][:, None] + trans + left[i] - z)
        else:
            moves[0] += np.exp(trans[0] + left[0] - z)
    return z, marginal, moves


def sentence(r: random.Random):
    """A made-up text with its entities: (text, [(start, end, type)])."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["th", "er", "an", "ou", "ti", "é", "ß", "ñ", "in", "re"]) for _ in range(r.randint(1, 4)))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))

    def entity():
        kind = r.choice(TYPES[1:])
        if kind == "email":
            local = r.choice([word() + "." + d(2), word(), word() + "." + word(), word() + d(r.randint(1, 4)), word()[0] + "_" + word(), word() + "-" + word(), word() + "+" + word()])
            host = r.choice(["mail" + d(1), word().replace("é", "e").replace("ß", "s").replace("ñ", "n"), "mx-" + d(2)])
            return kind, "", local + "@" + host + r.choice([".example.com", ".com", ".co.uk", ".org", ".net"]), ""
        if kind == "phone":
            return kind, r.choice(["", "", "tel ", "phone: "]), r.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(r.randint(10, 12))}", f"+{d(2)} ({d(1)}) {d(2)} {d(3)} {d(2)} {d(2)}", f"{d(3)} {d(3)} {d(4)}"]), ""
        if kind == "ip":
            return kind, r.choice(["", "", "ip ", "host "]), ".".join(str(r.randint(0, r.choice([9, 99, 255, 255]))) for _ in range(4)), r.choice(["", "", ":" + d(4)])
        if kind == "card":
            a, b, c, e = d(4), d(4), d(4), d(4)
            return kind, r.choice(["", "", "card "]), r.choice([a + b + c + e, a + b + c + e, f"{a} {b} {c} {e}", f"{a}-{b}-{c}-{e}", f"{a} {d(6)} {d(5)}", d(15)]), ""
        if kind == "ssn":
            return kind, r.choice(["", "ssn "]), f"{d(3)}-{d(2)}-{d(4)}", ""
        if kind == "iban":
            c = r.choice(["DE", "FR", "ES", "GB", "NL"]) + d(2)
            return kind, r.choice(["", "iban "]), r.choice([c + d(18), " ".join([c, d(4), d(4), d(4), d(4), d(2)]), c + r.choice(["ABNA", "BARC"]) + d(14)]), ""
        n = r.choice([16, 18, 20, 24, 32, 32, 40, 40, 40, 64])
        v = hexa(n) if r.random() < 0.7 else "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH0123456789") for _ in range(n - 2)) + d(2)
        head, tail = r.choice([('token = "', '"'), ('token = "', '"'), ("key=", ""), ("password=", ""), ("secret: ", ""), ("api_key = '", "'"), ('password: "', '"'), ("", "")])
        return kind, head, v, tail

    def alike():
        return r.choice([f"version {d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}", f"Version {d(1)}.{d(1)}.", d(1), d(2), d(3), d(4), str(r.randint(1800, 2099)), f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/20{d(2)}", f"{d(2)}:{d(2)}", f"{d(1)},{d(3)}", f"{d(2)},{d(3)},{d(3)}", f"${d(2)}.{d(2)}", f"{d(2)}%", f"{d(1)}.{d(3)}", word()[0] + d(2), word() + d(1), d(5), d(6), d(7), d(8), f"order {d(9)}", f"page {d(3)}", f"@{word()}", f"{d(3)}-{d(3)}", f"{d(4)}-{d(4)}", f"({d(1)})", f"[{d(2)}]", hexa(6), hexa(7) + "1", f"isbn {d(13)}", f"{d(2)} x {d(2)}", f"{d(1)}th", f"{d(3)} {d(3)}", f"{d(2)} {d(2)} {d(2)}", f"{d(3)},{d(3)},{d(3)}"])

    text, marks = "", []
    noise, upper = r.choice(["", "", "", "", "!!", "###", " |"]), r.random() < 0.12
    for _ in range(r.randint(1, 4)):
        for _ in range(r.randint(0, 4)):
            text += word() + noise + r.choice([" ", " ", " ", ", ", ". ", "\n"])
        c = r.random()
        if c < 0.6:
            kind, head, value, tail = entity()
            if upper:
                head, value = head.upper(), value.upper()
            if noise == "!!" and " " not in value:
                head = head.replace(" ", "!! ")
            text += head
            marks.append((len(text), len(text) + len(value), kind))
            text += value + tail + noise + r.choice([" ", ".", ",", ", ", "\n", " ", ""]) + " "
        elif c < 0.95:
            text += alike() + noise + r.choice([" ", ", ", ". ", ") "])
    for _ in range(r.randint(0, 3)):
        text += word() + noise + " "
    return text, marks


@functools.lru_cache(maxsize=4)
def train(count: int = SENTENCES, passes: int = PASSES, seed: int = 11) -> Model:
    """Weights of greatest conditional likelihood, nearly: AdaGrad over made-up sentences, with a small decay."""
    r = random.Random(seed)
    names: dict[str, int] = {}
    cases = []
    for _ in range(count):
        text, marks = sentence(r)
        toks = tokens(text)
        if not toks:
            continue
        start, stop = {t[0]: i for i, t in enumerate(toks)}, {t[1]: i + 1 for i, t in enumerate(toks)}
        gold = {(start[a], stop[b]): TYPES.index(k) for a, b, k in marks if a in start and b in stop}
        where, feats = [], []
        for i, j, parts, before, after in spans(toks):
            where.append((j, j - i - 1))
            feats.append([names.setdefault(f, len(names)) for f in features(parts, before, after)])
        where = np.array(where)
        right = np.zeros((len(toks) + 1, LONGEST, len(TYPES)))
        path, i = [], 0
        by_start = {a: (b, y) for (a, b), y in gold.items()}
        while i < len(toks):
            b, y = by_start.get(i, (i + 1, 0))
            right[b, b - i - 1, y] = 1
            path.append(y)
            i = b
        moves = np.zeros((len(TYPES), len(TYPES)))
        for a, b in zip([0, *path], [*path, 0]):
            moves[a, b] += 1
        allowed = np.full(right.shape, -np.inf)
        allowed[where[:, 0], where[:, 1], 1:] = 0
        allowed[1:, 0, 0] = 0
        for k, t in enumerate(toks):
            if not t[3]:
                allowed[k + 1, 0, 1:] = -np.inf
        cases.append((where, np.array(feats), right, moves, allowed))
    w, trans = np.zeros((len(names), len(TYPES))), np.zeros((len(TYPES), len(TYPES)))
    gw, gt = np.full(w.shape, 1e-2), np.full(trans.shape, 1e-2)
    for _ in range(passes):
        r.shuffle(cases)
        for where, feats, right, moves, allowed in cases:
            table = allowed.copy()
            table[where[:, 0], where[:, 1]] += w[feats].sum(axis=1)
            _, marginal, expected = expectations(table, trans)
            g = (right - marginal)[where[:, 0], where[:, 1]]
            rows = np.flatnonzero(np.abs(g).max(axis=1) > 1e-4)
            if len(rows):
                own, inverse = np.unique(feats[rows], return_inverse=True)
                step = np.zeros((len(own), len(TYPES)))
                np.add.at(step, inverse.reshape(-1), np.repeat(g[rows], feats.shape[1], axis=0))
                step -= 1e-3 * w[own]
                gw[own] += step * step
                w[own] += 0.3 * step / np.sqrt(gw[own])
            step = moves - expected
            gt += step * step
            trans += 0.3 * step / np.sqrt(gt)
    return Model({f: w[i] for f, i in names.items()}, trans)


_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), 64]] = True


def stretches(data, off):
    """(row, start, end) of the bytes around digits and @: SPACES + 2 words to either side; stretches that meet are one."""
    n = len(data)
    marks = np.flatnonzero(_MARK[data])
    if not len(marks):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    begin[off[:-1][off[:-1] < n]] = word[off[:-1][off[:-1] < n]]
    starts = np.flatnonzero(begin)
    row = np.searchsorted(off, marks, side="right") - 1
    w = np.unique(np.searchsorted(starts, marks, side="right") - 1)
    row = np.searchsorted(off, starts[w], side="right") - 1
    low, high = w - SPACES - 2, w + SPACES + 3
    lead, end = np.searchsorted(starts, off[row]), np.searchsorted(starts, off[row + 1])
    low, high = np.maximum(low, lead), np.minimum(high, end)
    new = np.append(True, (row[1:] != row[:-1]) | (low[1:] > high[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(w)) - 1
    stop = np.where(high[last] < end[last], np.append(starts, n)[high[last]], off[row[last] + 1])
    return row[first], starts[low[first]], stop


def tagger(weights, trans):
    def tag(batches):
        model = Model(weights, trans)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = buffers(batch.column(1))
            for i, j in row_blocks(off):
                block, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                row, start, stop = stretches(block, at)
                if not len(row):
                    continue
                heads = np.concatenate(([0], np.cumsum((block & 0xC0) != 0x80)))
                base = (heads[start] - heads[at[row]]).tolist()
                raw = block.tobytes()
                out = []
                for r, a, b, c in zip(row.tolist(), start.tolist(), stop.tolist(), base):
                    for x, y, k in model.find(raw[a:b].decode("utf-8", "replace")):
                        out.append((r, k, c + x, c + y))
                if out:
                    r, k, x, y = zip(*out)
                    yield pa.record_batch([pa.array(ids[i:j][list(r)]), pa.array(k), pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["doc_id", "kind", "start", "end"])

    return tag


def entities(docs: DataFrame, id_col="doc_id", text_col="text", model: Model | None = None) -> DataFrame:
    """(doc_id, kind, start, end) of every entity: characters of the text from 0, the end excluded."""
    m = model or train()
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null and t is not null")
    return src.mapInArrow(tagger(m.weights, m.trans), SCHEMA)


def op1_semicrf_pii(spark, sf_dir):
    return entities(spark.read.parquet(f"{sf_dir}/documents.parquet"))
