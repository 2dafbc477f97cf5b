"""SentencePiece encoding into the N best segmentations, and decoding.

A text is escaped as SentencePiece does it (a space in front, spaces as U+2581); its
lattice has an edge for every substring that is a piece, weighted with the model's
score, and one for a character that is no piece, which the model spells as bytes.
Forward Viterbi gives the best score F of every node. As a heuristic of what lies
before a node it is exact, so backward A* from the end pops paths in order of score,
and an edge s -> e adds F(e) - F(s) - w(s, e) to what a path falls short of the best.

No piece goes across the front of a run of U+2581 or a character that stands in
one-character pieces only, so the lattice is a chain of word lattices. Equal words
have equal lattices: Viterbi runs over each distinct word of a block of texts once,
all words at a time, and so does, where a word is among the N - 1 of a text with the
cheapest deviation, its A*. Paths of the text that leave the best one elsewhere can't
be among its N best, so a last A* over those words' alternatives is exact too.

Defined results: a null text gives nulls, an empty one no pieces and one segmentation
of score 0; a text with fewer than N segmentations has those it has. Ties are broken
by the order of deviations, first position and shorter piece first. A text's own
U+2581 is spelt as bytes, so decoding returns every text exactly. Texts may be of any
length, with or without spaces; a long word takes time and memory in proportion. Rows are
encoded one by one: repeated rows agree, an empty table gives an empty one, other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm._text import buffers, mix, row_blocks

#: The public model's file; wherever else it lies, callers name the place.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N = 4

_SPACE = 0x2581
#: Stands for a text's own U+2581, which is no word's front.
_OWN = 0x110001
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_BYTE0 = 3
#: Fewer words than this are solved with all sizes in a step.
_FEW = 64
SCHEMA = "doc_id long, n_tokens int, score double, ids array<int>, nbest array<struct<rank: int, score: double, changes: array<struct<at: int, drop: int, add: array<int>>>>>, decodes boolean"


def _powers(b, n):
    a = np.full(n + 1, b, np.uint64)
    a[0] = 1
    return np.cumprod(a, dtype=np.uint64)


class Pieces:
    """A model's pieces as lookup tables, and the search over them."""

    def __init__(self, content: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = p.get_piece_size()
        self.size, self.unk = n, n
        texts = [p.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        if not all(p.is_byte(i) for i in range(_BYTE0, _BYTE0 + 256)):
            raise ValueError("the model has no byte pieces at ids 3 to 258")
        if any("▁" in texts[i].lstrip("▁") for i in plain):
            raise ValueError("a piece goes on after a space; words can't be told apart by spaces")
        scores = [p.get_score(i) for i in range(n)]
        #: By id; then that of an unknown character, and of no piece at all.
        self.score = np.array([*scores, min(scores[i] for i in plain) - 10, -np.inf])
        self.longest = max(len(texts[i]) for i in plain)
        self.joins = np.zeros(0x110002, bool)
        for i in plain:
            if len(texts[i]) > 1:
                self.joins[[ord(c) for c in texts[i]]] = True
        keys = np.zeros(n + 2, np.uint64)
        for i in plain:
            c = np.array([ord(x) for x in texts[i]], np.uint32)
            keys[i] = self._key((mix(c.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(c))[: len(c)]).sum(dtype=np.uint64, keepdims=True), len(c))[0]
        self.keys = keys
        self.first, self.second = np.full(1 << 20, n + 1, np.int32), np.full(1 << 20, n + 1, np.int32)
        for i in plain:
            at = int(keys[i] >> np.uint64(44))
            if self.first[at] == n + 1:
                self.first[at] = i
            elif self.second[at := int(keys[i]) & 0xFFFFF] == n + 1:
                self.second[at] = i
            else:
                raise ValueError("three pieces share a slot")
        kept = set(plain)
        out = [bytes([i - _BYTE0]) if p.is_byte(i) else texts[i].replace("\u2581", " ").encode() if i in kept else b"" for i in range(n)]
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.byte_off = np.concatenate(([0], np.cumsum([len(x) for x in out])))

    @staticmethod
    def _key(h, n):
        return mix(h ^ np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))

    def lookup(self, h, n):
        """Ids of substrings with polynomial hashes ``h`` and ``n`` characters; size + 1 where there is none."""
        k = self._key(h, n)
        a = self.first[(k >> np.uint64(44)).astype(np.int64)]
        miss = self.keys[a] != k
        if miss.any():
            b = self.second[(k[miss] & np.uint64(0xFFFFF)).astype(np.int64)]
            b[self.keys[b] != k[miss]] = self.size + 1
            a[miss] = b
        return a

    def viterbi(self, w, length):
        """For words (rows of characters, padded): F, best last piece's length and second-best shortfall by node, ids by length and start."""
        n, m = w.shape
        power, inverse = _powers(_BASE, m), _powers(_INVERSE, m)
        sums = np.zeros((m + 1, n), np.uint64)
        np.cumsum(mix(w.T.astype(np.uint64) + np.uint64(1)) * power[:m, None], axis=0, out=sums[1:])
        f = np.full((m + 1, n), -np.inf)
        f[0] = 0
        best = np.zeros((m + 1, n), np.int8 if self.longest < 128 else np.int32)
        short = np.full((m + 1, n), np.inf)
        ids = np.full((min(self.longest, m), m, n), self.size + 1, np.int32)
        order = np.argsort(-length, kind="stable")
        if (order != np.arange(n)).any():
            raise ValueError("words must come longest first")
        live = np.searchsorted(-length, -np.arange(1, m + 1), side="right")
        if n < _FEW:
            # Of few words, which may be long, all pieces are looked up at once, and a step weighs all sizes.
            weights = np.full(ids.shape, -np.inf)
            for size in range(1, len(ids) + 1):
                i = self.lookup((sums[size:] - sums[: m + 1 - size]) * inverse[: m + 1 - size, None], size)
                if size == 1:
                    i = np.where(i > self.unk, self.unk, i)
                ids[size - 1, : m + 1 - size] = i
                weights[size - 1, : m + 1 - size] = self.score[i]
            for e in range(1, m + 1):
                k, top = live[e - 1], min(len(ids), e)
                sizes = np.arange(top)
                c = f[e - 1 - sizes, :k] + weights[sizes, e - 1 - sizes, :k]
                by = c.argmax(axis=0)
                f[e, :k], best[e, :k] = c[by, np.arange(k)], by + 1
                if top > 1:
                    c[by, np.arange(k)] = -np.inf
                    short[e, :k] = f[e, :k] - c.max(axis=0)
            return f, best, short, ids
        for e in range(1, m + 1):
            k = live[e - 1]
            top, second = np.full(k, -np.inf), np.full(k, -np.inf)
            by = np.zeros(k, best.dtype)
            for size in range(1, min(self.longest, e) + 1):
                s = e - size
                i = self.lookup((sums[e, :k] - sums[s, :k]) * inverse[s], size)
                if size == 1:
                    i = np.where(i > self.unk, self.unk, i)
                ids[size - 1, s, :k] = i
                c = f[s, :k] + self.score[i]
                more = c > top
                second = np.where(more, top, np.maximum(second, c))
                by[more] = size
                top = np.where(more, c, top)
            f[e, :k], best[e, :k], short[e, :k] = top, by, top - second
        return f, best, short, ids

    def spell(self, cp):
        """The byte pieces of an unknown character."""
        return [b + _BYTE0 for b in chr(_SPACE if cp == _OWN else cp).encode("utf-8", "surrogatepass")]

    def search(self, f, best, ids, n, want=N):
        """The ``want`` best paths of one word: [(shortfall, [(start, id), ...])], by backward A*.

        As every waiting deviation is a path of its own, of known shortfall, only the best
        ones of each path can be wanted.
        """
        heap, out, tick = [(0.0, 0, n, ())], [], 1
        sizes = np.arange(1, min(len(ids), n) + 1)
        while heap and len(out) < want:
            lost, _, e, tail = heapq.heappop(heap)
            nodes, tails = [], []
            while e:
                nodes.append(e)
                tails.append(tail)
                s = e - int(best[e])
                e, tail = s, ((s, int(ids[int(best[e]) - 1, s])), tail)
            if nodes:
                at = np.array(nodes)
                start = at[:, None] - sizes
                i = np.where(start >= 0, ids[sizes - 1, np.maximum(start, 0)], self.unk + 1)
                with np.errstate(invalid="ignore"):
                    more = np.where((i <= self.unk) & (sizes != best[at][:, None]), f[at][:, None] - f[np.maximum(start, 0)] - self.score[i], np.inf).ravel()
                more[np.isnan(more)] = np.inf
                left = want - len(out) - 1
                some = np.flatnonzero(more <= np.partition(more, left - 1)[left - 1]) if 0 < left < len(more) else np.arange(len(more) if left else 0)
                for k in some[np.argsort(more[some], kind="stable")][:left].tolist():
                    if more[k] < np.inf:
                        n_, size = divmod(k, len(sizes))
                        s = nodes[n_] - size - 1
                        heapq.heappush(heap, (lost + max(float(more[k]), 0.0), tick, s, ((s, int(i[n_, size])), tails[n_])))
                        tick += 1
            path = []
            while tail:
                path.append(tail[0])
                tail = tail[1]
            out.append((lost, path))
        return out


def flatten(start, count):
    """Indices start[i], start[i] + 1, ... (count[i] of them), one run after the other."""
    total = int(count.sum())
    return np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total)


class Block:
    """The distinct words of some texts, their lattices and best segmentations."""

    def __init__(self, p: Pieces, data, off):
        self.p = p
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        at = heads[off]
        chars[chars == _SPACE] = _OWN
        chars[chars == 32] = _SPACE
        rows = np.flatnonzero(np.diff(at) > 0)
        chars = np.insert(chars, at[rows], _SPACE)
        added = np.concatenate(([0], np.cumsum(np.diff(at) > 0)))
        self.at = at + added
        total = len(chars)
        cut = np.zeros(total + 1, bool)
        cut[self.at] = True
        alone = ~p.joins[chars]
        cut[:-1] |= alone
        cut[1:] |= alone
        space = chars == _SPACE
        cut[1:-1] |= space[1:] & ~space[:-1]
        cut[total] = True
        edge = np.flatnonzero(cut)
        self.start, self.length = edge[:-1], np.diff(edge)
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, total)[:total], out=sums[1:])
        h = (sums[edge[1:]] - sums[edge[:-1]]) * _powers(_INVERSE, total)[edge[:-1]]
        h = mix(h ^ (self.length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, where, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.first_word = np.searchsorted(self.start, self.at)
        self.chars = chars
        self._solve(where)

    def _solve(self, where):
        p, n = self.p, len(where)
        length = self.length[where]
        self.regret = np.full(n, np.inf)
        self.total = np.zeros(n)
        self.lattice, self.group = [], np.zeros((n, 2), np.int64)
        pieces = []  # (word, step from the end, id, character)
        size = np.ceil(np.log2(np.maximum(length, 4))).astype(int)
        for c in np.unique(size):
            own = np.flatnonzero(size == c)
            own = own[np.argsort(-length[own], kind="stable")]
            # Tables of one solution take about 100 bytes a character and piece length.
            step = max(1, (1 << 22) // (int(length[own[0]]) * 16))
            for s in range(0, len(own), step):
                w = own[s : s + step]
                k, m = length[w], int(length[w[0]])
                col = np.arange(m)
                chars = self.chars[np.minimum(self.start[where[w]][:, None] + col, len(self.chars) - 1)]
                f, best, short, ids = p.viterbi(chars, k)
                self.group[w, 0], self.group[w, 1] = len(self.lattice), np.arange(len(w))
                self.lattice.append((f, best, ids, chars))
                i = np.arange(len(w))
                self.total[w] = f[k, i]
                e, step_no = k.copy(), 0
                live = i
                while len(live):
                    size_ = best[e[live], live].astype(np.int64)
                    self.regret[w[live]] = np.minimum(self.regret[w[live]], short[e[live], live])
                    b = e[live] - size_
                    pieces.append((w[live], np.full(len(live), step_no), ids[size_ - 1, b, live], chars[live, b]))
                    e[live] = b
                    live = live[b > 0]
                    step_no += 1
        if not pieces:
            self.ids, self.count, self.at_piece = np.zeros(0, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
            return
        word, back, ids, ch = (np.concatenate(x) for x in zip(*pieces))
        order = np.lexsort((-back, word))
        word, ids, ch = word[order], ids[order], ch[order]
        odd = np.flatnonzero(ids == p.unk)
        if len(odd):
            spelt = {c: p.spell(c) for c in np.unique(ch[odd]).tolist()}
            lists = [spelt[c] for c in ch[odd].tolist()]
            grow = np.ones(len(ids), np.int64)
            grow[odd] = [len(x) for x in lists]
            at = np.concatenate(([0], np.cumsum(grow)))
            wide = np.repeat(ids, grow)
            wide[flatten(at[odd], grow[odd])] = np.concatenate(lists)
            word, ids = np.repeat(word, grow), wide
        self.ids = ids.astype(np.int32)
        self.count = np.bincount(word, minlength=n)
        self.at_piece = np.concatenate(([0], np.cumsum(self.count)))[:-1]
        self._known = {}

    def choices(self, word, want):
        """[(shortfall, ids)] of a distinct word, best first."""
        if (have := self._known.get(word)) is None:
            g, i = self.group[word]
            f, best, ids, chars = self.lattice[g]
            n = int(np.flatnonzero(f[:, i] > -np.inf)[-1])
            have = []
            for lost, path in self.p.search(f[: n + 1, i], best[: n + 1, i], ids[:, :n, i], n, want):
                out = []
                for s, x in path:
                    out.extend(self.p.spell(int(chars[i, s])) if x == self.p.unk else [x])
                have.append((lost, out))
            self._known[word] = have
        return have

    def best(self):
        """(flat ids, pieces by row, score by row)."""
        count = self.count[self.word]
        ids = self.ids[flatten(self.at_piece[self.word], count)] if len(self.word) else np.zeros(0, np.int32)
        upto = np.concatenate(([0], np.cumsum(count)))
        score = np.concatenate(([0.0], np.cumsum(self.total[self.word])))
        return ids, upto, score

    def alternatives(self, row, want, upto):
        """[(shortfall, [(at, drop, add), ...])] of ranks 2 to ``want``."""
        a, b = int(self.first_word[row]), int(self.first_word[row + 1])
        if a == b or want < 2:
            return []
        r = self.regret[self.word[a:b]]
        if len(r) > want - 1:
            limit = np.partition(r, want - 2)[want - 2]
            i = np.flatnonzero(r <= limit)
            i = i[np.argsort(r[i], kind="stable")][: want - 1]
        else:
            i = np.arange(len(r))
        i = np.sort(i[np.isfinite(r[i])])
        options = [self.choices(int(self.word[a + k]), want) for k in i]
        out, heap, seen = [], [(0.0, (0,) * len(i))], set()
        while heap and len(out) < want:
            lost, pick = heapq.heappop(heap)
            out.append((lost, pick))
            for k in range(len(pick)):
                if pick[k] + 1 < len(options[k]):
                    new = (*pick[:k], pick[k] + 1, *pick[k + 1 :])
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(heap, (sum(o[x][0] for o, x in zip(options, new)), new))
        base = upto[a]
        return [
            (lost, [(int(upto[a + k] - base), int(self.count[self.word[a + k]]), options[j][pick[j]][1]) for j, k in enumerate(i) if pick[j]])
            for lost, pick in out[1:]
        ]


def decode_flat(p: Pieces, ids, first):
    """Texts of runs of ids: run r is ids[first[r]:first[r + 1]]; the space in front is taken off."""
    ids = np.where((ids >= 0) & (ids < p.size), ids, 0)
    count = p.byte_off[ids + 1] - p.byte_off[ids]
    data = p.bytes[flatten(p.byte_off[ids], count)] if len(ids) else np.zeros(0, np.uint8)
    off = np.concatenate(([0], np.cumsum(count)))[first]
    full = np.flatnonzero(np.diff(off) > 0)
    lead = off[:-1][full]
    lead = lead[data[lead] == 32]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    upto = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], upto[off]


_PIECES: dict[str, Pieces] = {}


def pieces(model):
    """Tables of a model file's content, built once in a worker."""
    import hashlib

    key = hashlib.sha256(model).hexdigest()
    if key not in _PIECES:
        _PIECES[key] = Pieces(model)
    return _PIECES[key]


def encoder(model: bytes, want=N):
    def encode(batches):
        p = pieces(model)
        kind = pa.list_(pa.struct([("rank", pa.int32()), ("score", pa.float64()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("add", pa.list_(pa.int32()))])))]))
        for batch in batches:
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            data, off = buffers(batch.column(1))
            for i, j in row_blocks(off):
                block, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                b = Block(p, block, at)
                ids, upto, score = b.best()
                first = upto[b.first_word]
                scores = np.diff(score[b.first_word])
                gone = null[i:j]
                nbest = []
                for r in range(j - i):
                    s = float(scores[r])
                    nbest.append(None if gone[r] else [{"rank": 1, "score": s, "changes": []}] + [{"rank": k, "score": s - lost, "changes": [{"at": x, "drop": y, "add": z} for x, y, z in ch]} for k, (lost, ch) in enumerate(b.alternatives(r, want, upto), 2)])
                text, to = decode_flat(p, ids, first)
                back = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(text)])
                same = pc.equal(back, pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(block))]))
                missing = pa.array(gone)
                none = lambda a: pc.if_else(missing, pa.scalar(None, a.type), a)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32), mask=np.append(gone, False)), pa.array(ids))
                yield pa.record_batch([batch.column(0).slice(i, j - i), none(pa.array(np.diff(first).astype(np.int32))), none(pa.array(scores)), lists, pa.array(nbest, kind), none(same)], ["doc_id", "n_tokens", "score", "ids", "nbest", "decodes"])

    return encode


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, id_col="doc_id", text_col="text", model_file: str = MODEL, want: int = N) -> DataFrame:
    """(doc_id, n_tokens, score, ids, nbest, decodes) of every row.

    ``ids`` is the best segmentation. ``nbest`` lists ranks 1 to ``want`` with scores;
    ``changes`` tell a segmentation's differences from the best: at piece ``at``,
    ``drop`` pieces give way to ``add``. ``decodes`` says that ids decode to the text.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(encoder(_content(model_file), want), SCHEMA)


def decode(encoded: DataFrame, ids_col="ids", out_col="text", model_file: str = MODEL) -> DataFrame:
    """``encoded`` with the text of ``ids_col``; null stays null; ids outside the vocabulary and control pieces say nothing."""
    model = _content(model_file)

    def texts(batches):
        p = pieces(model)
        for col in batches:
            a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            first = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False))))
            data, off = decode_flat(p, pc.fill_null(a.flatten(), 0).to_numpy(zero_copy_only=False), first)
            raw = data.tobytes()
            null = a.is_null().to_pylist()
            yield pa.array([None if z else raw[s:e].decode("utf-8", "replace") for z, s, e in zip(null, off[:-1], off[1:])], pa.string())

    from collections.abc import Iterator

    texts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return encoded.withColumn(out_col, F.arrow_udf(texts, "string")(F.col(ids_col)))


def nbest_ids(ids, nbest):
    """All segmentations of one row as lists of ids (a helper for readers of the result)."""
    out = []
    for s in nbest:
        new, at = [], 0
        for c in s["changes"]:
            new += list(ids[at : c["at"]]) + list(c["add"])
            at = c["at"] + c["drop"]
        out.append(new + list(ids[at:]))
    return out


def op9_nbest_pieces(spark, sf_dir):
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
