"""Likeness of strings in Python workers: gestalt ratios, with bounds that are cheaper than they are."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from prosemill.operators.portions import hand_back, portions

#: Bits of a block: one is left for the carry. Numbers that a table of matches of pairs compared at once has.
_BITS = 63
_TABLE = 1 << 20
#: Fewer pairs a block than this don't share the cost of array operations.
_FEW = 12
#: Bytes of regions and sentences that are worked on at once.
_AT_ONCE = 1 << 23
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def ratio(x, y):
    """Gestalt similarity as difflib has it. Of equal strings it is 1: the first block found lies at equal places and grows to the whole."""
    return 1.0 if x == y else SequenceMatcher(None, x, y).ratio()


def _numbers(strings):
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)


def _lcs(x, y):
    """The longest common subsequence's length of one pair; bit vectors are Python's integers."""
    eq, codes = {}, _numbers([x])
    for c in set(x):
        eq[c] = int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little")
    full = v = (1 << len(x)) - 1
    for c in y:
        if u := v & eq.get(c, 0):
            v = ((v + u) | (v ^ u)) & full
    return len(x) - v.bit_count()


def lcs_lengths(a, b):
    """Lengths of longest common subsequences of pairs of strings: bit vectors in blocks, all pairs of as many blocks at once, or one by one if they are few."""
    out = np.zeros(len(a), np.int64)
    a, b = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b))) if len(a) else ((), ())
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    blocks = (m + _BITS - 1) // _BITS
    order = np.lexsort((-n, blocks))
    order = order[blocks[order] > 0]
    one, carry, s = np.uint64(1), np.uint64(_BITS), 0
    full = (one << carry) - one
    while s < len(order):
        w = int(blocks[order[s]])
        own = order[s : min(s + 1024, int(np.searchsorted(blocks[order], w, side="right")))]
        letters, code = np.unique(_numbers([a[k] for k in own]), return_inverse=True)
        own = own[: max(1, _TABLE // (w * (len(letters) + 1)))]
        s += len(own)
        if len(own) < _FEW * w:
            for k in own:
                out[k] = _lcs(a[k], b[k])
            continue
        k, lx, ly = len(own), m[own], n[own]
        code, y = code[: lx.sum()], _numbers([b[z] for z in own])
        at = np.minimum(np.searchsorted(letters, y), len(letters) - 1)
        at = np.where(letters[at] == y, at, len(letters)) * (w * k)
        eq = np.zeros((len(letters) + 1) * w * k, np.uint64)
        pair, place = np.repeat(np.arange(k), lx), np.arange(len(code)) - np.repeat(np.cumsum(lx) - lx, lx)
        np.bitwise_or.at(eq, code * (w * k) + place // _BITS * k + pair, one << (place % _BITS).astype(np.uint64))
        at += np.repeat(np.arange(k), ly)
        fy, block = np.cumsum(ly) - ly, np.arange(w)[:, None] * k
        v, t = np.full((w, k), full), k
        for step in range(int(ly[0])):
            # The longest come first, so those that go on are in front.
            while ly[t - 1] <= step:
                t -= 1
            p = v[:, :t]
            u = eq.take(at.take(fy[:t] + step) + block, mode="clip")
            u &= p
            total = p + u
            for j in range(1, w):
                total[j] += total[j - 1] >> carry
            p ^= u
            p |= total
            p &= full
        out[own] = _BITS * w - np.bitwise_count(v).sum(axis=0, dtype=np.int64)
    return out


def _histograms(strings):
    """How often each of 64 classes of characters occurs in each string."""
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    at = np.repeat(np.arange(len(n)) << 6, n) + (_numbers(strings) & np.uint32(63))
    return np.bincount(at, minlength=len(n) << 6).reshape(-1, 64)


def _halves(strings, more):
    """Both lists of strings with their rarer characters only, and with the commonest ones, which make up half of all."""
    codes = _numbers([*strings, *more])
    n = np.bincount(codes) if len(codes) else np.zeros(1, np.int64)
    order = np.argsort(-n, kind="stable")
    often = np.zeros(len(n), bool)
    often[order[: int(np.searchsorted(np.cumsum(n[order]), n.sum() / 2)) + 1]] = True
    ends = np.cumsum([len(x) for y in (strings, more) for x in y])
    for kept in (~often[codes], often[codes]):
        text = codes[kept].tobytes().decode("utf-32-le", "surrogatepass")
        upto = np.append(0, np.cumsum(kept))[np.append(0, ends)].tolist()
        parts = [text[x:y] for x, y in zip(upto, upto[1:])]
        yield parts[: len(strings)], parts[len(strings) :]


def alike(texts, sentences, i, j, over):
    """Which pairs (texts[i], sentences[j]) have a gestalt ratio above ``over``.

    The matching characters are a common subsequence, so a longest one bounds them. It is
    no longer than those of the rarer and the commonest characters together, which take a
    quarter of its time each, and these no longer than what both strings have of each class
    of characters. Only pairs that all bounds leave open are compared by difflib.
    """
    i, j = np.asarray(i, np.int64), np.asarray(j, np.int64)
    ok = np.zeros(len(i), bool)
    if not len(i):
        return ok
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (texts, sentences))
    total = np.maximum(n[i] + m[j], 1)

    def shared(x, y, some):
        h, g = _histograms(x), _histograms(y)
        parts = (some[s : s + 4096] for s in range(0, len(some), 4096))
        return np.concatenate([np.zeros(0, np.int64), *(np.minimum(h[i[p]], g[j[p]]).sum(axis=1) for p in parts)])

    def common(x, y, some):
        return lcs_lengths([x[k] for k in i[some]], [y[k] for k in j[some]])

    def left(some, bound):
        own = 2.0 * bound / total[some] > over
        return some[own], bound[own]

    some, _ = left(np.arange(len(i)), shared(texts, sentences, np.arange(len(i))))
    rare, often = _halves(texts, sentences)
    few = common(*rare, some)
    rest = shared(*often, some)
    own = 2.0 * (few + rest) / total[some] > over
    some, few = some[own], few[own]
    some, _ = left(some, few + common(*often, some))
    some, _ = left(some, common(texts, sentences, some))
    for k in some:
        ok[k] = ratio(texts[i[k]], sentences[j[k]]) > over
    return ok


def neighbours(lefts, rights, back, ahead, over):
    """[(first, index)] of each document: regions [(first, text, in small letters)] with the sentences [(index, text, in small letters)] near them that they hold, share words with or resemble.

    Words are split and counted once a string; pairs that only a ratio can tell are compared together.
    """
    out, texts, sentences, i, j, places = [], [], [], [], [], []
    for left, right in zip(lefts, rights):
        found, first = [], len(sentences)
        # A region or sentence without text or number pairs with none.
        right = sorted((r for r in right or () if None not in r), key=lambda r: r[0])
        at, said = [r[0] for r in right], [r[1] for r in right]
        words = [{w for w in _SPACE.split(r[2]) if len(w) > 4} for r in right]
        for l in left or ():
            if None in l:
                continue
            begin, text, there, size, mine = l[0], l[1], set(_SPACE.split(l[2])), len(l[1]), None
            for k in range(bisect_left(at, begin - back), bisect_right(at, begin + ahead)):
                s, w = said[k], words[k]
                if s in text or 2 * len(w & there) > len(w):
                    found.append((begin, at[k]))
                elif 2 * min(size, len(s)) > over * (size + len(s)):
                    if mine is None:
                        mine = len(texts)
                        texts.append(text)
                    i.append(mine)
                    j.append(first + k)
                    places.append((len(out), begin, at[k]))
        sentences.extend(said)
        out.append(found)
    for k in np.flatnonzero(alike(texts, sentences, i, j, over)):
        d, begin, index = places[k]
        out[d].append((begin, index))
    return out


def neighbours_udf(back, ahead, over):
    """``neighbours`` as an iterator of batches of two columns of arrays, in portions."""
    def rows(c, a, b):
        """Tuples of each row's structs, none for a null row."""
        c = c.slice(a, b - a)
        fields = list(zip(*(x.to_pylist() for x in c.flatten().flatten())))
        upto = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False))).tolist()
        return [fields[x:y] for x, y in zip(upto, upto[1:])]

    def run(batches):
        for left, right in batches:
            for a, b in portions([left, right], _AT_ONCE):
                found = neighbours(rows(left, a, b), rows(right, a, b), back, ahead, over)
                pairs = np.array([p for f in found for p in f], np.int32).reshape(-1, 2)
                sizes = np.append(0, np.cumsum([len(f) for f in found]))
                values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["first", "sent_index"])
                yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
        hand_back()

    return run
