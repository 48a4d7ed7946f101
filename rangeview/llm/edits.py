"""Edit distance of many pairs of texts at once, up to a bound: Myers' bit vectors, a word of 64 rows for each pair and step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Codes of signs: the most frequent ones of a batch; texts with any other sign are left to the caller.
CODES = 64
#: Words of a column of the table, for which pairs are worked on together; those that need more are left to the caller.
#: Fewer pairs than this for each word go with wider ones, and are left to the caller if there are none.
WIDTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24)
FEW = 16
#: Words of all columns that are worked on together, so that they stay in the cache.
TOGETHER = 16384
#: Columns of a table after which it is looked at which pairs and which words still count.
BAND = 16
#: Classes that codes are counted in, by their last five bits, and codes and pairs that are looked at together for that.
CLASSES = 32
CODES_AT_ONCE, PAIRS_AT_ONCE = 1 << 20, 1 << 15
#: How far two texts are searched for the next eight signs that they share, and pairs that are gone through together for that.
REACH, GONE_THROUGH = 12, 1 << 12
_SHIFTS = sorted(((i, j) for i in range(REACH + 1) for j in range(REACH + 1) if i or j), key=max)


class Coded:
    """Texts as runs of small codes."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        self.texts = texts
        self.size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        signs = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        counts = np.bincount(signs, minlength=1) if len(signs) else np.zeros(1, np.int64)
        common = np.argsort(-counts, kind="stable")[: CODES - 1]
        code = np.zeros(len(counts), np.uint8)
        code[common] = np.arange(1, len(common) + 1)
        # some signs after the last, so that places past a text's end can be read
        self.codes = np.append(code[signs], np.zeros(8, np.uint8))
        #: the eight codes from each place on
        self.eights = np.ndarray(len(signs) + 1, "<u8", self.codes, strides=(1,))
        rare = np.flatnonzero(self.codes[:-8] == 0)
        self.plain = np.searchsorted(rare, self.start + self.size) == np.searchsorted(rare, self.start)
        self.counts = np.zeros((len(self.size), CLASSES), np.int32)
        ends, at = self.start + self.size, 0
        while at < len(ends):
            k = max(at + 1, int(np.searchsorted(ends, self.start[at] + CODES_AT_ONCE, "right")))
            k = min(k, at + CODES_AT_ONCE // CLASSES)
            row = np.repeat(np.arange(k - at) * CLASSES, self.size[at:k])
            self.counts[at:k] = np.bincount(row + self.codes[self.start[at] : ends[k - 1]] % CLASSES, minlength=(k - at) * CLASSES).reshape(-1, CLASSES)
            at = k

    def least(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Edits that the texts ``x`` and ``y`` differ by at least: the signs of a class that one has more than the other, on the side with more of them."""
        out = np.zeros(len(x), np.int64)
        for k in range(0, len(x), PAIRS_AT_ONCE):
            a, b = x[k : k + PAIRS_AT_ONCE], y[k : k + PAIRS_AT_ONCE]
            out[k : k + PAIRS_AT_ONCE] = (np.abs(self.counts[a] - self.counts[b]).sum(1) + np.abs(self.size[a] - self.size[b])) // 2
        return out


def within_pairs(coded: Coded, a: np.ndarray, b: np.ndarray, most: np.ndarray, one) -> np.ndarray:
    """Whether the edit distance of each pair of texts (numbers ``a``, ``b``) is at most ``most``; ``one(x, y, most)`` tells it of pairs with rare signs or very long rests."""
    swap = coded.size[a] > coded.size[b]
    x, y = np.where(swap, b, a), np.where(swap, a, b)
    out = coded.least(x, y) <= most
    if not out.any():
        return out
    scalar = out & ~(coded.plain[x] & coded.plain[y])
    todo = np.flatnonzero(out & ~scalar)
    todo = todo[np.argsort(coded.size[x[todo]], kind="stable")]
    head, tail = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
    at = 0
    while at < len(todo):
        step = max(1, (1 << 18) // max(1, int(coded.size[x[todo[min(at + 255, len(todo) - 1)]]])))
        k = todo[at : at + min(step, 256)]
        at += len(k)
        head[k], tail[k] = _ends(coded, x[k], y[k])
    m, n = coded.size[x] - head - tail, coded.size[y] - head - tail
    # nothing left of one text, or so little of both that it may be written anew
    todo = todo[(m[todo] > 0) & (n[todo] > most[todo])]
    for s in range(0, len(todo), GONE_THROUGH):
        k = todo[s : s + GONE_THROUGH]
        out[k] = _surely(coded, coded.start[x[k]] + head[k], m[k], coded.start[y[k]] + head[k], n[k], most[k])
    todo = todo[~out[todo]]
    kind = np.searchsorted(WIDTHS, -(-m // 64))
    todo = todo[np.lexsort((n[todo], kind[todo]))]
    cuts = np.searchsorted(kind[todo], np.arange(len(WIDTHS) + 2))
    scalar[todo[cuts[-2] :]] = True
    few = todo[:0]
    for words, lo, hi in zip(WIDTHS, cuts, cuts[1:]):
        some = np.concatenate([few, todo[lo:hi]])
        if len(some) < FEW * words:
            few = some  # they go with those of the next width
            continue
        few, some = todo[:0], some[np.argsort(n[some], kind="stable")]
        step = TOGETHER // words
        for s in range(0, len(some), step):
            k = some[s : s + step]
            out[k] = _myers(coded, coded.start[x[k]] + head[k], m[k], coded.start[y[k]] + head[k], n[k], most[k], words)
    scalar[few] = True
    for k in np.flatnonzero(scalar):
        out[k] = one(coded.texts[x[k]].as_py(), coded.texts[y[k]].as_py(), int(most[k]))
    return out


def _ends(coded: Coded, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many signs the texts ``x`` and the texts ``y``, none shorter than its ``x``, begin and end with alike; the two never overlap in ``x``."""
    size = coded.size[x]
    i = np.arange(int(size.max()) + 1)
    last = len(coded.codes) - 1
    inner = i < size[:, None]
    same = coded.codes[np.minimum(coded.start[x][:, None] + i, last)] == coded.codes[np.minimum(coded.start[y][:, None] + i, last)]
    head = np.argmin(same & inner, axis=1)
    same = coded.codes[np.maximum((coded.start[x] + size - 1)[:, None] - i, 0)] == coded.codes[np.maximum((coded.start[y] + coded.size[y] - 1)[:, None] - i, 0)]
    tail = np.argmin(same & (i < (size - head)[:, None]), axis=1)
    return head, tail


def _surely(coded: Coded, xs: np.ndarray, m: np.ndarray, ys: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """True only for pairs of runs of codes within ``most``, told by one way of writing one as the other; false tells nothing.

    Equal signs are passed eight at a time; where signs differ, the nearest places with eight equal signs are sought, and what lies before
    them is written anew.
    """
    out = np.zeros(len(m), bool)
    alive, xs, ys = np.arange(len(m)), xs.copy(), ys.copy()
    x_end, y_end, cost = xs + m, ys + n, np.zeros(len(m), np.int64)
    a, b = (np.array(v)[:, None] for v in zip(*_SHIFTS))
    price = np.array([max(v) for v in _SHIFTS])
    while len(alive):
        left = np.minimum(x_end[alive] - xs[alive], y_end[alive] - ys[alive])
        differ = coded.eights[xs[alive]] ^ coded.eights[ys[alive]]
        same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        same = np.minimum(same, left)
        xs[alive] += same
        ys[alive] += same
        left -= same
        stop = alive[(left < 8) & ((same < 8) | (left == 0))]
        out[stop] = cost[stop] + np.maximum(x_end[stop] - xs[stop], y_end[stop] - ys[stop]) <= most[stop]
        seek = alive[(same < 8) & (left >= 8)]
        if len(seek):
            last = len(coded.eights) - 1
            ahead = np.arange(REACH + 1)[:, None]
            x, y = (coded.eights[np.minimum(v[seek] + ahead, last)] for v in (xs, ys))
            hit = (x[a[:, 0]] == y[b[:, 0]]) & (a + 8 <= x_end[seek] - xs[seek]) & (b + 8 <= y_end[seek] - ys[seek])
            first = np.argmax(hit, axis=0)
            found = hit[first, np.arange(len(seek))]
            plain = np.minimum(REACH, left[(same < 8) & (left >= 8)])
            cost[seek] += np.where(found, price[first], plain)
            xs[seek] += np.where(found, a[first, 0], plain)
            ys[seek] += np.where(found, b[first, 0], plain)
        alive = alive[((same == 8) & (left > 0)) | (left >= 8)]
        alive = alive[cost[alive] <= most[alive]]
    return out


def _myers(coded: Coded, xs: np.ndarray, m: np.ndarray, ys: np.ndarray, n: np.ndarray, most: np.ndarray, words: int) -> np.ndarray:
    """Whether each pair of runs of codes (from ``xs``, ``m`` long, at most ``words`` words; from ``ys``, ``n`` long) is within ``most``.

    Rows of the table are counted from their end, so the last is the same bit for all; the rows before the first match nothing
    and begin at 0, so each repeats the table's edge. A way of at most ``most`` edits never leaves a band of as many diagonals, since what
    leads away must lead back: words above it are left as they were and count as one edit more a column, words under it as one edit
    more a row. No distance gets less by that, and those within ``most`` stay as they are.
    """
    p = len(m)
    one, top = np.uint64(1), np.uint64(63)
    last = len(coded.codes) - 1
    equal = np.zeros((words, CODES * p), np.uint64)
    every = np.arange(p)
    void = 64 * words - m
    for i in range(int(void.min()), 64 * words):
        has = every if i >= int(void.max()) else np.flatnonzero(void <= i)
        equal[i >> 6, coded.codes[(xs - void)[has] + i].astype(np.int64) * p + has] |= one << np.uint64(i & 63)
    out = np.zeros(p, bool)
    alive, score = every, m.copy()
    full = ~np.uint64(0)
    ups = [np.where(void >= 64 * k + 64, np.uint64(0), full << np.clip(void - 64 * k, 0, 63).astype(np.uint64)) for k in range(words)]
    downs = [np.zeros(p, np.uint64) for _ in range(words)]
    low, high = void - (most + n - m + 1) // 2 - 1, (most - n + m) // 2 + void + BAND
    for j in range(int(n.max())):
        if j % BAND == 0:
            begin = max(begin, int(low[alive].min()) + j >> 6) if j else 0
            end = min(words, max(end, (int(high[alive].max()) + j >> 6) + 1)) if j else min(words, (int(high.max()) >> 6) + 1)
        at = coded.codes[np.minimum(ys[alive] + j, last)].astype(np.int64) * p + alive
        more_in, less_in = one, None
        for k in range(begin, end):
            up, down, eq = ups[k], downs[k], equal[k][at]
            vertical = eq | down
            if less_in is not None:
                eq |= less_in
            across = (((eq & up) + up) ^ up) | eq
            more, less = down | ~(across | up), up & across
            if k == end - 1:
                score = score + (more >> top).astype(np.int64) - (less >> top).astype(np.int64)
                more_out = less_out = None
            else:
                more_out, less_out = more >> top, less >> top
            more = (more << one) | more_in
            less <<= one
            if less_in is not None:
                less |= less_in
            ups[k], downs[k] = less | ~(vertical | more), more & vertical
            more_in, less_in = more_out, less_out
        left = n[alive] - (j + 1) if j % BAND == BAND - 1 or j + 1 >= int(n[alive[0]]) else None
        if left is not None:
            ended = left == 0
            out[alive[ended]] = score[ended] <= most[alive[ended]]
            keep = ~ended
            # distances never fall along a diagonal; the one that ends in the last cell is ``left`` rows above the last
            least, bound = score.copy(), 64 * words - left
            for k in range(max(begin, int(bound.min()) >> 6), words):
                over = np.clip(bound - 64 * k, 0, 64).astype(np.uint64)
                rows = np.where(over < 64, full << np.minimum(over, top), np.uint64(0))
                least -= np.bitwise_count(ups[k] & rows).astype(np.int64) - np.bitwise_count(downs[k] & rows)
            keep &= (left > m[alive]) | (least <= most[alive])
            if not keep.any():
                break
            if ended.any() or np.count_nonzero(keep) < 0.8 * len(keep):
                alive, score = alive[keep], score[keep]
                ups, downs = [u[keep] for u in ups], [d[keep] for d in downs]
    return out
