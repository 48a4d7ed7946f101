"""Text as numpy arrays: words, rolling hashes and word shingles of many documents at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SHINGLE = U(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

#: Bytes of a word, folded to lower case; 0 parts words. Letters and digits of ASCII, and every byte of other scripts.
WORDS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = _b | 32 if 65 <= _b <= 90 else _b
    WORDS[_b] = _c if 97 <= _c <= 122 or 48 <= _c <= 57 or _c >= 128 else 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64 to the powers 0 to n - 1."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        both = []
        for base in (BASE, BASE_INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = both[0], both[1]
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over the bytes before each position; n + 1 of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); equal bytes have equal hashes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def words(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words of each document) of the runs of nonzero bytes; no run crosses a document's end."""
    inside = folded != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(folded))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each document)."""
    folded = fold[data]
    starts, ends, counts = words(folded, offsets)
    return span_hash(prefix_hash(folded), starts, ends), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``size`` words, runs of each document); a shorter document that has words has one, of all its words."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    total = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    factor = U(1)
    for k in range(size):
        total += hashes[k : k + len(total)] * factor
        factor = U(int(factor) * int(SHINGLE) & 0xFFFFFFFFFFFFFFFF)
    begins = np.cumsum(counts) - counts
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    outs = np.cumsum(n) - n
    at = np.arange(int(n.sum()), dtype=np.int64) + np.repeat(begins - outs, n)
    out = np.zeros(len(at), np.uint64)
    full = np.repeat(counts >= size, n)
    out[full] = mix(total[at[full]])
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        h, factor = U(0), 1
        for w in hashes[begins[d] : begins[d] + counts[d]]:
            h = U((int(h) + int(w) * factor) & 0xFFFFFFFFFFFFFFFF)
            factor = factor * int(SHINGLE) & 0xFFFFFFFFFFFFFFFF
        out[outs[d]] = mix(np.array([h ^ U(int(counts[d]))], np.uint64))[0]
    return out, n


class HashIndex:
    """Places of 64-bit keys in an open-addressed table; lookups of whole arrays take about one probe a key."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.mask = U((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.places = np.full(1 << bits, -1, np.int32)
        slot, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            free = self.places[slot[left]] < 0
            at, first = np.unique(slot[left][free], return_index=True)
            put = left[free][first]
            self.places[at], self.keys[at] = put, keys[put]
            done = np.zeros(len(keys), bool)
            done[put] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + U(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for a key that is not in the table."""
        slot = keys & self.mask
        out = self.places[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        out[left] = -2
        while len(left):
            s = (slot[left] + U(1)) & self.mask
            slot[left] = s
            at = self.places[s]
            end = (at < 0) | (self.keys[s] == keys[left])
            out[left[end]] = at[end]
            left = left[~end]
        return out
