"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, one line of each connected group."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeview.llm.common import bitmap, byte_chunks, forget, session, text_of, written
from rangeview.llm.edits import Coded, within_pairs
from rangeview.llm.groups import components
from rangeview.llm.vec import WORDS, mix, powers, prefix_hash, span_hash, words

#: A line's features are cut in five runs; the SimHash of each run is one block of the line's 64 bits.
CUTS = (0, 13, 26, 39, 52, 64)
#: Linked lines have SimHashes that differ in at most so many bits and agree in two blocks; each pair of blocks is a key of 25 or 26 bits.
DISTANCE = 16
SIMILARITY = 0.8
#: Features of a line are its words; of a line of fewer words, each byte of its words with the byte after it.
FEW_WORDS = 10
#: Lines of fewer characters have no other line within the similarity, since one edit of four characters leaves 0.75.
LEAST_CHARS = 5
PAIRS = tuple(combinations(range(5), 2))
#: Rows of a bucket up to which all are compared at once; of a longer one, all rows go on and are compared in rounds.
LONG = 1024
#: Rows of a bucket that each other one is held against in one round, at most.
ROUND = 64
#: Signs of a line are counted in so many classes, by their last byte; each count is kept modulo 32, twelve in a word.
CLASSES = 24
#: Lines whose signs are counted together.
LINES_AT_ONCE = 1 << 13
#: Rows of buckets that a task looks at together, at least and at most.
STEP = 1 << 17
HELD = 1 << 20
#: Lines whose rows a task deals to parts together, parts at least, rows that a part is meant to have, and rows that travel as one.
DEALT, PARTS, PART_ROWS, PACKED = 1 << 15, 256, 1 << 18, 1 << 9
STEP_BYTES = 32 << 20
#: Pairs whose texts are compared together, and rows of a bucket that one task holds.
PAIRS_AT_ONCE = 1 << 16
WIDE = 4096
#: Size of the bitmap of linked lines, as a power of two of bits: 8 MB, whatever the input.
BITMAP_BITS = 26

_CLASS = np.arange(256) % CLASSES
_FOLD = WORDS.copy()
_FOLD[48:58] = 48
#: Each byte's bits, the highest first, as the eight bytes of a word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
#: Sizes of the five runs of a line of so few features that they do not fill them.
_SMALL = np.array([[0, 0, 0, 0, 0], [1, 0, 0, 0, 0], [1, 0, 0, 0, 1], [1, 1, 0, 0, 1], [1, 1, 0, 1, 1]])


def block_hashes(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 64 bits of each line from the hashes of its ``counts`` features: each block is the SimHash of a run of them.

    With w the greatest power of two of at most a fifth of the features (1 for fewer than ten), the runs are the first w, the next w, the rest, the
    last but one w and the last w features. An edit moves the runs that it touches only, as those before it are counted from the start
    and those after it from the end, so lines whose edits leave two runs alone agree in two blocks for certain but where w
    differs; a run in which few of many features changed agrees with some luck. An empty run is zero.
    """
    out = np.zeros(len(counts), np.uint64)
    if not len(h):
        return out
    low = h.astype("<u2")
    ends = np.cumsum(counts)
    begins = ends - counts
    # bits are counted for some thousand features at a time, so memory stays small
    step = max(1, len(counts) * 40_000 // len(h))
    for k in range(0, len(counts), step):
        n = counts[k : k + step]
        a, b = begins[k], ends[min(k + step, len(counts)) - 1]
        w = 1 << np.frexp(np.maximum(n // 5, 1))[1].astype(np.int64) - 1
        size = np.where((n < 5)[:, None], _SMALL[np.minimum(n, 4)], np.stack([w, w, n - 4 * w, w, w], 1)).ravel()
        first = np.cumsum(size) - size
        some = size > 0
        bytes_ = low[a:b].view(np.uint8).reshape(-1, 2)
        if size.max() < 256:  # eight counts in a word
            ones = np.add.reduceat(_SPREAD[bytes_], first[some], axis=0).view(np.uint8).astype(np.uint32)
        else:
            ones = np.add.reduceat(np.unpackbits(bytes_, axis=1), first[some], axis=0, dtype=np.uint32)
        block = np.zeros(len(size), np.uint64)
        block[some] = np.packbits(2 * ones > size[some, None], axis=1).view("<u2").ravel()
        for i, (lo, hi) in enumerate(zip(CUTS, CUTS[1:])):
            out[k : k + step] |= (block[i::5] & np.uint64((1 << hi - lo) - 1)) << np.uint64(lo)
    return out


def sign_counts(data: np.ndarray, folded: np.ndarray, lines: np.ndarray, full: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(2, lines): how many signs of each class the normalised text of each line ``full`` has, modulo 32, twelve classes in a word."""
    last = (folded != 0) & (np.append(data[1:], np.uint8(0)) & 0xC0 != 0x80)
    out = np.zeros((2, len(full)), np.uint64)
    for k in range(0, len(full), LINES_AT_ONCE):
        own = full[k : k + LINES_AT_ONCE]
        lo, hi = lines[own[0]], lines[own[-1] + 1]
        at = np.flatnonzero(last[lo:hi])
        # lines between those of ``full`` hold no sign
        size = np.diff(np.searchsorted(at, lines[own + 1] - lo), prepend=0)
        n = np.bincount(np.repeat(np.arange(len(own)) * CLASSES, size) + _CLASS[folded[lo:hi][at]], minlength=len(own) * CLASSES).reshape(-1, CLASSES)
        n[:, 0] += counts[own] - 1  # the blanks between the words
        n = (n & 31).astype(np.uint64)
        for c in range(CLASSES):
            out[c // 12, k : k + len(own)] |= n[:, c] << np.uint64(c % 12 * 5)
    return out


def may_link(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether lines of ``a`` and ``b`` characters and sign counts ``x`` and ``y`` (2, pairs) can be within the similarity; never false for lines that are.

    One edit changes the counts by two in sum if it keeps the length, else by one; counts modulo 32 differ by no more than the counts.
    """
    apart = np.abs(a - b)
    edits = apart.copy()
    for p, q in zip(x, y):
        for shift in range(0, 60, 5):
            d = ((p >> np.uint64(shift)) - (q >> np.uint64(shift)) & np.uint64(31)).astype(np.int64)
            edits += np.minimum(d, 32 - d)
    return edits <= np.maximum(a, b) * 2 * (1 - SIMILARITY) + 1e-6


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, first byte, end) of each line of texts given as bytes."""
    breaks = np.flatnonzero(data == 10)
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((doc, start))
    doc, start = doc[order], start[order]
    number = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
    return doc, number, start, np.append(start[1:] - (doc[1:] == doc[:-1]), len(data))


def line_records(data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
    """(row, line number, hash, block SimHash, characters, words, first byte, end, sign counts) of each line with words, of texts given as bytes; no SimHash and no counts if not ``hashed``."""
    doc, number, start, end = line_spans(data, offsets)
    lines = np.concatenate([start, [len(data)]])
    folded = _FOLD[data]
    s, e, counts = words(folded, lines)
    h = span_hash(prefix_hash(folded), s, e)
    ends = np.cumsum(counts)
    begins = ends - counts
    whole = np.zeros(len(h) + 1, np.uint64)
    p, inverse = powers(len(h) + 1)
    np.cumsum(h * p[: len(h)], out=whole[1:])
    own = mix((whole[ends] - whole[begins]) * inverse[begins] + counts.astype(np.uint64))
    letters = np.concatenate([[0], np.cumsum(e - s)])
    more = np.flatnonzero(data & 0xC0 == 0x80)  # further bytes of a sign
    chars = letters[ends] - letters[begins] - np.diff(np.searchsorted(more, lines)) + counts - 1
    full = np.flatnonzero(counts)
    sim = np.zeros(len(full), np.uint64)
    few = (counts[full] < FEW_WORDS) & hashed
    long = full[~few]
    if hashed:
        sim[~few] = block_hashes(h[np.repeat(counts >= FEW_WORDS, counts)], counts[long])
    if few.any():
        short = np.zeros(len(counts), bool)
        short[full[few]] = True
        at = np.flatnonzero((folded != 0) & np.repeat(short, np.diff(lines)))
        of = np.searchsorted(lines, at, "right") - 1
        after = np.where(at + 1 < lines[of + 1], np.append(folded, np.uint8(0))[at + 1], 0).astype(np.uint64)
        size = np.bincount(of, minlength=len(counts))
        sim[few] = block_hashes(mix(folded[at].astype(np.uint64) << np.uint64(8) | after), size[full[few]])
    signs = sign_counts(data, folded, lines, full, counts) if hashed else None
    return doc[full], number[full], own[full], sim, chars[full], counts[full], start[full], end[full], signs


def normalised(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """What lines are compared by, of lines with words given as spans of bytes: A-Z lower-cased, digits as 0, runs of other ASCII signs as one space."""
    size = end - start
    first = np.cumsum(size) - size
    f = _FOLD[data[np.arange(int(size.sum())) + np.repeat(start - first, size)]]
    at = np.flatnonzero(f)
    # a word's first byte comes after a space, but at its line's begin
    apart = np.append(False, at[1:] != at[:-1] + 1)
    begin = np.searchsorted(at, first)
    apart[begin[1:]] = False
    place = np.arange(len(at)) + np.cumsum(apart)
    out = np.full(int(place[-1]) + 1 if len(at) else 0, 32, np.uint8)
    out[place] = f[at]
    offsets = np.append(place[begin], len(out)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.large_string()).cast(pa.string())


def _lines(docs: DataFrame) -> DataFrame:
    session(docs)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("th"), text_of().alias("text"))

    def read(batches):
        for b in batches:
            for lo, _, data, offsets in byte_chunks(b.column(2)):
                row, number, own, sim, chars, _, _, _, signs = line_records(data, offsets)
                if len(row):
                    at = pa.array(lo + row)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(x.view(np.int64)) for x in (number, own, sim, chars.astype(np.int64), *signs))], names=["doc_id", "th", "line", "h", "sim", "chars", "signs", "signs2"])

    return base.mapInArrow(read, "doc_id long, th long, line long, h long, sim long, chars long, signs long, signs2 long")


def _bucket(sim: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The bucket of each SimHash under its ``key``, one of ten: two of its five blocks, and which."""
    block = [sim.view(np.uint64) >> np.uint64(lo) & np.uint64((1 << hi - lo) - 1) for lo, hi in zip(CUTS, CUTS[1:])]
    out = np.zeros(len(sim), np.int64)
    for n, (i, j) in enumerate(PAIRS):
        at = np.flatnonzero(key == n)
        out[at] = ((block[i][at] << np.uint64(13) | block[j][at]) << np.uint64(4)).view(np.int64) | n
    return out


def _dealt(parts: int):
    """A function from batches (sim, chars, signs, signs2) of lines to batches (part, rows): each line's ten rows, all those of a bucket in one of ``parts``.

    ``rows`` holds up to ``PACKED`` rows: all their SimHashes, then all tags (16 * characters + key), then both words of sign counts.
    """

    def deal(columns):
        sim, chars, signs, signs2 = (np.repeat(np.concatenate(x), len(PAIRS)) for x in zip(*columns))
        key = np.tile(np.arange(len(PAIRS)), len(sim) // len(PAIRS))
        part = (mix(_bucket(sim, key).view(np.uint64)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        rows = np.stack([sim, chars * 16 + key, signs, signs2])[:, order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        lo = np.concatenate([np.arange(a, b, PACKED) for a, b in zip(first, np.append(first[1:], len(part)))])
        packed = [rows[:, a:b].tobytes() for a, b in zip(lo, np.append(lo[1:], len(part)))]
        return pa.RecordBatch.from_arrays([pa.array(part[lo].astype(np.int64)), pa.array(packed, pa.binary())], names=["part", "rows"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        lines = 0
        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy() for c in b.columns])
                lines += b.num_rows
            if lines >= DEALT:
                yield deal(held)
                held, lines = [], 0
        if lines:
            yield deal(held)

    return run


def _close(group: np.ndarray, sim: np.ndarray, chars: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Of rows sorted by ``group``, a bucket: whether another row of it is near, may be a link by its ``signs`` and shares no bucket of an earlier key; all rows of a bucket of over ``LONG``."""
    n = len(group)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    size = np.repeat(np.diff(np.append(first, n)), np.diff(np.append(first, n)))
    keep = size > LONG
    i = np.flatnonzero(~keep & (size > 1))
    for d in range(1, LONG):
        i = i[i + d < n]
        i = i[group[i] == group[i + d]]
        if not len(i):
            break
        open_ = i[~(keep[i] & keep[i + d])]
        a, b = chars[open_], chars[open_ + d]
        differ = (sim[open_] ^ sim[open_ + d]).view(np.uint64)
        ok = np.flatnonzero((np.bitwise_count(differ) <= DISTANCE) & (np.minimum(a, b) >= np.maximum(a, b) * SIMILARITY - 1e-9))
        ok = ok[_first_key(differ[ok]) == group[open_[ok]] & 15]
        ok = ok[may_link(signs[:, open_[ok]], signs[:, open_[ok] + d], a[ok], b[ok])]
        keep[open_[ok]] = keep[open_[ok] + d] = True
    return keep


def _met(batches):
    """(bucket, sim) of rows with a partner, of batches (part, rows) sorted by part, as ``_dealt`` gives them."""
    held: list[np.ndarray] = []
    rows, part, wide = 0, None, np.zeros(0, np.int64)

    def emit(whole: bool):
        """What goes on of the rows held; if more of their part come, rows of buckets that are not long yet are held on."""
        nonlocal held, rows, wide
        all_ = np.concatenate(held, axis=1)
        bucket = _bucket(all_[0], all_[1] & 15)
        order = np.argsort(bucket)
        bucket, all_ = bucket[order], all_[:, order]
        if whole:
            keep = _close(bucket, all_[0], all_[1] >> 4, all_[2:].view(np.uint64)) | np.isin(bucket, wide)
            held, rows, wide = [], 0, wide[:0]
        else:
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            size = np.diff(np.append(first, len(bucket)))
            wide = np.union1d(wide, bucket[first[size > LONG]])
            keep = np.isin(bucket, wide)
            held = [all_[:, ~keep]]
            rows = held[0].shape[1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(all_[0][keep])], names=["bucket", "sim"])

    most = HELD
    for b in batches:
        for p, packed in zip(b.column(0).to_pylist(), b.column(1)):
            if p != part:
                if rows >= STEP:
                    yield from emit(True)
                part, most = p, HELD
            held.append(np.frombuffer(packed.as_buffer(), np.int64).reshape(4, -1))
            rows += held[-1].shape[1]
            if rows >= most:
                yield from emit(False)
                most = max(HELD, 2 * rows)
    if rows:
        yield from emit(True)


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two texts is at most ``most``.

    What they begin and end with alike is cut off; texts of one length may be told by their unequal places; the rest
    is Myers' bit-parallel distance with a whole column of the table in one integer.
    """
    if abs(len(a) - len(b)) > most:
        return False
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    n = min(len(x), len(y))
    head = n if (x[:n] == y[:n]).all() else int(np.argmax(x[:n] != y[:n]))
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    tail = x[len(x) - n :][::-1] != y[len(y) - n :][::-1]
    tail = int(np.argmax(tail)) if tail.any() else n
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if max(len(x), len(y)) <= most or len(x) == len(y) and np.count_nonzero(x != y) <= most:
        return True
    if not len(x) or not len(y):
        return False
    at = {c: int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x).tolist()}
    whole, top = (1 << len(x)) - 1, len(x) - 1
    up, down, score, left = whole, 0, len(x), len(y)
    for c in y.tolist():
        equal = at.get(c, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        more, less = down | (whole & ~(across | up)), up & across
        score += (more >> top & 1) - (less >> top & 1)
        left -= 1
        more, less = (more << 1) | 1, less << 1
        up, down = (less | ~(vertical | more)) & whole, more & vertical & whole
        # distances never fall along a diagonal; the one that ends in the last cell is ``left`` rows above the last
        if left & 15 == 0 and left <= len(x) and score - (up >> len(x) - left).bit_count() + (down >> len(x) - left).bit_count() > most:
            return False
    return score <= most


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (for each row the least row that it is linked with) after links ``a``-``b`` more."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _first_key(differ: np.ndarray) -> np.ndarray:
    """The first of the ten keys that two SimHashes have in common, of the bits in which they differ; 10 if none."""
    same = [differ & np.uint64((1 << hi) - (1 << lo)) == 0 for lo, hi in zip(CUTS, CUTS[1:])]
    out = np.full(len(differ), len(PAIRS))
    for k, (i, j) in reversed(list(enumerate(PAIRS))):
        out[same[i] & same[j]] = k
    return out


def _bucket_links(bucket, part, side, h, sim, chars, comp, coded) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows, rows) that connect in each run of equal (``bucket``, ``part``) what all its linked pairs connect.

    Rows of side 0 are compared with those of side 1, rows of side -1 with all; rows of one ``comp`` are linked already.
    Each row is held against the first row of its run, then against the next four, the next sixteen and so on, but only while it is not
    linked with them by the rows before. So a run of alike lines takes one comparison a row, and a run of strangers all its pairs.
    """
    n = len(bucket)
    new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])]) if n else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    pos = np.arange(n) - first
    label, key = np.arange(n), bucket & 15
    rows, q, width = np.flatnonzero(pos > 0), 0, 1

    def hold(pairs):
        a, b = (np.concatenate(x) for x in zip(*pairs))
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        most = (np.maximum(coded.size[a], coded.size[b]) * (1 - SIMILARITY) + 1e-9).astype(np.int64)
        ok = within_pairs(coded, a, b, most, within)
        return _joined(label, a[ok], b[ok])

    while len(rows):
        pairs, held = [], 0
        for q in range(q, q + width):
            rows = rows[pos[rows] > q]
            if not len(rows):
                break
            i = rows[label[first[rows] + q] != label[rows]]
            head = first[i] + q
            differ = sim[i] ^ sim[head]
            ok = (np.bitwise_count(differ) <= DISTANCE) & (np.minimum(chars[i], chars[head]) >= np.maximum(chars[i], chars[head]) * SIMILARITY - 1e-9)
            ok &= (comp[i] != comp[head]) & ((side[i] != side[head]) | (side[i] < 0))
            i, head, differ = i[ok], head[ok], differ[ok]
            # lines that share several buckets are held against each other in the first
            ok = _first_key(differ) == key[i]
            if ok.any():
                pairs.append((head[ok], i[ok]))
                held += len(pairs[-1][0])
            if held >= PAIRS_AT_ONCE:
                label, pairs, held = hold(pairs), [], 0
        if pairs:
            label = hold(pairs)
        q, width = q + 1, min(4 * width, ROUND)
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def _linked(batches):
    """(a, b): links that connect what all linked pairs of each run connect, of batches (bucket, part, side, h, sim, chars, comp, text) sorted by bucket and part."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def emit(t: pa.Table):
        bucket, part, side, h, sim, chars, comp = (t.column(i).to_numpy() for i in range(7))
        a, b = _bucket_links(bucket, part, side, h, sim.view(np.uint64), chars, comp, Coded(t.column(7).combine_chunks()))
        return pa.RecordBatch.from_arrays([pa.array(h[a]), pa.array(h[b])], names=["a", "b"])

    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.column(7).nbytes
        if rows >= STEP or size >= STEP_BYTES:
            t = pa.Table.from_batches(held)
            bucket, part = t.column(0).to_numpy(), t.column(1).to_numpy()
            other = np.flatnonzero((bucket != bucket[-1]) | (part != part[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield emit(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                rows, size = rows - cut, sum(x.nbytes for x in held)
    if rows:
        yield emit(pa.Table.from_batches(held))


def _place(id_: Column, th: Column, line: Column) -> Column:
    """A number of an occurrence of a line; the same in ``_texts``."""
    return th.bitwiseXOR(line).bitwiseXOR(F.shiftleft(F.coalesce(id_, F.lit(-1)), 8))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, text): the normalised text of each line in ``wanted`` (h, first).

    A bitmap of fixed size picks the first occurrence of each line while texts are read, before any word is looked at, so few others are
    hashed and shuffled; the join after it is exact.
    """
    place = _place(F.col("first.doc_id"), F.col("first.th"), F.col("first.line"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(place.alias("place")), "place", BITMAP_BITS))

    def read(batches):
        for b in batches:
            base = b.column(0).to_numpy()
            for lo, _, data, offsets in byte_chunks(b.column(1)):
                row, number, start, end = line_spans(data, offsets)
                at = (base[lo + row] ^ number) & ((1 << BITMAP_BITS) - 1)
                hit = np.flatnonzero((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & (end > start))
                if len(hit):
                    size = end[hit] - start[hit]
                    offsets = np.append(0, np.cumsum(size))
                    data = data[np.arange(offsets[-1]) + np.repeat(start[hit] - offsets[:-1], size)]
                    _, _, own, _, _, _, start, end, _ = line_records(data, offsets, hashed=False)
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), normalised(data, start, end)], names=["h", "text"])

    base = _place(F.col("doc_id").cast("long"), F.xxhash64(text_of()), F.lit(0).cast("long"))
    found = docs.select(base.alias("base"), text_of().alias("text")).mapInArrow(read, "h long, text string")
    return found.groupBy("h").agg(F.min("text").alias("text")).join(wanted, "h", "left_semi")


def _components(members: DataFrame) -> DataFrame:
    """(node, component) of the links of all pairs of lines that share a bucket; ``members``: (bucket, h, sim, chars, text).

    Rows of a bucket are dealt to parts of about ``WIDE`` and linked inside their part. In a bucket of several parts the lines
    outside its largest component so far then visit the other parts, so that every pair of components meets; parts of one component take no visit.
    """
    names = ("bucket", "part", "side", "h", "sim", "chars", "comp", "text")
    out = "a long, b long"

    def links(rows: DataFrame) -> DataFrame:
        return written(rows.select(*names).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "side").mapInArrow(_linked, out))

    wide = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE).select("bucket", F.ceil(F.col("n") / WIDE).alias("parts")))
    some = bool(wide.limit(1).collect())
    # dealt anew in each bucket, so that the parts of one bucket's lines meet in another
    home = F.pmod(F.xxhash64("h", "bucket"), F.col("parts"))
    dealt = members.join(wide, "bucket", "left").withColumn("part", F.coalesce(home, F.lit(0).cast("long"))) if some else members.withColumn("part", F.lit(0).cast("long"))
    edges = links(dealt.withColumn("side", F.lit(-1)).withColumn("comp", F.col("h")))
    found = components(edges)
    if not some:
        for t in (edges, wide):
            forget(t)
        return found
    own = found.select(F.col("node").alias("h"), "component")
    rows = written(members.join(wide, "bucket").join(own, "h", "left").withColumn("comp", F.coalesce("component", "h")).drop("component"))
    sizes = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all")).where("main.n < all")
    # visitors come in runs of about WIDE, too
    main = written(main.select("bucket", F.col("main.comp").alias("main"), F.ceil((F.col("all") - F.col("main.n")) / WIDE).alias("runs")))
    rows = rows.join(main, "bucket").withColumn("home", home)
    run = F.pmod(F.xxhash64("bucket", "h"), F.col("runs"))
    at_home = rows.withColumn("side", F.lit(0)).withColumn("to", F.col("home")).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)))
    away = rows.where("comp != main").withColumn("side", F.lit(1)).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("to != home").withColumn("run", run)
    more = links(at_home.unionByName(away).withColumn("part", F.col("to") * F.col("runs") + F.col("run")))
    for t in (found, wide, main):
        forget(t)
    return components(edges.union(more))


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences, groups): every line with words as (doc_id, th, line, h), and (h, group, n, first) of each distinct line that is repeated or linked."""
    lines = written(_lines(docs))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "line")
    kinds = written(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), *[F.first(c).alias(c) for c in ("sim", "chars", "signs", "signs2")]))
    # ten small rows a line are dealt once by their key, many together; only lines with a near partner go on
    tags = kinds.where(F.col("chars") >= LEAST_CHARS).select("sim", "chars", "signs", "signs2")
    parts = max(PARTS, -(-len(PAIRS) * kinds.count() // PART_ROWS))
    dealt = tags.mapInArrow(_dealt(parts), "part long, rows binary").repartition("part").sortWithinPartitions("part")
    met = written(dealt.mapInArrow(_met, "bucket long, sim long").distinct())
    near_lines = written(kinds.join(met.select("sim").distinct(), "sim").select("h", "n", "first", "sim", "chars"))
    texts = _texts(docs, near_lines.select("h", "first"))
    members = written(met.join(near_lines, "sim").select("bucket", "h", "sim", "chars").join(texts, "h"))
    found = _components(members)
    for t in (met, members):
        forget(t)
    told = lambda some, how: some.join(found, some.h == found.node, how).select("h", F.coalesce("component", "h").alias("group"), "n", "first")
    return lines, written(told(kinds.where("n > 1"), "left").union(told(near_lines.where("n = 1"), "inner")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with one occurrence of each group of alike lines left in the whole table.

    ``docs``: (doc_id, text, ...). Lines end at line feeds. A line is normalised (A-Z lower-cased, digits as 0, runs of
    other ASCII signs as one space); equal normalised lines are one group, and so are lines whose normalised texts have an
    edit similarity of at least ``SIMILARITY`` and whose block SimHashes (of their words; of pairs of their bytes in lines
    of under ``FEW_WORDS`` words) agree in two of five blocks and differ in at most ``DISTANCE`` bits, with all that such links
    connect. Of each group the occurrence with
    the smallest (doc_id, text hash, line number) stays, null ids last; all other lines of the group are taken out with their line feeds.
    Lines without a word always stay.

    Returns all columns of ``docs``, text replaced, a row for each row; a document that loses all lines has an empty
    text. A null text stays null. Rows that repeat (doc_id, text) are one document read twice: they keep the same lines.
    An empty table gives an empty result. A column n_chars, if there is one, is set to the new length.
    """
    session(docs)
    lines, group = groups(docs)
    # tables of their own, so that the joins after them can be dealt anew where one group or line is very common
    big = written(group.groupBy("group").agg(F.sum("n").alias("size"), F.min("first").alias("kept")).where("size > 1"))
    kept = written(group.join(big, "group").select("h", "kept"))
    drop = lines.join(kept, "h")
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("th") == F.col("kept.th")) & (F.col("line") == F.col("kept.line"))
    drop = drop.where(~same).groupBy(F.col("doc_id").alias("_ld"), F.col("th").alias("_lt")).agg(F.collect_set(F.col("line").cast("int")).alias("_lines"))
    parts = F.split("text", "\n")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_lines", i)), "\n")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("th"), "text")
    out = rows.join(drop, rows.doc_id.eqNullSafe(drop._ld) & (rows.th == drop._lt), "left")
    out = out.select("row", "_lines", F.when(F.col("_lines").isNull() | F.col("text").isNull(), F.col("text")).otherwise(left).alias("text"))

    def column(c: str) -> Column:
        if c == "n_chars":
            new = F.when(F.col("_lines").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema[c].dataType)
        else:
            new = F.col("text") if c == "text" else F.col("row").getField(c)
        return new.alias(c)

    return out.select(*[column(c) for c in docs.columns])
