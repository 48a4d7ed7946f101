"""Toxicity of texts that hide words behind leetspeak, spacing and repetition: a noisy channel, then a classifier."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeview.llm.common import byte_chunks, session, summed, text_of
from rangeview.llm.vec import U, mix, powers, prefix_hash, span_hash, words

#: Labelled documents that the classifier is fitted on, at most; those with the smallest hash of their doc_id.
MAX_LABELLED = 20_000
FEATURE_BITS = 20
MAX_FEATURES = 4096

# What a sign may stand for in obfuscated writing, by sign.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "{": "c", "&": "a", "#": "h", "%": "x",
}
#: Signs that may stand between letters and mean nothing.
FILL = " .-_*~'\"^`,;:/\\=)>}[]" + "".join(LEET)
SUBSTITUTE, DROP, DROP_LETTERLIKE, REPEAT = math.log(0.15), math.log(0.02), math.log(0.0005), math.log(0.3)

#: Characters of the language model: 0 the edge of a word, 1 to 26 the letters, 27 every other letter, 28 anything else.
SYMBOLS = 29
_CLASS = np.full(256, 28, np.uint8)
for _b in range(256):
    if _b in (9, 10, 11, 12, 13, 32):
        _CLASS[_b] = 0
    elif 97 <= _b | 32 <= 122 and _b < 128:
        _CLASS[_b] = (_b | 32) - 96
    elif _b >= 128:
        _CLASS[_b] = 27
#: Letters, lower case; every other byte parts words.
_LETTERS = np.zeros(256, np.uint8)
for _b in range(256):
    _LETTERS[_b] = (_b | 32) if _CLASS[_b] in range(1, 27) else _b if _b >= 128 else 0
#: 1 letters, 2 signs and digits that can hide a letter or stand between letters, 0 blanks.
_KIND = np.where(_CLASS == 0, 0, np.where(_CLASS == 28, 2, 1)).astype(np.uint8)


def char_counts(batches) -> np.ndarray:
    """Trigram counts of the characters of all words; each word is preceded by two edges and followed by one."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for b in batches:
        for _, _, data, offsets in byte_chunks(b.column(0)):
            c = _CLASS[data]
            c[c == 28] = 0  # signs end words here
            c = np.concatenate([[0, 0], c, [0]]).astype(np.int32)
            keep = (c[2:] != 0) | (c[1:-1] != 0)
            p2 = np.where(c[1:-1] == 0, 0, c[:-2])
            total += np.bincount(((p2 * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:])[keep], minlength=SYMBOLS**3)
    return total


def char_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b): trigrams leaning on bigrams leaning on single characters."""
    t = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    b = t.sum(0)
    one = (b.sum(0) + 0.5) / (b.sum() + 0.5 * SYMBOLS)
    two = (b + 5 * one) / (b.sum(1, keepdims=True) + 5)
    return np.log((t + 5 * two[None]) / (t.sum(2, keepdims=True) + 5))


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest letters behind a token: Viterbi over the lattice of what each sign can stand for.

    A letter stands for itself, or, next to the same letter, for nothing; a sign for the letters of ``LEET`` or for
    nothing. A path's weight is the channel's cost plus the language model's; states are the last two letters.
    """
    token = token.lower()
    best: dict[tuple[str, str], tuple[float, str]] = {("", ""): (0.0, "")}
    at = lambda c: 0 if c == "" else ord(c) - 96 if "a" <= c <= "z" else 27
    for place, c in enumerate(token):
        letter = c.isalpha()
        options = [(c, 0.0)] if letter else [(x, SUBSTITUTE) for x in LEET.get(c, "")]
        drop = REPEAT if letter and place and token[place - 1] == c else None if letter else DROP_LETTERLIKE if c.isdigit() or c in "@$" else DROP
        new: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (weight, out) in best.items():
            for x, cost in options:
                w = weight + cost + model[at(a)][at(b)][at(x)]
                if (b, x) not in new or (w, out + x) > new[b, x]:
                    new[b, x] = w, out + x
            if drop is not None and (not letter or b == c):
                w = weight + drop
                if (a, b) not in new or (w, out) > new[a, b]:
                    new[a, b] = w, out
        best = new or {k: (w + DROP, out) for k, (w, out) in best.items()}
    return max((w + model[at(a)][at(b)][0], out) for (a, b), (w, out) in best.items())[1]


_SIGNS = re.escape("".join(LEET))
_SPACED = re.compile(rf"(?<!\S)(?:(?:[^\W\d_]|[{_SIGNS}])[ .\-_*]){{2,}}(?:[^\W\d_]|[{_SIGNS}])(?!\w)")
_TOKEN = re.compile(r"\S+")
_HEAD, _TAIL, _RUN = re.compile(rf"[^\w{_SIGNS}]*"), re.compile(rf"[^\w{_SIGNS}]*$"), re.compile(r"(.)\1\1")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def restore(text: str, model, cache: dict[str, str] | None = None) -> str:
    """The text with spelled-out, repeated and disguised words decoded; other words, blanks and marks stay.

    Every token that holds a letter beside a sign or digit is decoded, signs at its ends included; where the likeliest
    reading only drops signs at the ends, they are marks and the token stays. Spelled out are runs of four single
    characters, letters or signs of ``LEET`` and at least one letter, and of three if one of them is such a sign.
    """
    cache = {} if cache is None else cache

    def read(core: str) -> str:
        if core not in cache:
            if len(cache) > 200_000:
                cache.clear()
            cache[core] = decode(core, model)
        return cache[core]

    def word(token: str) -> str:
        if token.isalpha() and not _RUN.search(token):
            return token
        head = _HEAD.match(token)[0]
        tail = _TAIL.search(token, len(head))[0]
        core = token[len(head) : len(token) - len(tail)]
        odd = not core.isalpha()
        if odd and not any(c.isalpha() for c in core) or not odd and not _RUN.search(core):
            return token
        out = read(core)
        if odd and out == _EDGE.sub("", core).lower():
            return token
        return head + out + tail

    def spaced(m: re.Match) -> str:
        run = re.sub(r"[ .\-_*]", "", m[0])
        letters = sum(c.isalpha() for c in run)
        return m[0] if not letters or len(run) == letters == 3 else read(run)

    return _TOKEN.sub(lambda m: word(m[0]), _SPACED.sub(spaced, text))


_LEET_BYTE, _PART_BYTE, _GAP_BYTE = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in ("".join(LEET).encode() + b"_", b" .-_*", b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "))


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that restore() may change, none left out.

    These hold a sign of ``LEET`` or a low line in one token with a letter, another sign between letters, a letter three
    times, three single characters in a row, or any byte beyond ASCII.
    """
    kind, low = _KIND[data], _LETTERS[data]
    n = len(data)
    odd = data >= 128
    leet, gap = _LEET_BYTE[data], _GAP_BYTE[data]
    token = np.cumsum(kind == 0)
    lettered = np.zeros(int(token[-1]) + 1 if n else 1, bool)
    lettered[token[kind == 1]] = True
    odd |= leet & lettered[token]
    if n > 2:
        sign = kind == 2
        odd[1:-1] |= sign[1:-1] & (kind[:-2] != 0) & (kind[2:] != 0) & ((kind[:-2] == 1) | (kind[2:] == 1))
        odd[2:] |= (low[2:] != 0) & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    if n > 4:
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        item, part = (kind == 1) | leet, _PART_BYTE[data]
        begins = edge[:-1] | np.concatenate([[True], gap[:-1]])
        ends = edge[1:] | np.concatenate([kind[1:] != 1, [True]])
        odd[:-4] |= begins[:-4] & item[:-4] & part[1:-3] & item[2:-2] & part[3:-1] & item[4:] & ends[4:]
    rows = np.zeros(len(offsets) - 1, bool)
    rows[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
    return rows


def _restored(texts: pa.Array, model: np.ndarray, cache: dict):
    """(first row, bytes, offsets) like byte_chunks, of the restored texts."""
    model = model.tolist()  # plain lists are read faster than single numbers of an array
    for lo, hi, data, offsets in byte_chunks(texts):
        rows = np.flatnonzero(_suspects(data, offsets)) if len(data) else []
        if len(rows):
            raw = data.tobytes()
            parts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            for r in rows:
                parts[r] = restore(parts[r].decode(), model, cache).encode()
            data = np.frombuffer(b"".join(parts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        yield lo, data, offsets


def _features(data: np.ndarray, offsets: np.ndarray):
    """(buckets, places) for whole words and for runs of 3, 4 and 5 letters at a word's start and anywhere in it."""
    low = _LETTERS[data]
    starts, ends, _ = words(low, offsets)
    h = prefix_hash(low)
    shift = U(64 - FEATURE_BITS)
    yield span_hash(h, starts, ends) >> shift, starts
    inverse = powers(len(h))[1]
    inside = np.concatenate([[0], np.cumsum(low == 0)])
    first = np.zeros(len(low), bool)
    first[starts] = True
    for n in (3, 4, 5):
        at = np.flatnonzero(inside[n:] == inside[:-n]) if len(low) >= n else np.zeros(0, np.int64)
        raw = (h[at + n] - h[at]) * inverse[at]
        yield mix(raw + U(n)) >> shift, at
        begin = first[at]
        yield mix(raw[begin] + U(64 + n)) >> shift, at[begin]


@dataclass
class Model:
    """chars: the language model; place: feature bucket to weight's place or -1; weights, bias: of the logistic model."""

    chars: np.ndarray
    place: np.ndarray
    weights: np.ndarray
    bias: float


def _present(data, offsets, place):
    """Unique (row, feature place) of the chosen features that occur; a run that crosses two rows does not count."""
    rows, cols = [], []
    for buckets, at in _features(data, offsets):
        p = place[buckets]
        hit = np.flatnonzero(p >= 0)
        rows.append(np.searchsorted(offsets, at[hit], "right") - 1)
        cols.append(p[hit].astype(np.int64))
    key = np.unique(np.concatenate(rows) * MAX_FEATURES + np.concatenate(cols))
    return key // MAX_FEATURES, key % MAX_FEATURES


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit the channel's language model on all ``docs`` (doc_id, text) and the classifier on ``labels`` (doc_id, toxic).

    The language model counts character trigrams of every whole text. The classifier learns from at most
    ``max_labelled`` labelled documents (smallest xxhash64 of the doc_id): hashed words and letter runs that differ most
    between the classes are kept, and a ridge-penalised logistic regression is fitted to which of them occur.
    Labels other than 0 and 1, null ids and ids without a document are left out; without both classes every score is
    the smoothed share of label 1.
    """
    spark = session(docs)
    chars = char_model(summed(docs.select(text_of().alias("text")), char_counts, SYMBOLS**3))
    picked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toPandas()
    ids, toxic = picked.doc_id.to_numpy(np.int64), picked.toxic.to_numpy(np.int64)
    order = np.argsort(ids)
    shared = spark.sparkContext.broadcast((ids[order], toxic[order], chars))
    known = spark.createDataFrame([(int(i),) for i in ids], "doc_id long")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(known), "doc_id", "left_semi")
    n = 1 << FEATURE_BITS

    def by_class(batches):
        ids, toxic, chars = shared.value
        total, cache = np.zeros(2 * n + 2), {}
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            y = toxic[np.searchsorted(ids, doc)]
            for lo, data, offsets in _restored(b.column(1), chars, cache):
                rows = y[lo : lo + len(offsets) - 1]
                total[2 * n :] += np.bincount(rows, minlength=2)
                keys = [(np.searchsorted(offsets, at, "right") - 1).astype(np.int64) << FEATURE_BITS | bucket.astype(np.int64) for bucket, at in _features(data, offsets)]
                key = np.unique(np.concatenate(keys))
                total[: 2 * n] += np.bincount(rows[key >> FEATURE_BITS] * n + (key & (n - 1)), minlength=2 * n)
        return total

    counts = summed(sample, by_class, 2 * n + 2) if len(ids) else np.zeros(2 * n + 2)
    negative, positive = counts[2 * n :]
    a, b = counts[n : 2 * n], counts[:n]
    if not positive or not negative:
        return Model(chars, np.full(n, -1, np.int16), np.zeros(1), math.log((positive + 1) / (negative + 1)))
    p, q = (a + 0.5) / (positive + 1), (b + 0.5) / (negative + 1)
    mean = (a + b + 1) / (positive + negative + 2)
    z = np.where(a + b >= 3, np.abs(p - q) / np.sqrt(mean * (1 - mean) * (1 / positive + 1 / negative)), 0)
    chosen = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    chosen = chosen[z[chosen] > 3]
    place = np.full(n, -1, np.int16)
    place[chosen] = np.arange(len(chosen))
    wide = spark.sparkContext.broadcast(place)

    def rows(batches):
        ids, toxic, chars = shared.value
        cache = {}
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            y = toxic[np.searchsorted(ids, doc)]
            for lo, data, offsets in _restored(b.column(1), chars, cache):
                r, c = _present(data, offsets, wide.value)
                m = len(offsets) - 1
                cuts = np.searchsorted(r, np.arange(m + 1))
                yield pa.RecordBatch.from_pydict({"y": pa.array(y[lo : lo + m], pa.int32()), "f": pa.array([c[s:e].astype("<i2").tobytes() for s, e in zip(cuts[:-1], cuts[1:])], pa.binary())})

    got = sample.mapInArrow(rows, "y int, f binary").toPandas()
    weights, bias = _logistic([np.frombuffer(f, "<i2") for f in got.f], got.y.to_numpy(np.float64), len(chosen))
    return Model(chars, place, weights, bias)


def _logistic(rows: list[np.ndarray], y: np.ndarray, n: int, ridge: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of the ridge-penalised logistic regression; accelerated gradient steps, scaled by feature counts."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    n = max(n, 1)
    w, b = np.zeros(n), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    sw, sb = np.full(n, 1e-6), 1e-6
    for _ in range(steps):
        score = np.bincount(at, w[col], len(y)) + b
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        gw, gb = np.bincount(col, error[at], n) + ridge * w, error.sum()
        sw += gw * gw
        sb += gb * gb
        w -= 0.5 * gw / np.sqrt(sw)
        b -= 0.5 * gb / math.sqrt(sb)
    return w, b


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a double column ``name``, the probability of label 1 for each row's whole restored text.

    Only the column text is looked at; null is empty; all other columns pass through. An empty text has the score of
    the bias alone. Repeated rows score alike; an empty table gives an empty result.
    """
    spark = session(docs)
    shared = spark.sparkContext.broadcast(model)
    text = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        m, cache = shared.value, {}
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, data, offsets in _restored(b.column(text), m.chars, cache):
                r, c = _present(data, offsets, m.place)
                out[lo : lo + len(offsets) - 1] = np.bincount(r, m.weights[c], len(offsets) - 1) + m.bias
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -700, 700))))], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", remainder: int = 0):
    """Whether crc32 of the doc_id as text, modulo 5, is ``remainder``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5) == remainder
