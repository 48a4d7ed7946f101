"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF word shingles."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeview.llm.common import byte_chunks, forget, session, summed, text_of, written
from rangeview.llm.groups import linked, meeting
from rangeview.llm.vec import U, mix, shingles, word_hashes

SIZE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
#: Shingles are hashed to so many buckets for document frequencies.
DF_BITS = 18
#: A shingle in under 1/20 of the documents has weight 1, one in over a third 0.37; between, the logarithm decides.
COMMON, VERY_COMMON = 1 / 20, 1 / 3
_ID_BITS = 44

_GRID = (np.arange(1 << 16) + 0.5) / (1 << 16)


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) on the grid, by Newton steps on 1 - (1 + x) exp(-x)."""
    x = np.sqrt(2 * _GRID) + _GRID
    for _ in range(60):
        e = np.exp(-x)
        x = np.maximum(x - (1 - (1 + x) * e - _GRID) / np.maximum(x * e, 1e-12), x / 2)
    return x


_R = _gamma_quantiles().astype(np.float32)
_LOG_C = np.log(_gamma_quantiles()).astype(np.float32)


def _bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted unique (row, shingle) keys of the rows, and how often each occurs."""
    n = shingles(*word_hashes(data, offsets), SIZE)
    key = np.repeat(np.arange(len(n[1])), n[1]).astype(np.uint64) << U(_ID_BITS) | n[0] >> U(64 - _ID_BITS)
    return np.unique(key, return_counts=True)


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key >> U(_ID_BITS - DF_BITS)).astype(np.int64) & ((1 << DF_BITS) - 1)


def document_frequency(docs: DataFrame) -> np.ndarray:
    """In how many texts each shingle bucket occurs, over all whole texts, and the number of texts."""
    session(docs)

    def frequency(batches):
        total = np.zeros((1 << DF_BITS) + 1)
        for b in batches:
            for lo, hi, data, offsets in byte_chunks(b.column(0)):
                key, _ = _bags(data, offsets)
                v = key >> U(_ID_BITS - DF_BITS)
                v = v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v
                total[:-1] += np.bincount(v.astype(np.int64) & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
                total[-1] += hi - lo
        return total

    return summed(docs.select(text_of().alias("text")), frequency, (1 << DF_BITS) + 1)


def idf_weights(docs: DataFrame) -> np.ndarray:
    """The weight of every shingle bucket from its document frequency over all whole texts.

    ln(1 / share of documents), between those of ``COMMON`` and ``VERY_COMMON``, over the largest. A text has some hundred
    of the 2^18 buckets, so the frequency of a bucket is that of its one common shingle but for a share of about
    shingles a text / 2^18, at any size of the input. Only text that many documents share is weighted down.
    """
    df = document_frequency(docs)
    share = np.clip(df[:-1] / max(df[-1], 1), COMMON, VERY_COMMON)
    return (np.log(1 / share) / math.log(1 / COMMON)).astype(np.float32)


def signatures(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, BANDS band hashes of each): improved consistent weighted sampling.

    For sample k a shingle s of weight w draws r and c from Gamma(2, 1) and b from (0, 1) by hash; t = floor(ln w / r + b),
    ln a = ln c - r (t - b + 1); the sample is (s, t) of the smallest a. Two texts share a sample with a probability
    equal to their weighted Jaccard similarity.
    """
    key, tf = _bags(data, offsets)
    if not len(key):
        return np.zeros(0, np.int64), np.zeros((0, BANDS), np.uint64)
    row, first, counts = np.unique(key >> U(_ID_BITS), return_index=True, return_counts=True)
    ids = key & U((1 << _ID_BITS) - 1)
    log_w = np.log(tf * weights[_bucket(key)]).astype(np.float32)
    out = np.empty((len(row), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        h = mix(ids + U((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r = _R[(h & U(0xFFFF)).astype(np.intp)]
        b = ((h >> U(32)) & U(0xFFFF)).astype(np.float32) * np.float32(2**-16)
        t = np.floor(log_w / r + b)
        a = _LOG_C[((h >> U(16)) & U(0xFFFF)).astype(np.intp)] - r * (t - b + 1)
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), counts))
        at = least[np.searchsorted(least, first)]
        sample = mix(ids[at] * U(0xD6E8FEB86659FD93) + t[at].astype(np.int64).view(np.uint64))
        band = k // ROWS
        out[:, band] = sample if k % ROWS == 0 else mix(out[:, band] * U(0x9E3779B97F4A7C15) + sample)
    return row.astype(np.int64), out


def prefixes(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, df: np.ndarray, threshold: float):
    """(row, shingle, total weight of the row, weight of the shingle and all after it) of the rarest shingles of each row.

    A row's shingles are ordered by ``df`` and, within it, by their hash: one order for all rows. Two rows of similarity
    >= threshold have at least threshold / (1 + threshold) of their joint weight in common, so the first shingle in that
    order that both have lies, in each, before the rest falls under threshold times the row's weight.
    """
    key, tf = _bags(data, offsets)
    ids, row, w = key & U((1 << _ID_BITS) - 1), (key >> U(_ID_BITS)).astype(np.int64), tf * weights[_bucket(key)].astype(np.float64)
    order = np.lexsort((ids, df[_bucket(key)], row))
    ids, row, w = ids[order], row[order], w[order]
    total = np.bincount(row, w, len(offsets) - 1)[row] if len(row) else w
    upto = np.cumsum(w) - w
    rest = total - (upto - upto[np.searchsorted(row, row, "left")]) if len(row) else w
    keep = rest >= total * threshold - 1e-6
    return row[keep], ids[keep], total[keep], rest[keep]


def similarity(left: tuple, right: tuple, weights: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of row i of ``left`` and row i of ``right``, each (bytes, offsets)."""
    n = len(left[1]) - 1
    (ka, ta), (kb, tb) = _bags(*left), _bags(*right)
    row = lambda key: (key >> U(_ID_BITS)).astype(np.int64)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.bincount(row(ka[ia]), np.minimum(ta[ia], tb[ib]) * weights[_bucket(ka[ia])], n)
    total = np.bincount(row(ka), ta * weights[_bucket(ka)], n) + np.bincount(row(kb), tb * weights[_bucket(kb)], n)
    return both / np.maximum(total - both, 1e-12)


def near_groups(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(node, component) of text ids (xxhash64 of the text): linked are texts of weighted Jaccard similarity >= threshold that share a band."""
    spark = session(docs)
    base = docs.select(F.xxhash64(text_of()).alias("id"), text_of().alias("text"))
    weights = spark.sparkContext.broadcast(idf_weights(docs))

    def sign(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, _, data, offsets in byte_chunks(b.column(1)):
                row, bands = signatures(data, offsets, weights.value)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo + row], BANDS)), pa.array(np.tile(np.arange(BANDS), len(row)).astype(np.int64) + (bands.view(np.int64).ravel() & ~np.int64(15)))], names=["id", "bucket"])

    members = written(base.mapInArrow(sign, "id long, bucket long").groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("weight")))
    shared = meeting(members.select("bucket", "id", "weight", F.lit(0).alias("sig")))
    forget(members)
    wanted = shared.select("id").distinct()
    texts = written(base.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")))

    def narrow(left: DataFrame) -> tuple[DataFrame, Callable]:
        """Buckets of one rare shingle each: texts that are linked share one of the rarest of both."""
        own = texts.join(left, "id", "left_semi")
        rare = spark.sparkContext.broadcast(document_frequency(own))

        def run(batches):
            for b in batches:
                ids = b.column(0).to_numpy()
                for lo, _, data, offsets in byte_chunks(b.column(1)):
                    row, shingle, total, rest = prefixes(data, offsets, weights.value, rare.value, threshold)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(ids[lo + row]), pa.array(total), pa.array(rest)], names=["bucket", "id", "total", "rest"])

        rows = own.select("id", "text").mapInArrow(run, "bucket long, id long, total double, rest double")
        return rows.select("bucket", "id", F.struct("total", "rest").alias("sig")), lambda a, b: F.least(a.rest, b.rest) >= (a.total + b.total) * (threshold / (1 + threshold)) - 1e-6

    def verify(pairs: DataFrame) -> DataFrame:
        # a head's text goes out once to many pairs while they are small; the join after it is dealt by the other, even side
        one = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        two = one.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

        def check(batches):
            for b in batches:
                for k in range(0, b.num_rows, 64):
                    part = b.slice(k, 64)
                    sides = []
                    for c in (2, 3):
                        chunks = list(byte_chunks(part.column(c), 1 << 62))
                        sides.append((chunks[0][2], chunks[0][3]))
                    yield part.select(["a", "b"]).filter(pa.array(similarity(*sides, weights.value) >= threshold - 1e-9))

        return two.mapInArrow(check, "a long, b long")

    found = linked(shared, verify, narrow=narrow)
    forget(shared)
    forget(texts)
    return found


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The class of near-duplicates of each row of ``docs`` (doc_id, text).

    Shingles are runs of five words (runs of letters and digits, ASCII letters lower-cased; a shorter text is one
    shingle), weighted by term frequency times inverse document frequency. Texts that share one of ``BANDS`` bands of
    ``ROWS`` samples are held against each other by exact weighted Jaccard similarity; links of ``threshold`` or more
    connect classes. A pair at 0.8 shares no band with a probability of 0.0002. Equal texts are one class, whatever they
    are, so all empty and null texts are one class, and texts without words are in one only with equal ones.

    Returns (doc_id, class_id, class_size), a row for each row; class_id is the smallest doc_id of the class (null if it
    has none). Repeated rows are in one class; an empty table gives an empty result; other columns are not looked at.
    """
    own = docs.select("doc_id", F.xxhash64(text_of()).alias("id"))
    found = near_groups(docs, threshold)
    at = own.join(found, own.id == found.node, "left").select("doc_id", F.coalesce("component", "id").alias("c"))
    # a table of its own, so that the join after it can be dealt anew where one class is very large
    sizes = written(at.groupBy("c").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    return at.join(sizes, "c").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The row with the smallest doc_id of each class, with all columns; of equal (doc_id, text) any one, null ids last."""
    key = F.xxhash64(text_of())
    own = docs.select("doc_id", key.alias("id"))
    found = near_groups(docs, threshold)
    at = own.join(found, own.id == found.node, "left").groupBy(F.coalesce("component", "id").alias("c"), "doc_id", "id").agg(F.count(F.lit(1)).alias("n"))
    best = at.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "n")).alias("w"))
    best = written(best.select(F.col("w.doc_id").alias("_kd"), F.col("w.id").alias("_ki"), F.col("w.n").alias("_kn")))
    kept = lambda w: docs.join(w, docs.doc_id.eqNullSafe(w._kd) & (key == w._ki), "left_semi")
    if not best.where("_kn > 1").limit(1).collect():
        return kept(best)
    return kept(best.where("_kn = 1")).union(kept(best.where("_kn > 1")).dropDuplicates(["doc_id", "text"]))
