"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rangeview.llm.common import byte_chunks, session, text_of
from rangeview.llm.vec import SHINGLE, U, mix, word_hashes

#: Words a tile has at least; an item of fewer words must be found whole.
MIN_TILE = 5
#: Words of benchmark text that are held against the documents in one pass; a larger benchmark takes several.
BLOCK_WORDS = 2_000_000


def windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` tokens."""
    n = max(len(tokens) - size + 1, 0)
    out, factor = np.zeros(n, np.uint64), 1
    for k in range(size):
        out += tokens[k : k + n] * U(factor)
        factor = factor * int(SHINGLE) & 0xFFFFFFFFFFFFFFFF
    return mix(out)


def tiles(item: np.ndarray, doc: np.ndarray, size: int, seeds: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length) of matches of at least ``size`` tokens, longest first.

    The longest match of tokens that no tile has marked becomes a tile, again and again; of equally long ones the first in
    the item, then the first in the document. A match that a tile cuts goes back as its unmarked rest.
    """
    if seeds is None:
        a, b = windows(item, size), windows(doc, size)
        order = np.argsort(a, kind="stable")
        lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
        at = np.repeat(np.arange(len(b)), hi - lo)
        seeds = order[np.arange(len(at)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)], at
    i, j = seeds
    if not len(i):
        return []
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    breaks = np.flatnonzero((np.diff(i) != 1) | (np.diff(j - i) != 0)) + 1
    firsts = np.concatenate([[0], breaks])
    lengths = np.diff(np.concatenate([firsts, [len(i)]])) + size - 1
    heap = [(-int(n), int(p), int(q)) for n, p, q in zip(lengths, i[firsts], j[firsts])]
    heapq.heapify(heap)
    in_item, in_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, p, q = heapq.heappop(heap)
        marked = in_item[p : p - n] | in_doc[q : q - n]
        if not marked.any():
            in_item[p : p - n] = in_doc[q : q - n] = True
            out.append((p, q, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]]).astype(np.int8)))
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s >= size:
                heapq.heappush(heap, (-int(e - s), p + int(s), q + int(s)))
    return out


def _blocks(benchmark: DataFrame, block_words: int):
    """The benchmark's items as (item_id, token hashes), in blocks of bounded size, one at a time on the driver."""
    block, held = [], 0
    for row in benchmark.select("item_id", text_of().alias("text")).toLocalIterator():
        raw = np.frombuffer(row.text.encode(), np.uint8)
        tokens, _ = word_hashes(raw, np.array([0, len(raw)]))
        if len(tokens):
            block.append((row.item_id, tokens))
            held += len(tokens)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def _index(block, min_tile: int):
    """Sorted seed hashes with their items and places. An item's seeds have min_tile tokens, or all it has, if fewer."""
    by_size: dict[int, list] = {}
    for k, (_, tokens) in enumerate(block):
        size = min(min_tile, len(tokens))
        w = windows(tokens, size)
        by_size.setdefault(size, []).append((w, np.full(len(w), k), np.arange(len(w))))
    out = {}
    for size, parts in by_size.items():
        h, item, place = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        out[size] = h[order], item[order], place[order]
    return out


def _found(data, offsets, block, index, min_tile, threshold):
    """(document, item, covered, tiles) for each pair whose tiles cover enough of the item."""
    tokens, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    pairs: dict[tuple[int, int], list] = {}
    for size, (h, item, place) in index.items():
        if len(tokens) < size:
            continue
        w = windows(tokens, size)
        lo = np.searchsorted(h, w, "left")
        hit = np.flatnonzero(h[np.minimum(lo, len(h) - 1)] == w)
        doc = np.searchsorted(ends, hit, "right")
        keep = hit + size <= ends[doc]
        hit, doc = hit[keep], doc[keep]
        for at, d in zip(hit.tolist(), doc.tolist()):
            k = int(lo[at])
            while k < len(h) and h[k] == w[at]:
                pairs.setdefault((d, int(item[k])), []).append((int(place[k]), at - int(ends[d] - counts[d])))
                k += 1
    for (d, k), seeds in sorted(pairs.items()):
        item = block[k][1]
        size = min(min_tile, len(item))
        if len({s for s, _ in seeds}) + size - 1 < threshold * len(item) and len(seeds) * size < threshold * len(item):
            continue
        s = np.array(seeds)
        got = tiles(item, tokens[ends[d] - counts[d] : ends[d]], size, (s[:, 0], s[:, 1]))
        covered = sum(n for _, _, n in got)
        if covered >= threshold * len(item):
            yield d, k, covered, got


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_tile: int = MIN_TILE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold a benchmark item, whole, in pieces or reordered.

    ``docs``: (doc_id, text); ``benchmark``: (item_id, text). Words are lower-case runs of letters and digits. Runs of
    ``min_tile`` words that a document shares with an item are joined as seeds; greedy string tiling marks the longest
    non-overlapping matches; if the tiles cover at least ``threshold`` of the item's words, it leaks. The benchmark is
    a stated query set: it is broadcast in blocks of about ``block_words`` words, and each block scans the documents.

    Returns (doc_id, item_id, covered, item_words, coverage, n_tiles) for each leaking pair of rows. Null and empty
    texts leak nothing and match nothing; ids keep their types, null ids stay null; repeated rows repeat; empty tables give an empty
    result; other columns are not looked at.
    """
    spark = session(docs)
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = docs.select("doc_id").schema.add("item_id", benchmark.schema["item_id"].dataType).add("covered", "long").add("item_words", "long").add("coverage", "double").add("n_tiles", "long")
    out = None
    for block in _blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast((block, _index(block, min_tile)))

        def scan(batches, shared=shared):
            items, index = shared.value
            for b in batches:
                ids = b.column(0)
                for lo, hi, data, offsets in byte_chunks(b.column(1)):
                    got = [(lo + d, k, c, t) for d, k, c, t in _found(data, offsets, items, index, min_tile, threshold)]
                    if got:
                        rows = ids.take(pa.array([g[0] for g in got]))
                        yield pa.RecordBatch.from_arrays(
                            [rows, pa.array([items[g[1]][0] for g in got], item_type), pa.array([g[2] for g in got], pa.int64()), pa.array([len(items[g[1]][1]) for g in got], pa.int64()), pa.array([g[2] / len(items[g[1]][1]) for g in got], pa.float64()), pa.array([len(g[3]) for g in got], pa.int64())],
                            names=["doc_id", "item_id", "covered", "item_words", "coverage", "n_tiles"],
                        )

        part = docs.select("doc_id", text_of().alias("text")).mapInArrow(scan, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_tile: int = MIN_TILE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; see ``leaks``."""
    spark = session(docs)
    text = docs.columns.index("text")
    for block in _blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast((block, _index(block, min_tile)))

        def keep(batches, shared=shared):
            items, index = shared.value
            for b in batches:
                bad = np.zeros(b.num_rows, bool)
                for lo, hi, data, offsets in byte_chunks(b.column(text)):
                    for d, _, _, _ in _found(data, offsets, items, index, min_tile, threshold):
                        bad[lo + d] = True
                yield b.filter(pa.array(~bad))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
