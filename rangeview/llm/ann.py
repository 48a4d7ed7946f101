"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rangeview.llm.common import session, written

#: Vectors that the trees are fitted on, at most, chosen by hash. Every vector is indexed.
SAMPLE = 65_536
#: Vectors of the sample in a leaf, at most; a leaf of all rows holds this times rows / sample.
LEAF = 64
TREES = 8
#: Leaves that a query looks at, over all trees.
PROBES = 640
#: Vectors that one group of the search holds, about: whole leaves of a tree, or a part of a larger leaf.
GROUP = 8192


@dataclass
class Forest:
    """directions: (tree, level, dim); cuts[level]: (tree, 2^level) medians of the nodes of a level."""

    directions: np.ndarray
    cuts: list[np.ndarray]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree."""
        trees = np.arange(len(self.directions))
        node = np.zeros((len(x), len(trees)), np.int64)
        for level, cut in enumerate(self.cuts):
            side = x @ self.directions[:, level].T >= cut[trees, node]
            node = 2 * node + side
        return node

    def probes(self, q: np.ndarray, n: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs that one queue over all trees yields first: always the branch with the nearest cut."""
        shift = np.einsum("tld,d->tl", self.directions, q)
        heap, out = [(0.0, t, 0, 0) for t in range(len(self.directions))], []
        while heap and len(out) < n:
            margin, t, level, node = heapq.heappop(heap)
            while level < len(self.cuts):
                d = float(shift[t, level] - self.cuts[level][t, node])
                heapq.heappush(heap, (max(margin, abs(d)), t, level + 1, 2 * node + (d < 0)))
                node, level = 2 * node + (d >= 0), level + 1
            out.append((t, node))
        return out


def grow(sample: np.ndarray, trees: int, leaf: int, seed: int = 7) -> Forest:
    """Trees of one random direction a level, cut at the medians of the nodes, until leaves hold at most ``leaf``."""
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.ceil(np.log2(max(len(sample), 1) / leaf))))
    directions = rng.standard_normal((trees, depth, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True) if depth else 1
    node, cuts = np.zeros((len(sample), trees), np.int64), []
    for level in range(depth):
        at = sample @ directions[:, level].T
        cut = np.zeros((trees, 1 << level))
        for t in range(trees):
            order = np.lexsort((at[:, t], node[:, t]))
            v, first = at[order, t], np.searchsorted(node[order, t], np.arange((1 << level) + 1))
            lo, hi = first[:-1], first[1:]
            full = hi > lo
            mid = (lo + hi) // 2
            cut[t, full] = v[np.minimum(mid[full], len(v) - 1)]
        cuts.append(cut)
        node = 2 * node + (at >= cut[np.arange(trees), node])
    return Forest(directions, cuts)


def _usable(e):
    return F.size(e) > 0, ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, trees: int = TREES, probes: int = PROBES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest found for each row whose vec_id is divisible by ``every``, among all other rows.

    ``vectors``: (vec_id, embedding). The forest is fitted on at most ``sample`` distinct vectors; every distinct vector is
    put into its leaf of each tree. A query visits the ``probes`` leaves that one priority queue over all trees yields;
    every vector there is reranked by its exact Euclidean distance in double precision.

    Equal vectors are one entry of the index with their k + 1 smallest vec_ids: no other of them can be among k nearest,
    since ties go to the smaller vec_id. Equal queries are searched once. So a vector that a third of the rows share costs no
    more than any other. Vectors of different lengths are never compared.

    Returns (query_id, rank, vec_id, score), nearest first. Null vectors, zero vectors and vectors with null or
    non-finite components take no part, nor do null vec_ids; rows with one vec_id and one vector are one; rows with one
    vec_id and different vectors are all searched and found, each by its own distance. An empty table gives an empty result.
    """
    spark = session(vectors)
    some, sound = _usable(F.col("e"))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("e")).where("vec_id is not null and e is not null").where(some).where(sound)
    # -0.0 and 0.0 are equal
    base = base.withColumn("e", F.transform("e", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x))).withColumn("v", F.xxhash64("e"))
    base = base.dropDuplicates(["vec_id", "v"])
    first = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    kinds = written(base.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("e").alias("e")))
    queries = base.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    asked = kinds.join(queries.select("v").distinct(), "v", "left_semi").select("v", "e")
    out = None
    for dim in sorted(r.d for r in kinds.select(F.size("e").alias("d")).distinct().collect()):
        own = F.size("e") == dim
        n_kinds = kinds.where(own).count()
        share = min(1.0, 0.98 * sample / max(n_kinds, 1))
        picked = kinds.where(own).where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * share)).select("v", "e").limit(sample).toPandas().sort_values("v")
        forest = spark.sparkContext.broadcast(grow(np.stack(picked["e"].to_numpy()).astype(np.float64) if len(picked) else np.zeros((0, dim)), trees, leaf))
        del picked

        def place(batches, forest=forest):
            for p in batches:
                x = np.stack(p["e"].to_numpy()).astype(np.float64)
                at = forest.value.leaves(x)
                t = at.shape[1]
                r = np.repeat(np.arange(len(p)), t)
                yield pd.DataFrame({"tree": np.tile(np.arange(t), len(p)), "leaf": at.ravel(), "ids": p["ids"].to_numpy()[r], "e": p["e"].to_numpy()[r]})

        def aim(batches, forest=forest):
            for p in batches:
                got = [forest.value.probes(np.asarray(e, np.float64), probes) for e in p["e"]]
                r = np.repeat(np.arange(len(p)), [len(g) for g in got])
                flat = np.array([x for g in got for x in g], np.int64).reshape(-1, 2)
                yield pd.DataFrame({"tree": flat[:, 0], "leaf": flat[:, 1], "v": p["v"].to_numpy()[r], "e": p["e"].to_numpy()[r]})

        def search(entries, asked):
            """The k + 1 nearest of each query among the entries of its leaves in this group."""
            found_v, found_x, found_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            if len(entries) and len(asked):
                entries, asked = entries.sort_values("leaf", kind="stable"), asked.sort_values("leaf", kind="stable")
                x, q = np.stack(entries["e"].to_numpy()).astype(np.float64), np.stack(asked["e"].to_numpy()).astype(np.float64)
                in_leaf, q_leaf, v = entries["leaf"].to_numpy(), asked["leaf"].to_numpy(), asked["v"].to_numpy()
                for leaf in np.intersect1d(in_leaf, q_leaf):
                    lo, hi = np.searchsorted(in_leaf, [leaf, leaf + 1])
                    qa, qb = np.searchsorted(q_leaf, [leaf, leaf + 1])
                    step = max(1, 2_000_000 // ((hi - lo) * dim))
                    for at in range(qa, qb, step):
                        part = q[at : min(at + step, qb)]
                        d = np.sqrt(((part[:, None, :] - x[None, lo:hi, :]) ** 2).sum(2))
                        last = min(k, hi - lo - 1)
                        i, j = np.nonzero(d <= np.partition(d, last, axis=1)[:, last : last + 1])
                        found_v.append(v[at + i])
                        found_x.append(lo + j)
                        found_d.append(d[i, j])
            fv, fx, fd = np.concatenate(found_v), np.concatenate(found_x), np.concatenate(found_d)
            ids = entries["ids"].to_numpy()
            n = np.array([len(ids[j]) for j in fx], np.int64)
            out = pd.DataFrame({"v": np.repeat(fv, n), "vec_id": np.concatenate([np.zeros(0, np.int64), *(ids[j] for j in fx)]).astype(np.int64), "score": np.repeat(fd, n)})
            return out.sort_values(["v", "score", "vec_id"]).groupby("v", sort=False).head(k + 1)

        leaves = 1 << len(forest.value.cuts)
        in_leaf = max(1, n_kinds // leaves)
        pack_size, parts = max(1, GROUP // in_leaf), max(1, in_leaf // GROUP)
        index = kinds.where(own).select("ids", "e").mapInPandas(place, "tree int, leaf long, ids array<long>, e array<float>")
        aimed = asked.where(own).mapInPandas(aim, "tree int, leaf long, v long, e array<float>")
        index = index.withColumn("pack", F.expr(f"leaf div {pack_size}")).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
        aimed = aimed.withColumn("pack", F.expr(f"leaf div {pack_size}")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        found = index.groupBy("tree", "pack", "part").cogroup(aimed.groupBy("tree", "pack", "part")).applyInPandas(search, "v long, vec_id long, score double")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = out.groupBy("v", "vec_id").agg(F.min("score").alias("score"))
    ranked = F.row_number().over(W.partitionBy("v").orderBy("score", "vec_id"))
    best = best.withColumn("n", ranked).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    answer = queries.join(best, "v").select("query_id", F.slice(F.filter("near", lambda x: x.vec_id != F.col("query_id")), 1, k).alias("near"))
    answer = answer.select("query_id", F.posexplode("near").alias("place", "x"))
    return answer.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
