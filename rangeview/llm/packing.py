"""Packing into optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rangeview.llm.common import text_of


def n_tokens(text: Column) -> Column:
    """Runs of characters other than the six ASCII blanks."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` boundaries of least total padding; each is one of the lengths, the last the largest.

    Dynamic programming over the sorted histogram. The cost of a bucket meets the quadrangle inequality, so the best
    split moves right with the end and each layer is solved by divide and conquer: O(buckets n log n), memory O(buckets n).
    Of equally good splits the one with the smallest boundary before the last is taken, and so on leftwards.
    """
    n = len(lengths)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(counts)])
    weight = np.concatenate([[0], np.cumsum(counts * lengths)])
    cost = lambda i, j: lengths[j] * (total[j + 1] - total[i]) - (weight[j + 1] - weight[i])  # noqa: E731  bucket of entries i to j
    layers = [np.array([cost(0, j) for j in range(n)])]
    splits: list[np.ndarray] = []
    for _ in range(1, min(buckets, n)):
        before, now, split = layers[-1], layers[-1].copy(), np.zeros(n, np.int64)
        stack = [(0, n - 1, 0, n - 1)]
        while stack:
            lo, hi, left, right = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(max(left, 1), min(right, j) + 1)
            at = left
            if len(i):
                each = before[i - 1] + lengths[j] * (total[j + 1] - total[i]) - (weight[j + 1] - weight[i])
                k = int(np.argmin(each))
                at = int(i[k])
                if each[k] < now[j]:
                    now[j], split[j] = each[k], at
            stack += [(lo, j - 1, left, at), (j + 1, hi, at, right)]
        layers.append(now)
        splits.append(split)
    out, j = [], n - 1
    for split in reversed(splits):
        out.append(int(lengths[j]))
        if split[j] == 0:
            break
        j = int(split[j]) - 1
    else:
        out.append(int(lengths[j]))
    return sorted(set(out))


def pack(docs: DataFrame, token_budget: int = 16384, buckets: int = 16) -> DataFrame:
    """Put every document in a length bucket and a batch.

    ``docs``: (doc_id, text). Lengths are blank-separated tokens of whole texts. The exact histogram of all lengths
    goes to the driver, where ``best_boundaries`` chooses the boundaries with the least padding. Its distinct lengths
    are at most sqrt(2 * all tokens) + 1, since k different lengths need k (k - 1) / 2 tokens. A batch of bucket b holds max(1, token_budget // b) documents padded to b (bucket 0, of texts without
    tokens, as if b were 1). In a bucket documents are ordered by (md5 of the doc_id, doc_id, md5 of the text), a fixed shuffle; their
    ranks are found from counts of 256 ranges of that md5 and a sort inside each range, finer ranges where the input
    is larger, so no task sees a whole bucket and the ranks do not depend on the ranges.

    Returns (doc_id, n_tokens, bucket, batch_id, slot, padding), a row for each row. Null texts are empty; a null
    doc_id counts as the text ""; repeated rows stand next to each other; an empty table gives an empty result;
    other columns are not looked at.
    """
    base = docs.select("doc_id", n_tokens(text_of()).alias("n_tokens"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"), F.md5(text_of().cast("binary")).alias("th"))
    histogram = base.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").collect()
    lengths, counts = np.array([r.n_tokens for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64)
    bounds = best_boundaries(lengths, counts, buckets)
    bucket = F.lit(bounds[-1] if bounds else 0).cast("long")
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    placed = base.withColumn("bucket", bucket)
    # ranges of the md5: 16^2, and 16 times as many for every 16 times over 25 million rows
    digits = 2
    while int(counts.sum() if len(counts) else 0) > 100_000 * 16**digits:
        digits += 1
    placed = placed.withColumn("range", F.substring("h", 1, digits))
    sizes = placed.groupBy("bucket", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("coarse", F.substring("range", 1, 2))
    coarse = sizes.groupBy("bucket", "coarse").agg(F.sum("n").alias("cn"))
    by_bucket = W.partitionBy("bucket").orderBy("coarse").rowsBetween(W.unboundedPreceding, -1)
    coarse = coarse.select("bucket", "coarse", F.coalesce(F.sum("cn").over(by_bucket), F.lit(0)).alias("before"))
    in_coarse = W.partitionBy("bucket", "coarse").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("inner", F.coalesce(F.sum("n").over(in_coarse), F.lit(0))).join(coarse, ["bucket", "coarse"]).select("bucket", "range", (F.col("before") + F.col("inner")).alias("start"))
    rank = F.row_number().over(W.partitionBy("bucket", "range").orderBy("h", "doc_id", "th")) - 1
    ranked = placed.withColumn("rank", rank).join(starts, ["bucket", "range"]).withColumn("rank", F.col("rank") + F.col("start"))
    per = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    return ranked.select(
        "doc_id", "n_tokens", "bucket", F.floor(F.col("rank") / per).cast("long").alias("batch_id"), F.pmod("rank", per).cast("long").alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding")
    )


#: DuckDB SQL for ``pack`` with its defaults.
def pack_sql(table: str = "documents", token_budget: int = 16384, buckets: int = 16) -> str:
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS n_tokens,
         md5(coalesce(doc_id::VARCHAR, '')) AS h, md5(coalesce(text, '')) AS th FROM {table}),
hist AS (SELECT n_tokens AS len, count(*)::BIGINT AS n FROM base GROUP BY 1),
pre AS (SELECT row_number() OVER (ORDER BY len) AS j, len, sum(n) OVER (ORDER BY len) AS c, sum(n * len) OVER (ORDER BY len) AS w FROM hist),
dp(k, j, cost, bounds) AS (
  SELECT 1, j, (len * c - w)::HUGEINT, [len] FROM pre
  UNION ALL
  SELECT k, j, cost, bounds FROM (
    SELECT d.k + 1 AS k, p.j, (d.cost + p.len * (p.c - q.c) - (p.w - q.w))::HUGEINT AS cost, list_append(d.bounds, p.len) AS bounds,
           row_number() OVER (PARTITION BY p.j ORDER BY d.cost + p.len * (p.c - q.c) - (p.w - q.w), d.j) AS best
    FROM dp d JOIN pre q ON q.j = d.j JOIN pre p ON p.j > d.j WHERE d.k < {buckets}) WHERE best = 1),
chosen AS (SELECT bounds FROM dp WHERE j = (SELECT max(j) FROM pre) ORDER BY cost, k LIMIT 1),
bounds AS (SELECT unnest(bounds) AS bucket FROM chosen),
placed AS (SELECT b.*, (SELECT min(bucket) FROM bounds WHERE bucket >= n_tokens) AS bucket FROM base b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, doc_id NULLS FIRST, th) - 1 AS rk, greatest(1, {token_budget} // greatest(bucket, 1)) AS per FROM placed)
SELECT doc_id, n_tokens, bucket, (rk // per)::BIGINT AS batch_id, (rk % per)::BIGINT AS slot, (bucket - n_tokens)::BIGINT AS padding FROM ranked"""
