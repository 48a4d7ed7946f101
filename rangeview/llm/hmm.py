"""A hidden Markov language model: Baum-Welch over all training texts, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeview.llm.common import byte_chunks, collected, session, summed, text_of, written
from rangeview.llm.vec import HashIndex, U, prefix_hash, span_hash, words

#: Bytes of a token plus 1, A-Z lower-cased; 0 for the blanks that part tokens.
FOLD = np.zeros(256, np.uint16)
for _b in range(256):
    FOLD[_b] = 0 if _b == 32 or 9 <= _b <= 13 else (_b | 32 if 65 <= _b <= 90 else _b) + 1
END = U(0xE17D0F7E7D0C5EED)
#: Most frequent training tokens whose counts go to every executor; the counts of the others are joined by shuffle.
HEAD = 1 << 18
#: Most frequent tokens that are symbols of the model; all others are one symbol, RARE, with unigram shares inside it.
SYMBOLS = 32767
RARE = SYMBOLS
STATES = 8
ROUNDS = 4
#: Steps of forward and backward that are held at once; longer texts are gone through by blocks, whole all the same.
BLOCK = 1 << 20
#: Tokens that a task steps through together, those that it holds to put texts of like length together, and those that a round of the first guess looks at together.
HOLD, GATHER, GUESS_HOLD = 1 << 19, 1 << 23, 1 << 18
#: Rounds of the mixture that the first guess is made by.
GUESS_ROUNDS = 15


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, ends included; tokens of each text)."""
    folded = FOLD[data]
    starts, ends, counts = words(folded, offsets)
    h = span_hash(prefix_hash(folded), starts, ends)
    n = counts + 1
    out = np.full(int(n.sum()), END)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(n) - 1] = False
    out[inner] = h
    return out, n


def token_counts(docs: DataFrame) -> DataFrame:
    """(hash, c): how often each token stands in the column text of ``docs``; exact but for collisions of 64-bit hashes."""
    session(docs)

    def count(batches):
        def merge(parts):
            h, c = (np.concatenate(x) for x in zip(*parts))
            u, at = np.unique(h, return_inverse=True)
            return u, np.bincount(at, c, len(u)).astype(np.int64)

        parts, held = [], 0
        for b in batches:
            for _, _, data, offsets in byte_chunks(b.column(0), 1 << 20):
                u, c = np.unique(tokens(data, offsets)[0], return_counts=True)
                parts.append((u, c))
                held += len(u)
                if held > 1_500_000:
                    parts = [merge(parts)]
                    if len(parts[0][0]) > 700_000:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], names=["hash", "c"])
                        parts = []
                    held = sum(len(p[0]) for p in parts)
        if parts:
            u, c = merge(parts)
            for k in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 100_000].view(np.int64)), pa.array(c[k : k + 100_000])], names=["hash", "c"])

    return docs.select(text_of().alias("text")).mapInArrow(count, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """start (S), move (S, S), emit (SYMBOLS + 1, S): probabilities; states keep their order from round to round."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _flat(ids: list[np.ndarray]):
    """Sequences in falling order of length: (flat ids, first places, lengths, order)."""
    n = np.array([len(s) for s in ids], np.int64)
    order = np.argsort(-n, kind="stable")
    flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
    return flat.astype(np.int64), (np.cumsum(n) - n)[order], n[order], order


def forward(model: Model, ids: list[np.ndarray]) -> np.ndarray:
    """The natural logarithm of each sequence's probability; all sequences step together, each to its own end."""
    flat, first, n, order = _flat(ids)
    out, total = np.zeros(len(ids)), np.zeros(len(ids))
    if not len(ids):
        return out
    alive = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), "right").tolist()
    each = np.ones(len(model.start))
    alpha = model.start * model.emit[flat[first]]
    for t, k in enumerate(alive):
        if t:
            alpha = alpha[:k] @ model.move
            alpha *= model.emit.take(flat.take(first[:k] + t), 0)
        scale = alpha @ each
        total[:k] += np.log(scale)
        alpha /= scale[:, None]
    out[order] = total
    return out


def expected(model: Model, ids: list[np.ndarray], longest: int = BLOCK) -> np.ndarray:
    """Expected counts of starts, moves and emissions and the log likelihood, as one array, by forward and backward.

    Sequences are taken whole. Of those with more than ``longest`` steps a first pass keeps the forward values at the
    borders of blocks; from the last block to the first they are made anew, and backward values go over the borders.
    """
    s = len(model.start)
    flat, first, n, _ = _flat(ids)
    emit_counts, moves, starts, loglik = np.zeros((SYMBOLS + 1, s)), np.zeros((s, s)), np.zeros(s), 0.0
    alive = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), "right") if len(n) else np.zeros(0, np.int64)
    each, back_move = np.ones(s), np.ascontiguousarray(model.move.T)

    def ahead(lo, border):
        """(ids, observations over scales, forward values, scales, places, last forward values) of the steps of the block from ``lo``, after ``border``."""
        own = alive[lo : lo + longest]
        place = [0, *np.cumsum(own).tolist()]
        ids_t = flat[np.concatenate([first[:k] + lo + t for t, k in enumerate(own.tolist())])]
        obs = model.emit.take(ids_t, 0)
        alphas, scales = np.empty_like(obs), np.empty(len(obs))
        for t, k in enumerate(own.tolist()):
            seen, a, c = obs[place[t] : place[t + 1]], alphas[place[t] : place[t + 1]], scales[place[t] : place[t + 1]]
            np.multiply(border[:k] @ model.move if lo + t else model.start, seen, out=a)
            np.matmul(a, each, out=c)
            over = c[:, None]
            a /= over
            seen /= over
            border = a
        return ids_t, obs, alphas, scales, place, border.copy()

    blocks, borders = list(range(0, len(alive), longest)), [None]
    for lo in blocks[:-1]:
        borders.append(ahead(lo, borders[-1])[-1])
    beta = np.ones((alive[-1], s)) if len(n) else None
    for lo, border in zip(reversed(blocks), reversed(borders)):
        ids_t, obs, alphas, scales, place, _ = ahead(lo, border)
        loglik += float(np.log(scales).sum())
        for t in range(len(place) - 2, -1, -1):
            here = slice(place[t], place[t + 1])
            if lo + t == 0:
                alphas[here] *= beta
                starts = alphas[here].sum(0)
                break
            k = alive[lo + t]
            before = alphas[place[t - 1] : place[t - 1] + k] if t else border[:k]
            weight = obs[here]
            weight *= beta
            moves += before.T @ weight
            back = np.ones((alive[lo + t - 1], s))
            np.matmul(weight, back_move, out=back[:k])
            alphas[here] *= beta  # of no more use as forward values
            beta = back
        for k, weight in enumerate(np.ascontiguousarray(alphas.T)):
            emit_counts[:, k] += np.bincount(ids_t, weight, SYMBOLS + 1)
    return np.concatenate([starts, (moves * model.move).ravel(), emit_counts.ravel(), [loglik]])


def _held(batches, column: int, hold: int):
    """Lists of id arrays of about ``hold`` tokens."""
    out, held = [], 0
    for b in batches:
        for raw in b.column(column).to_pylist():
            ids = np.frombuffer(raw, "<u2")
            out.append(ids)
            held += len(ids)
            if held >= hold:
                yield out
                out, held = [], 0
    if out:
        yield out


def _alike(ids: list[np.ndarray], hold: int | None = None) -> list[np.ndarray]:
    """Numbers of the texts in runs of about ``hold`` tokens (``HOLD``), longest texts first: a run takes a step for each place of its longest text."""
    n = np.array([len(i) for i in ids], np.int64)
    order = np.argsort(-n, kind="stable")
    ends = np.cumsum(n[order])
    return np.split(order, np.flatnonzero(np.diff((ends - 1) // (hold or HOLD))) + 1)


def estimate(counts: np.ndarray, share: np.ndarray, s: int) -> Model:
    """The model of the expected counts; emissions lean on the shares of all tokens with a weight of 5 tokens."""
    starts, moves, emits = counts[:s], counts[s : s + s * s].reshape(s, s), counts[s + s * s : s + s * s + (SYMBOLS + 1) * s].reshape(SYMBOLS + 1, s)
    return Model((starts + 0.1) / (starts.sum() + 0.1 * s), (moves + 0.1) / (moves.sum(1, keepdims=True) + 0.1 * s), (emits + 5 * share[:, None]) / (emits.sum(0) + 5))


def distances(ids: list[np.ndarray], logs: np.ndarray) -> np.ndarray:
    """(texts, states): the sums of the log weights ``logs`` (SYMBOLS + 1, states) over each text's tokens."""
    lengths, cols = np.array([len(i) for i in ids]), np.concatenate(ids).astype(np.int64)
    first = np.cumsum(lengths) - lengths
    # a state at a time: columns in one piece stay in the cache
    return np.stack([np.add.reduceat(own.take(cols), first) for own in np.ascontiguousarray(logs.T)], 1)


def mixture_counts(ids: list[np.ndarray], prior: np.ndarray, emit: np.ndarray, logs: np.ndarray | None = None) -> np.ndarray:
    """Expected numbers of texts and of tokens of each state of a mixture of unigrams, as one array; ``logs``: those of ``emit``, if known."""
    ll = distances(ids, np.log(emit) if logs is None else logs) + np.log(prior)
    r = np.exp((ll - ll.max(1, keepdims=True)) * 0.2)
    r /= r.sum(1, keepdims=True)
    lengths, cols = np.array([len(i) for i in ids]), np.concatenate(ids).astype(np.int64)
    return np.concatenate([r.sum(0), np.stack([np.bincount(cols, np.repeat(own, lengths), SYMBOLS + 1) for own in np.ascontiguousarray(r.T)], 1).ravel()])


def first_guess(texts: DataFrame, share: np.ndarray, s: int) -> Model:
    """States from a mixture of unigrams over all ``texts`` (ids), each whole: seeds far apart, then ``GUESS_ROUNDS`` of EM.

    The first seed is the longest text, each other one that of at least the median length which the seeds before it
    fit least. The driver gets one text for a seed and one array of counts for a round.
    """
    spark = texts.sparkSession
    move = np.full((s, s), 0.3 / s) + 0.7 * np.eye(s)
    n_texts, median = texts.agg(F.count(F.lit(1)), F.percentile(F.length("ids"), 0.5)).head()
    if not n_texts:
        return Model(np.full(s, 1 / s), move, np.repeat(share[:, None], s, 1))
    logs, emits = np.log(share), []
    seed = texts.orderBy(F.length("ids").desc(), "ids").limit(1).collect()[0].ids
    while True:
        own = np.bincount(np.frombuffer(seed, "<u2"), minlength=SYMBOLS + 1)
        emits.append((own + 50 * share) / (own.sum() + 50))
        if len(emits) == s:
            break
        shared = spark.sparkContext.broadcast(np.log(np.stack(emits, 1)) - logs[:, None])

        def far(batches, shared=shared):
            best = None
            for held in _held(batches, 0, GUESS_HOLD):
                fit = distances(held, shared.value).max(1) / np.array([len(i) for i in held])
                k = min(np.flatnonzero(fit == fit.min()), key=lambda k: held[k].tobytes())
                best = min(x for x in (best, (float(fit[k]), held[k].tobytes())) if x)
            if best:
                yield pa.RecordBatch.from_pydict({"fit": pa.array([best[0]]), "ids": pa.array([best[1]], pa.binary())})

        seed = texts.where(F.length("ids") >= median).mapInArrow(far, "fit double, ids binary").orderBy("fit", "ids").limit(1).collect()[0].ids
        shared.unpersist()
    emit, prior = np.stack(emits, 1), np.full(s, 1 / s)
    for _ in range(GUESS_ROUNDS):
        shared = spark.sparkContext.broadcast((prior, emit))

        def add(batches, shared=shared):
            out, logs = np.zeros(1), np.log(shared.value[1])
            for held in _held(batches, 0, GUESS_HOLD):
                out = out + mixture_counts(held, *shared.value, logs)
            return out

        counts = summed(texts, add, s + (SYMBOLS + 1) * s)
        shared.unpersist()
        prior = (counts[:s] + 1) / (n_texts + s)
        emit = counts[s:].reshape(SYMBOLS + 1, s)
        emit = (emit + 50 * share[:, None]) / (emit.sum(0) + 50)
    return Model(prior, move, emit)


def score(docs: DataFrame, training, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text) by an HMM learnt from the rows where the column ``training`` holds.

    Tokens are runs of bytes other than the ASCII blanks, A-Z lower-cased, and one end for each text. The counts of all
    training tokens are exact. The ``SYMBOLS`` most frequent tokens are the model's symbols; every other token is the symbol
    RARE times its share (c + 0.5) / (C + 0.5 (V + 1)) among the rare ones, so the probabilities of all tokens and one
    unknown token sum to 1. Baum-Welch starts from a mixture of unigrams over all training texts and runs
    ``rounds`` times over all of them, each whole; counts are added on the executors.
    The score is the exact likelihood of the whole text by the scaled forward recursion.

    Counts of the ``HEAD`` most frequent tokens are broadcast (a fixed bound); the other tokens of each text are
    joined to their counts by shuffle, which has no hot key, because they are rare.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row; held_out is the
    opposite of ``training``. Null and empty texts have one token, the end; null ids stay; repeated rows score alike;
    without training rows nothing is known and all symbols are RARE; an empty table gives an empty result.
    """
    spark = session(docs)
    base = docs.select("doc_id", training.alias("training"), text_of().alias("text"))
    counts = written(token_counts(base.where("training").select("text")))
    # the head: all tokens above a count, the least for which they are at most HEAD; found from counts by sixteenths of a doubling
    size = F.floor(F.log2("c") * 16).cast("int")
    by_size = {r["s"]: r["n"] for r in counts.groupBy(size.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    floor, held = 1 << 20, 0
    for k in sorted(by_size, reverse=True):
        held += by_size[k]
        if held > HEAD:
            break
        floor = k
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).head()
    head = collected(counts.where(size >= floor), ("hash", "c"))
    keys, c = head["hash"].view(np.uint64), head["c"]
    order = np.lexsort((keys.view(np.int64), -c))
    keys, c = keys[order], c[order]
    m = min(SYMBOLS, len(keys))
    rare_total, rare_kinds = int(total - c[:m].sum()), int(kinds - m)
    share = np.full(SYMBOLS + 1, 0.5)
    share[:m] += c[:m]
    share[RARE] += rare_total
    share /= share.sum()
    base_of = lambda n: np.log10((n + 0.5) / (total + 0.5 * (kinds + 1)))
    rare_of = lambda n: np.log10((n + 0.5) / (rare_total + 0.5 * (rare_kinds + 1)))
    wide = spark.sparkContext.broadcast((HashIndex(keys), base_of(c), rare_of(c)))

    def encode(batches):
        index, base10, rare10 = wide.value
        for b in batches:
            out = {k: [] for k in ("n_tokens", "known", "base", "rare", "ids", "tail")}
            for _, _, data, offsets in byte_chunks(b.column(2)):
                h, n = tokens(data, offsets)
                at = index.find(h)
                ends = np.cumsum(n)
                row = np.repeat(np.arange(len(n)), n)
                hit = at >= 0
                safe = np.where(hit, at, 0)
                sums = lambda v: np.bincount(row, v, len(n))
                out["n_tokens"] += n.tolist()
                out["known"] += sums(hit).astype(np.int64).tolist()
                out["base"] += sums(np.where(hit, base10[safe] if len(base10) else 0.0, 0.0)).tolist()
                out["rare"] += sums(np.where(hit & (at >= SYMBOLS), rare10[safe] if len(rare10) else 0.0, 0.0)).tolist()
                ids = np.where(hit & (at < SYMBOLS), at, RARE).astype("<u2")
                lost = np.flatnonzero(~hit)
                cuts = np.searchsorted(lost, np.concatenate([[0], ends]))
                tail = h[lost].view(np.int64)
                for k in range(len(n)):
                    out["ids"].append(ids[ends[k] - n[k] : ends[k]].tobytes())
                    out["tail"].append(tail[cuts[k] : cuts[k + 1]].tobytes())
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, t) for v, t in zip(out.values(), types)), b.column(3)], names=["doc_id", "training", *out, "row"])

    schema = base.select("doc_id", "training").schema.add("n_tokens", "long").add("known", "long").add("base", "double").add("rare", "double").add("ids", "binary").add("tail", "binary").add("row", "long")
    coded = written(base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(encode, schema))

    # Baum-Welch
    # a task sends its whole array of counts in each round, so there are few tasks; nothing is shuffled for that
    texts = coded.where("training").select("ids").coalesce(2 * spark.sparkContext.defaultParallelism)
    model = first_guess(texts, share, states)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def add(batches, shared=shared):
            out = np.zeros(1)
            for held in _held(batches, 0, GATHER):
                for run in _alike(held):
                    out = out + expected(shared.value, [held[k] for k in run])
            return out

        model = estimate(summed(texts, add, states + states * states + (SYMBOLS + 1) * states + 1), share, states)
        shared.unpersist()
    final = spark.sparkContext.broadcast(model)

    def likelihood(batches):
        rows, ids, held = [], [], 0

        def flush():
            found = np.zeros(len(ids))
            for run in _alike(ids):
                found[run] = forward(final.value, [ids[k] for k in run]) / math.log(10)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))] + [pa.array(found)], names=["doc_id", "training", "n_tokens", "known", "base", "rare", "row", "hmm"])

        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(7)]
            rows += list(zip(*columns))
            got = [np.frombuffer(x, "<u2") for x in b.column(7).to_pylist()]
            ids += got
            held += sum(map(len, got))
            if held >= GATHER:
                yield flush()
                rows, ids, held = [], [], 0
        if rows:
            yield flush()

    likely = coded.select(F.col("doc_id").cast("long").alias("doc_id"), "training", "n_tokens", "known", "base", "rare", "row", "ids").mapInArrow(likelihood, "doc_id long, training boolean, n_tokens long, known long, base double, rare double, row long, hmm double")

    # tokens outside the head
    def unfold(batches):
        for b in batches:
            tails = [np.frombuffer(t, "<i8") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(t) for t in tails])), pa.array(np.concatenate([np.zeros(0, np.int64), *tails]))], names=["row", "hash"])

    lost = coded.where(F.length("tail") > 0).select("row", "tail").mapInArrow(unfold, "row long, hash long").groupBy("row", "hash").agg(F.count(F.lit(1)).alias("k"))
    rest = counts.where(size < floor)
    n = F.coalesce("c", F.lit(0))
    found = lost.join(rest, "hash", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("k") * F.log10((n + 0.5) / F.lit(total + 0.5 * (kinds + 1)))).alias("tail_base"),
        F.sum(F.col("k") * F.log10((n + 0.5) / F.lit(rare_total + 0.5 * (rare_kinds + 1)))).alias("tail_rare"),
    )
    zero = F.lit(0.0)
    return likely.join(found, "row", "left").select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"), (F.col("hmm") + F.col("rare") + F.coalesce("tail_rare", zero)).alias("score"),
    )
