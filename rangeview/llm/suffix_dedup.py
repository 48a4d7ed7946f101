"""Repeated strings of a corpus by prefix-free parsing and suffix arrays.

Texts are packed into rows of about a megabyte. Rolling-hash triggers cut them into phrases; the dictionary of distinct
phrases (each with the 49 bytes after it) resolves every phrase that an earlier document has too, so copies cost one
digest a phrase. What is left, the first occurrence of each phrase, is searched for repeats that cross phrases: strings
whose least rolling hash occurs in several documents are sorted into the corpus order of their first 50 bytes, by suffix
arrays (prefix doubling) over shards. Three exchanges do this; in each a pack sends sorted keys or strings to shards and
gets back one bit for each. Packs themselves are never shuffled: they lie bucketed by number.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeview.llm.common import forget, session, text_of, written
from rangeview.llm.vec import U, mix, powers, prefix_hash, span_hash

#: Bytes of a repeated string.
SPAN = 50
#: Bytes of the rolling hash.
ROLL = 16
#: Mean distance and least distance of triggers.
TRIGGER, GAP = 128, 32
PACK_BYTES = 1 << 20
#: Raw text for which there is one shard.
SHARD_BYTES = 16 << 20
#: Bytes that a task holds for the shards before it sends them, and what a row costs beside its content.
OUTBOX_BYTES, PART_BYTES = 24 << 20, 400
#: A least hash that so many packs share is dealt out by its strings' content.
HOT = 4096
LAST = np.int64((1 << 63) - 1)


def _zip(raw: bytes) -> bytes:
    return pa.compress(raw, "zstd", asbytes=True)


def _unzip(raw: bytes, n: int) -> bytes:
    return pa.decompress(raw, decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def pack(docs: DataFrame) -> DataFrame:
    """(f, ids, nulls, offsets, size, data): runs of whole texts of one input partition, about PACK_BYTES or one longer text."""
    session(docs)

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def out():
            data = b"".join(texts)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("<i8")
            known = [LAST if i is None else i for i in ids]
            return pa.RecordBatch.from_pydict({
                "f": pa.array([part << 32 | k], pa.int64()), "ids": pa.array([np.array(known, "<i8").tobytes()], pa.binary()), "nulls": pa.array([bytes(i is None for i in ids)], pa.binary()),
                "offsets": pa.array([offsets.tobytes()], pa.binary()), "size": pa.array([len(data)], pa.int64()), "data": pa.array([_zip(data) if data else b""], pa.binary()),
            })

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held >= PACK_BYTES or len(ids) >= 20_000:
                    yield out()
                    ids, texts, held, k = [], [], 0, k + 1
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "f long, ids binary, nulls binary, offsets binary, size long, data binary")


class Pack:
    """A pack's texts with everything that the exchanges derive from them, always in the same order."""

    def __init__(self, ids: bytes, offsets: bytes, size: int, data: bytes):
        self.ids, self.offsets = np.frombuffer(ids, "<i8"), np.frombuffer(offsets, "<i8")
        self.raw = _unzip(data, size)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.n = len(self.data)
        lengths = np.diff(self.offsets)
        self.owner = np.repeat(self.ids, lengths)
        self.end = np.repeat(self.offsets[1:], lengths)
        self.prefix = prefix_hash(self.data)
        m = max(self.n - ROLL + 1, 0)
        self.roll = mix((self.prefix[ROLL:] - self.prefix[:m]) * powers(m + 1)[1][:m]) if m else np.zeros(0, np.uint64)
        self.whole = np.arange(self.n) + SPAN <= self.end

    def phrases(self):
        """(starts, ends, keys, other keys): cut at triggers and at the texts' ends; keys from a 128-bit digest."""
        m = len(self.roll)
        at = np.flatnonzero((self.roll >> U(32)) % U(TRIGGER) == 0)
        at = at[at + ROLL <= self.end[at]]
        if len(at) > 1 and (np.diff(at) < GAP).any():
            kept, last = [], -GAP
            for p in at.tolist():
                if p - last >= GAP:
                    kept.append(p)
                    last = p
            at = np.array(kept, np.int64)
        heads = self.offsets[:-1][np.diff(self.offsets) > 0]
        starts = np.unique(np.concatenate([heads, at]))
        ends = np.concatenate([starts[1:], [self.n]]) if len(starts) else starts
        stops = np.minimum(ends + SPAN - 1, self.end[starts]) if len(starts) else ends
        digest = b"".join(hashlib.blake2b(self.raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist()))
        both = np.frombuffer(digest, "<u8").reshape(-1, 2)
        return starts, ends, both[:, 0], both[:, 1]

    def least(self) -> np.ndarray:
        """The least rolling hash in the SPAN bytes from each place; of meaning where the place's string is whole."""
        if self.n < SPAN:
            return np.zeros(0, np.uint64)
        low, width = self.roll, 1
        want = SPAN - ROLL + 1
        while 2 * width <= want:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < want:
            low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
        return low


def _by_shard(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    shard = (mix(key) >> U(11)) % U(shards)
    return shard.astype(np.int64), shard


def _least_owner(order_keys: tuple, owner: np.ndarray):
    """(order, group starts, least owner of each group) of rows with equal keys; order_keys: last is the first to sort by."""
    order = np.lexsort((owner, *order_keys))
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in order_keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    return order, first, owner[order][first]


def _phrase_keys(p: Pack, shards: int):
    """Distinct phrases of a pack in shard order: (shards, keys, other keys, least owners, phrase to key)."""
    starts, ends, k1, k2 = p.phrases()
    owner = p.owner[starts]
    order, first, low = _least_owner((k2, k1), owner)
    group = np.zeros(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(order)]])))
    u1, u2 = k1[order][first], k2[order][first]
    shard = _by_shard(u1, shards)[0]
    sort = np.lexsort((u2, u1, shard))
    place = np.empty(len(sort), np.int64)
    place[sort] = np.arange(len(sort))
    return starts, ends, owner, shard[sort], u1[sort], u2[sort], low[sort], place[group]


def _unresolved(p: Pack, shards: int, bits: np.ndarray):
    """(places whose string an earlier document is known to have, places still open): whole strings only."""
    starts, ends, owner, _, _, _, low, place = _phrase_keys(p, shards)
    gone = (bits[place] == 1) | (low[place] < owner) if len(starts) else np.zeros(0, bool)
    lost = np.repeat(gone, ends - starts)
    return lost & p.whole, ~lost & p.whole


def _least_keys(p: Pack, open_: np.ndarray, shards: int):
    """Distinct least hashes of the open places in shard order, with least and greatest owner; and each open place's key."""
    at = np.flatnonzero(open_)
    if not len(at):
        z = np.zeros(0, np.int64)
        return at, z, z.view(np.uint64), z, z, z
    value, holder = p.least()[at], p.owner[at]
    # neighbours mostly share their least hash: one row for each run
    first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (holder[1:] != holder[:-1])]))
    run, own = value[first], holder[first]
    order = np.lexsort((own, run))
    run, own = run[order], own[order]
    new = np.concatenate([[True], run[1:] != run[:-1]])
    heads = np.flatnonzero(new)
    u, least, most = run[heads], own[heads], own[np.concatenate([heads[1:], [len(run)]]) - 1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    shard = _by_shard(u, shards)[0]
    sort = np.argsort(shard, kind="stable")
    place = np.empty(len(sort), np.int64)
    place[sort] = np.arange(len(sort))
    return at, shard[sort], u[sort], least[sort], most[sort], np.repeat(place[group], np.diff(np.concatenate([first, [len(at)]])))


def _segments(p: Pack, at: np.ndarray, keys: np.ndarray, code: np.ndarray, shards: int):
    """Distinct strings that hold all suspect places, in shard order: (shards, starts, places each, least owners), and of each
    suspect place (place, segment, offset in the segment)."""
    sus = np.flatnonzero(code > 0)
    at, key, hot = at[sus], keys[sus], code[sus] == 2
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z, (z, z, z)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1]) | (p.owner[at[1:]] != p.owner[at[:-1]]) | (p.end[at[1:]] != p.end[at[:-1]]) | hot[1:]
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    n = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    h = span_hash(p.prefix, start, start + n + SPAN - 1) + n.astype(np.uint64)
    owner = p.owner[start]
    order, group_first, low = _least_owner((h,), owner)
    group = np.zeros(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(group_first)), np.diff(np.concatenate([group_first, [len(order)]])))
    lead = order[group_first]
    to = np.where(hot[first][lead], key[first][lead] ^ h[lead], key[first][lead])
    shard = _by_shard(to, shards)[0]
    sort = np.lexsort((h[lead], shard))
    place = np.empty(len(sort), np.int64)
    place[sort] = np.arange(len(sort))
    return shard[sort], start[lead][sort], n[lead][sort], low[sort], (at, place[group[run]], np.arange(len(at)) - first[run])


def suffix_ranks(data: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of the first SPAN bytes at ``places`` in their order, equal for equal strings: a suffix array by prefix doubling.

    ``ends``: for each byte where its string ends; every place has SPAN bytes before that.
    """
    n = len(data)
    wide = np.concatenate([data, np.zeros(SPAN, np.uint8)]).astype(np.uint64)
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank |= wide[k : k + n] << U(56 - 8 * k)
    needed = np.zeros(n, bool)
    needed[places] = True
    steps = [(8, 8), (16, 16), (32, SPAN - 32)]
    used = [needed]
    for _, shift in reversed(steps):
        more = used[0].copy()
        more[shift:] |= used[0][:-shift] if shift < n else False
        used.insert(0, more)
    at = np.flatnonzero(used[0])
    rank[at] = np.unique(rank[at], return_inverse=True)[1].astype(np.uint64)
    for (_, shift), mask in zip(steps, used[1:]):
        at = np.flatnonzero(mask)
        both = rank[at] << U(32) | rank[np.minimum(at + shift, n - 1)]
        new = rank.copy()
        new[at] = np.unique(both, return_inverse=True)[1].astype(np.uint64)
        rank = new
    return rank[places]


def _bits(flags: np.ndarray) -> bytes:
    return flags.astype(np.uint8).tobytes()


_SENT = "shard long, g long, packs binary, sizes binary, keys binary, more binary, low binary, high binary, counts binary, size long, data binary"
_NAMES = ["shard", "g", "packs", "sizes", "keys", "more", "low", "high", "counts", "size", "data"]


class _Outbox:
    """What the packs of a task have for the shards: one row a shard for all packs that are held together, not one for each pack."""

    def __init__(self):
        self.shards, self.held, self.first = {}, 0, None

    def add(self, f: int, shard: np.ndarray, keys=None, more=None, low=None, high=None, counts=None, pieces=None) -> None:
        """A pack's sorted shards and what goes to them; a reply has a bit for each key, or as many as ``counts`` says."""
        if not len(shard):
            return
        self.first = f if self.first is None else self.first
        cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        raw = lambda a, s, e: b"" if a is None else a[s:e].tobytes()
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            data = b"" if pieces is None else b"".join(pieces(k) for k in range(s, e))
            part = (f, e - s if counts is None else int(counts[s:e].sum()), *(raw(x, s, e) for x in (keys, more, low, high, counts)), data)
            self.shards.setdefault(int(shard[s]), []).append(part)
            self.held += PART_BYTES + sum(map(len, part[2:]))

    def flush(self, least: int = 1):
        """A batch of what is held, if that is ``least`` bytes."""
        if self.held < least:
            return
        rows = []
        for shard, parts in self.shards.items():
            f, sizes, *held = zip(*parts)
            *columns, data = map(b"".join, held)
            rows.append((shard, self.first, np.array(f, "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), *columns, len(data), _zip(data) if data else b""))
        types = (pa.int64(), pa.int64(), *[pa.binary()] * 7, pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=_NAMES)
        self.__init__()


def _exchange(sent: DataFrame, answer) -> DataFrame:
    """(f, reply): what ``answer`` gives each pack's keys, joined in shard order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("g")
        sizes, flags = answer(group)
        cuts = np.cumsum(sizes)[:-1]
        return pd.DataFrame({"g": group["g"].to_numpy(), "shard": group["shard"].to_numpy(), "packs": group["packs"].to_numpy(), "sizes": group["sizes"].to_numpy(), "bits": [_zip(_bits(x)) for x in np.split(flags, cuts)], "n": sizes})

    def part(group: pd.DataFrame) -> pd.DataFrame:
        own: dict[int, list[bytes]] = {}
        for _, f, sizes, bits, n in sorted(zip(group["shard"], group["packs"], group["sizes"], group["bits"], group["n"])):
            bits, at = _unzip(bits, n), 0
            for k, size in zip(np.frombuffer(f, "<i8").tolist(), np.frombuffer(sizes, "<i8").tolist()):
                own.setdefault(k, []).append(bits[at : at + size])
                at += size
        joined = [b"".join(x) for x in own.values()]
        return pd.DataFrame({"f": list(own), "bits": [_zip(x) for x in joined], "n": [len(x) for x in joined]})

    replies = sent.groupBy("shard").applyInPandas(run, "g long, shard long, packs binary, sizes binary, bits binary, n long")
    return written(replies.groupBy("g").applyInPandas(part, "f long, bits binary, n long").select("f", F.struct("bits", "n").alias("reply")))


def _joined(reply) -> np.ndarray:
    return np.frombuffer(_unzip(reply["bits"], reply["n"]) if reply else b"", np.uint8)


def _column(group: pd.DataFrame, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(group[name]), kind)


def _phrase_answer(group):
    sizes = np.array([len(k) // 8 for k in group["keys"]])
    k1, k2, low = _column(group, "keys", "<u8"), _column(group, "more", "<u8"), _column(group, "low", "<i8")
    order, first, least = _least_owner((k2, k1), low)
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(least, np.diff(np.concatenate([first, [len(order)]]))) < low[order]
    return sizes, out


def _least_answer(group):
    sizes = np.array([len(k) // 8 for k in group["keys"]])
    k, low, high = _column(group, "keys", "<u8"), _column(group, "low", "<i8"), _column(group, "high", "<i8")
    order, first, least = _least_owner((k,), low)
    n = np.diff(np.concatenate([first, [len(order)]]))
    most = np.maximum.reduceat(high[order], first) if len(first) else high
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(np.where(least < most, np.where(n > HOT, 2, 1), 0), n)
    return sizes, out


def _suffix_answer(group):
    counts = [np.frombuffer(c, "<i8") for c in group["counts"]]
    sizes = np.array([int(c.sum()) for c in counts])
    n, low = np.concatenate(counts), _column(group, "low", "<i8")
    data = np.frombuffer(b"".join(_unzip(d, s) for d, s in zip(group["data"], group["size"])), np.uint8)
    lengths = n + SPAN - 1
    start = np.cumsum(lengths) - lengths
    places = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    rank = suffix_ranks(data, places, None)
    owner = np.repeat(low, n)
    order, first, least = _least_owner((rank,), owner)
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(least, np.diff(np.concatenate([first, [len(order)]]))) < owner[order]
    return sizes, out


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Remove every byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    ``docs``: (doc_id, text); whole texts as UTF-8 bytes. Matches never cross texts, overlap, and are judged on the input. Null
    ids are larger than all others and not smaller than each other; repeated rows and rows with one doc_id do not remove each
    other's bytes. Null texts are empty; texts under 50 bytes lose nothing; an empty table gives an empty result; other columns are not looked at.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row, with ``texts`` also the kept bytes as
    ``kept`` (binary: a cut may fall inside a character). A task holds one pack or one shard of about SHARD_BYTES.
    """
    spark = session(docs)
    name = f"rangeview_packs_{uuid.uuid4().hex}"
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pack(docs).write.bucketBy(buckets, "f").format("parquet").saveAsTable(name)
    packs = spark.table(name)
    total = packs.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    shards = max(16, -(-int(total) // SHARD_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")

    def rows(b):
        for r in b.to_pylist():
            yield r, Pack(r["ids"], r["offsets"], r["size"], r["data"])

    def phrases(batches):
        out = _Outbox()
        for b in batches:
            for r, p in rows(b):
                _, _, _, shard, k1, k2, low, _ = _phrase_keys(p, shards)
                out.add(r["f"], shard, k1, k2, low)
                yield from out.flush(OUTBOX_BYTES)
        yield from out.flush()

    one = _exchange(packs.mapInArrow(phrases, _SENT), _phrase_answer)
    after_one = packs.join(one.withColumnRenamed("reply", "one"), "f", "left")

    def leasts(batches):
        out = _Outbox()
        for b in batches:
            for r, p in rows(b):
                _, open_ = _unresolved(p, shards, _joined(r["one"]))
                _, shard, key, low, high, _ = _least_keys(p, open_, shards)
                out.add(r["f"], shard, key, None, low, high)
                yield from out.flush(OUTBOX_BYTES)
        yield from out.flush()

    two = _exchange(after_one.mapInArrow(leasts, _SENT), _least_answer)
    after_two = after_one.join(two.withColumnRenamed("reply", "two"), "f", "left")

    def suspects(p, r):
        lost, open_ = _unresolved(p, shards, _joined(r["one"]))
        at, _, keys, _, _, place = _least_keys(p, open_, shards)
        code = _joined(r["two"])[place] if len(at) else np.zeros(0, np.uint8)
        return lost, _segments(p, at, keys[place] if len(at) else keys, code, 4 * shards)

    def strings(batches):
        out = _Outbox()
        for b in batches:
            for r, p in rows(b):
                _, (shard, start, n, low, _) = suspects(p, r)
                out.add(r["f"], shard, None, None, low, None, n, pieces=lambda k, p=p, start=start, n=n: p.raw[start[k] : start[k] + n[k] + SPAN - 1])
                yield from out.flush(OUTBOX_BYTES)
        yield from out.flush()

    three = _exchange(after_two.mapInArrow(strings, _SENT), _suffix_answer)
    after_three = after_two.join(three.withColumnRenamed("reply", "three"), "f", "left")

    def finish(batches):
        for b in batches:
            for r, p in rows(b):
                lost, (_, _, n, low, (at, segment, offset)) = suspects(p, r)
                if len(at):
                    flags = _joined(r["three"])
                    first = np.cumsum(n) - n
                    lost = lost.copy()
                    lost[at] |= (flags[first[segment] + offset] == 1) | (low[segment] < p.owner[at])
                total = np.concatenate([[0], np.cumsum(lost)])
                i = np.arange(p.n)
                cover = total[i + 1] > total[np.maximum(i - SPAN + 1, 0)]
                heads = cover & ~np.concatenate([[False], cover[:-1]])
                inner = p.offsets[:-1][(np.diff(p.offsets) > 0)]
                heads[inner] |= cover[inner]
                removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (cover, heads))
                kept = [p.data[s:e][~cover[s:e]].tobytes() for s, e in zip(p.offsets[:-1], p.offsets[1:])]
                cols = [
                    pa.array([None if z else int(d) for d, z in zip(p.ids, r["nulls"])], pa.int64()), pa.array(np.diff(p.offsets)), pa.array(np.diff(removed[p.offsets])), pa.array(np.diff(spans[p.offsets])),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.binary())] if texts else []), names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts)

    out = written(after_three.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts))
    for t in (one, two, three):
        forget(t)
    spark.sql(f"DROP TABLE {name}")
    return out


def repeats_sql(table: str = "documents", size: int = SPAN) -> str:
    """DuckDB SQL for the rows of ``remove_repeats`` over whole texts: all strings of ``size`` bytes, in hexadecimal, told apart by 128-bit hashes."""
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM {table}
), strings AS (
  SELECT r, doc_id, i, md5_number(substr(x, 2 * i + 1, {2 * size})) AS s
  FROM (SELECT r, doc_id, x, unnest(range(0, length(x) // 2 - {size - 1})) AS i FROM texts WHERE length(x) >= {2 * size})
), firsts AS (
  SELECT s, min(doc_id) AS least FROM strings GROUP BY s HAVING count(*) > 1
), spans AS (
  SELECT r, i, i + {size} AS e, max(i + {size}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM strings JOIN firsts USING (s) WHERE firsts.least < strings.doc_id
), runs AS (
  SELECT r, b, max(e) AS e FROM (
    SELECT r, i, e, max(CASE WHEN before IS NULL OR i > before THEN i END) OVER (PARTITION BY r ORDER BY i) AS b FROM spans
  ) GROUP BY r, b
), kept AS (
  SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS upto FROM runs
), parts AS (
  SELECT texts.r, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last,
    string_agg(substr(x, 2 * upto + 1, 2 * (b - upto)), '' ORDER BY b) AS hexed
  FROM kept JOIN texts USING (r) GROUP BY texts.r
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(hexed, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN parts USING (r)
"""
