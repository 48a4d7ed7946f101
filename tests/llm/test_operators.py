import hashlib
import itertools
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeview.llm import ann, decontaminate, edits, groups, hmm, line_dedup, near_dedup, packing, quotes, suffix_dedup, toxicity, url_filter

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "se", "to") for b in ("la", "ren", "sto", "vi", "x", "dor", "ming")]
DOCS = "doc_id long, text string, id string, h long, score double"


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def corpus():
    """Prose, exact and near copies, shared passages, and the awkward rows: null, empty, blank, repeated, null id, long."""
    rng = np.random.default_rng(3)
    rows = [(i, "\n".join(prose(rng, int(rng.integers(8, 40))) for _ in range(int(rng.integers(1, 5))))) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(4)]
    words = rows[5][1].split(" ")
    rows += [(200 + i, " ".join(w if k != 7 + i else "qqq" for k, w in enumerate(words))) for i in range(4)]
    passage = prose(rng, 30)
    rows += [(300 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for i in range(5)]
    rows += [(400, None), (401, ""), (402, " \n\t\n"), (403, "é" * 60), (404, "a" * 300), (405, "a" * 300), (None, rows[8][1]), (None, None), (1, rows[1][1]), (406, prose(rng, 6000))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], DOCS)


def test_repeats_equal_brute_force(spark, corpus):
    got = suffix_dedup.remove_repeats(frame(spark, corpus).repartition(3)).collect()
    first = {}
    order = lambda i: math.inf if i is None else i
    for i, t in corpus:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], math.inf), order(i))
    want = []
    for i, t in corpus:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < order(i):
                gone[k : k + 50] = b"\1" * 50
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_equal_their_sql(spark, corpus):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    con = duckdb.connect()
    con.register("rows", pa.table({"doc_id": pa.array([i for i, _ in corpus], pa.int64()), "text": pa.array([t for _, t in corpus], pa.string())}))
    # a row without an id comes after all ids for the operator; SQL compares it with nothing
    whole = [r for r in con.sql(suffix_dedup.repeats_sql("rows")).fetchall() if r[0] is not None]
    got = suffix_dedup.remove_repeats(frame(spark, corpus)).select(*cols).where("doc_id is not null").collect()
    assert sorted(map(tuple, got)) == sorted(whole) and sum(r[2] for r in whole)


def test_suffix_ranks_are_the_order_of_the_strings():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data[200:300] = data[50:150]
    places = np.arange(0, 350)
    rank = suffix_dedup.suffix_ranks(data, places, None)
    strings = [data[p : p + 50].tobytes() for p in places]
    assert [strings[i] for i in np.argsort(rank, kind="stable")] == sorted(strings)
    assert len(set(rank.tolist())) == len(set(strings))


def bag(text):
    w = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())
    out = {}
    for s in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []:
        out[s] = out.get(s, 0) + 1
    return out


def merged(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_near_duplicates_equal_brute_force(spark, corpus):
    got = near_dedup.classes(frame(spark, corpus))
    bags = [bag(t) for _, t in corpus]
    links = []
    for a, b in itertools.combinations(range(len(corpus)), 2):
        x, y = bags[a], bags[b]
        both = sum(min(x[s], y[s]) for s in x if s in y)
        if (corpus[a][1] or "") == (corpus[b][1] or "") or x and y and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
            links.append((a, b))
    root = merged(len(corpus), links)
    want = []
    for k, (i, _) in enumerate(corpus):
        own = [corpus[m][0] for m in range(len(corpus)) if root[m] == root[k]]
        want.append((i, min((x for x in own if x is not None), default=None), len(own)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kept = near_dedup.keep_one(frame(spark, corpus))
    assert kept.columns == ["doc_id", "text", "id", "h", "score"] and kept.count() == len(set(root))
    assert near_dedup.classes(frame(spark, [])).count() == 0


def cloud(rng, n, size=150, most=40):
    """Copies of one text, each with up to ``most`` words replaced: most pairs share bands, few reach the threshold."""
    base = prose(rng, size).split(" ")
    out = []
    for k in range(n):
        words = list(base)
        for j, at in enumerate(rng.choice(size, int(rng.integers(0, most)), replace=False)):
            words[at] = f"w{k}x{j}"
        out.append(" ".join(words))
    return out


def test_a_cloud_of_near_misses_loses_no_link(spark, monkeypatch):
    rng = np.random.default_rng(21)
    texts = cloud(rng, 200, 150, 16) + cloud(rng, 40, 80, 4)
    held = []

    def counted(found, rows, near, once=None, own=groups._by_pairs):
        own(found, rows, near, once)
        held.append(sum(p.count() for p in found.pairs))

    monkeypatch.setattr(groups, "_by_pairs", counted)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, rows), 0.6).collect()}
    weights = near_dedup.idf_weights(frame(spark, rows))
    sides = [(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if near_dedup.similarity(sides[a], sides[b], weights)[0] >= 0.6 - 1e-9]
    root, least = merged(len(texts), links), {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, k), k)
    assert got == {k: least[r] for k, r in enumerate(root)}
    assert 20 < len(set(root)) < 200 and held[0] < 240 * 239 / 2 / 8, (len(set(root)), held)


def test_prefixes_of_linked_texts_meet():
    rng = np.random.default_rng(22)
    texts = [t.encode() for t in cloud(rng, 60, 60, 14) + [prose(rng, 40), "one two", "", "a b c d e f"]]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    weights, df = rng.uniform(0.4, 1, 1 << near_dedup.DF_BITS).astype(np.float32), rng.integers(0, 9, 1 << near_dedup.DF_BITS).astype(float)
    row, shingle, total, rest = near_dedup.prefixes(data, offsets, weights, df, 0.8)
    own = [{s: (t, r) for s, t, r in zip(shingle[row == k].tolist(), total[row == k], rest[row == k])} for k in range(len(texts))]
    linked = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        sides = [(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])])) for i in (a, b)]
        if near_dedup.similarity(*sides, weights)[0] >= 0.8:
            linked += 1
            assert any(min(own[a][s][1], own[b][s][1]) >= (own[a][s][0] + own[b][s][0]) * 0.8 / 1.8 - 1e-6 for s in own[a].keys() & own[b].keys())
    assert linked > 30


def test_icws_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(23)
    weights = rng.uniform(0.37, 1, 1 << near_dedup.DF_BITS).astype(np.float32)
    agree, want = [], []
    for _ in range(150):
        a = prose(rng, 120).split(" ")
        b = a[: int(rng.integers(70, 120))] + prose(rng, 20).split(" ")
        raw = [" ".join(x).encode() for x in (a, b)]
        _, bands = near_dedup.signatures(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])]), weights)
        agree.append((bands[0] == bands[1]).mean())
        j = near_dedup.similarity(*[(np.frombuffer(r, np.uint8), np.array([0, len(r)])) for r in raw], weights)[0]
        want.append(j**near_dedup.ROWS)
    assert np.mean(agree) == pytest.approx(np.mean(want), abs=0.04)


def test_icws_estimates_weighted_similarity():
    rng = np.random.default_rng(5)
    a = prose(rng, 400).split(" ")
    b = a[:300] + prose(rng, 100).split(" ")
    weights = np.ones(1 << near_dedup.DF_BITS, np.float32)
    sides = [(np.frombuffer(" ".join(x).encode(), np.uint8), np.array([0, len(" ".join(x))])) for x in (a, b)]
    exact = near_dedup.similarity(*sides, weights)[0]
    assert exact == pytest.approx(296 / (396 + 100), abs=0.02)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_equal_brute_force(spark, corpus):
    rows = corpus[:30] + corpus[40:62]
    long = " ".join(WORDS * 2)
    rows = rows + [(500, long + "\nshort line"), (501, long.replace(" rala ", " rala7 ") + "\nShort  LINE!"), (502, long.upper() + ".")]
    rows += [(503, "Total due now\nsubscribe here!"), (504, "total dues now\nSubscribe heer"), (505, "ab\nac"), (506, "x1")]
    got = line_dedup.dedup_lines(frame(spark, rows).withColumn("_lines", F.lit(1)).withColumn("th", F.lit(2)))
    agree = lambda a, b: sum((a ^ b) >> lo & ((1 << hi - lo) - 1) == 0 for lo, hi in zip(line_dedup.CUTS, line_dedup.CUTS[1:]))
    lines = []
    for k, (i, t) in enumerate(rows):
        for n, x in enumerate((t or "").split("\n")):
            norm = re.sub("[0-9]", "0", re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", x.translate({c: c + 32 for c in range(65, 91)}))).strip()
            if norm:
                raw = np.frombuffer(x.encode(), np.uint8)
                lines.append((i is None, i or 0, k, n, norm, int(line_dedup.line_records(raw, np.array([0, len(raw)]))[3][0])))
    links = [
        (a, b)
        for a, b in itertools.combinations(range(len(lines)), 2)
        for x, y in [(lines[a], lines[b])]
        if x[4] == y[4] or (x[5] ^ y[5]).bit_count() <= line_dedup.DISTANCE and agree(x[5], y[5]) >= 2 and edit(x[4], y[4]) <= 0.2 * max(len(x[4]), len(y[4]))
    ]
    root = merged(len(lines), links)
    first = {}
    for k in sorted(range(len(lines)), key=lambda k: lines[k][:2]):
        first.setdefault(root[k], k)
    same = lambda a, b: lines[a][:2] == lines[b][:2] and lines[a][3] == lines[b][3] and rows[lines[a][2]] == rows[lines[b][2]]
    gone = {(lines[k][2], lines[k][3]) for k in range(len(lines)) if not same(k, first[root[k]])}
    want = [(i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone)) for k, (i, t) in enumerate(rows)]
    assert got.columns == ["doc_id", "text", "id", "h", "score", "_lines", "th"]
    assert sorted(map(tuple, got.select("doc_id", "text").collect()), key=str) == sorted(want, key=str)
    assert {t for i, t in want if i in (504, 505, 506)} == {"", "ab\nac", "x1"}
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_boundaries_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.sort(rng.choice(200, 9, replace=False))
        counts = rng.integers(1, 50, 9)
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))
        best = min(cost([*x, lengths[-1]]) for k in range(4) for x in itertools.combinations(lengths[:-1], k))
        got = packing.best_boundaries(lengths, counts, 4)
        assert len(got) <= 4 and cost(got) == best


def test_packing_keeps_every_row_within_the_budget(spark, corpus):
    got = packing.pack(frame(spark, corpus), token_budget=256, buckets=5).toPandas()
    assert len(got) == len(corpus) and (got.padding >= 0).all()
    for (b, _), batch in got.groupby(["bucket", "batch_id"]):
        assert len(batch) == 1 or len(batch) * b <= 256 or b == 0
        assert sorted(batch.slot) == list(range(len(batch)))
    assert packing.pack(frame(spark, [])).count() == 0


def test_long_texts_have_exact_boundaries(spark):
    lengths = [20020, 9001, 9003, 8193, 40]
    got = packing.pack(frame(spark, [(i, "w " * n) for i, n in enumerate(lengths)]), buckets=len(lengths)).toPandas()
    assert sorted(got.bucket) == sorted(got.n_tokens) == sorted(lengths) and (got.padding == 0).all()


def test_tiling_finds_reordered_passages(spark, corpus):
    rng = np.random.default_rng(9)
    item = prose(rng, 30).split(" ")
    other = prose(rng, 30)
    docs = [(1, "x y z " + " ".join(item) + " tail"), (2, " ".join(item[15:]) + " in between " + " ".join(item[:15])), (3, " ".join(item[:6])), (4, None), (5, ""), (None, " ".join(item).upper())]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, other), (9, ""), (None, None)], "item_id long, text string")
    got = decontaminate.leaks(frame(spark, docs + corpus), bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_tiles) for r in got), key=str) == [(1, 7, 1), (2, 7, 2), (None, 7, 1)]
    assert decontaminate.clean(frame(spark, docs), bench, block_words=10).count() == 3
    assert decontaminate.leaks(frame(spark, docs), bench.limit(0)).count() == 0


def tiled(item, doc, size):
    """(words, tiles) that greedy string tiling marks: in each round every pair of places, the longest run first."""
    marked_item, marked_doc, covered, count = [False] * len(item), [False] * len(doc), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not marked_item[i + n] and not marked_doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < size:
            return covered, count
        marked_item[i : i + n] = marked_doc[j : j + n] = [True] * n
        covered, count = covered + n, count + 1


def test_tiling_equals_brute_force(spark):
    rng = np.random.default_rng(21)
    items = [(f"i{k}", [str(w) for w in rng.choice(WORDS, n)]) for k, n in enumerate((1, 3, 5, 9, 16, 30, 30))]
    items.append(("twice", items[4][1] * 2))
    docs = []
    for k in range(60):
        words = [str(w) for w in rng.choice(WORDS, 4)]
        for _ in range(int(rng.integers(0, 5))):
            source = items[int(rng.integers(0, len(items)))][1]
            a = int(rng.integers(0, len(source)))
            words += source[a : a + int(rng.integers(1, 20))] + [str(w) for w in rng.choice(WORDS, int(rng.integers(0, 3)))]
        docs.append((k, words))
    docs += [(100, items[5][1] * 2), (101, ["ba"] * 40), (102, items[0][1] * 3), (102, items[0][1] * 3)]
    got = decontaminate.leaks(
        frame(spark, [(i, " ".join(w).upper()) for i, w in docs]).repartition(3), spark.createDataFrame([(k, ", ".join(w), 1) for k, w in items], "item_id string, text string, doc_id int"), block_words=40
    )
    want = []
    for i, words in docs:
        for k, item in items:
            covered, count = tiled(item, words, min(decontaminate.MIN_TILE, len(item)))
            if covered >= 0.5 * len(item):
                want.append((i, k, covered, len(item), covered / len(item), count))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20 and max(w[5] for w in want) > 1


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(2000 + i, [float(v) for v in x[100]]) for i in range(30)]
    odd = [(3000, None), (3100, []), (3200, [0.0] * 8), (3300, [float("nan")] * 8), (3400, [None] * 8), (None, [1.0] * 8), (3500, [1.0, 2.0])]
    got = ann.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).toPandas()
    hits = total = 0
    full = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((full - full[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and q not in set(own.vec_id)
        hits, total = hits + len(set(own.vec_id) & set(want)), total + 10
        assert np.allclose(own.score, [d[ids == v][0] for v in own.vec_id], rtol=1e-12)
    assert hits / total >= 0.9 and set(got.query_id) == set(ids[ids % 100 == 0])
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    bad = ["idiot", "moron", "scum"]
    disguise = lambda w: rng.choice([w, w.replace("o", "0").replace("i", "1"), " ".join(w), w[0] + w[1] * 4 + w[2:]])
    rows, labels = [], []
    for i in range(1200):
        words, toxic = list(rng.choice(WORDS, 60)), i % 5 == 0
        if toxic:
            for k in (10, 25, 40):
                words[k] = str(disguise(rng.choice(bad)))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "x")]
    docs = frame(spark, rows)
    table = spark.createDataFrame(labels + [(None, 1), (7000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table.where(~toxicity.held_out()))
    got = toxicity.score(docs, model, "s").withColumn("held", toxicity.held_out()).toPandas()
    held = got[got.held & (got.doc_id < 1200)]
    assert ((held.s >= 0.5) == (held.doc_id % 5 == 0)).mean() > 0.95
    assert len(got) == len(rows) and got.s.between(0, 1).all()
    assert toxicity.restore("an 1diot, a m0r0n and an i d i o t", model.chars) == "an idiot, a moron and an idiot"
    empty = toxicity.fit(docs.limit(0), table.limit(0))
    assert toxicity.score(docs.limit(0), empty, "s").count() == 0


def test_disguises_at_ends_and_between_blanks():
    rng = np.random.default_rng(12)
    plain = " ".join(rng.choice(["idiot", "ass", "trash", "loser", "moron", *WORDS[:20]], 20_000))
    texts = [plain, "note (here) and there! it ends, 40% more", "a b c", ""]
    chars = toxicity.char_model(toxicity.char_counts([pa.record_batch([pa.array(texts)], ["text"])]))
    want = {"1d10t": "idiot", "l0$3r": "loser", "7r4$h": "trash", "a$$": "ass", "idio7": "idiot", "an idio7.": "an idiot.", "i d 1 o t": "idiot", "1 d 1 o t": "idiot", "a $ $": "ass", "m.0.r.0.n": "moron", "!d!ot": "idiot"}
    assert {k: toxicity.restore(k, chars) for k in want} == want
    assert [toxicity.restore(t, chars) for t in ("idiot! (moron) 40% 1 2 3 4 apples, a b c", "")] == ["idiot! (moron) 40% 1 2 3 4 apples, a b c", ""]
    pool = np.array(list("aabdiost  .-_*,'()!$@01347é\n\x1f"))
    rows = ["".join(rng.choice(pool, int(rng.integers(0, 12)))) for _ in range(4000)] + list(want)
    raw = [r.encode() for r in rows]
    got = toxicity._suspects(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    changed = np.array([toxicity.restore(r, chars) != r for r in rows])
    assert changed.sum() > 500 and not (changed & ~got).any(), [r for r, c, g in zip(rows, changed, got) if c and not g][:5]


def test_hmm(spark, corpus):
    rng = np.random.default_rng(8)
    normal = lambda *n: (lambda a: a / a.sum(-1, keepdims=True))(rng.random(n))
    emit = np.zeros((hmm.SYMBOLS + 1, 3))
    emit[:4] = normal(3, 4).T
    model = hmm.Model(normal(3), normal(3, 3), emit)
    seqs = [np.array(s, np.uint16) for s in ([0], [1, 2], [3, 0, 2, 1, 1], [2, 2, 2])]

    def brute(s):
        return sum(model.start[p[0]] * emit[s[0], p[0]] * math.prod(model.move[p[k - 1], p[k]] * emit[s[k], p[k]] for k in range(1, len(s))) for p in itertools.product(range(3), repeat=len(s)))

    assert np.allclose(hmm.forward(model, seqs), [math.log(brute(s)) for s in seqs])
    got = hmm.expected(model, seqs, longest=100)
    paths = [(s, p, model.start[p[0]] * emit[s[0], p[0]] * math.prod(model.move[p[k - 1], p[k]] * emit[s[k], p[k]] for k in range(1, len(s)))) for s in seqs for p in itertools.product(range(3), repeat=len(s))]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for s, p, w in paths:
        w /= brute(s)
        starts[p[0]] += w
        for k, x in enumerate(s):
            emits[x, p[k]] += w
            if k:
                moves[p[k - 1], p[k]] += w
    assert np.allclose(got[:3], starts) and np.allclose(got[3:12].reshape(3, 3), moves) and np.allclose(got[12:24].reshape(4, 3), emits)
    assert got[-1] == pytest.approx(hmm.forward(model, seqs).sum())
    train = (F.coalesce(F.col("doc_id"), F.lit(0)) % 5) != 1
    got = hmm.score(frame(spark, corpus), train, rounds=1).toPandas()
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\0"]
    counts = {}
    for i, t in corpus:
        if (i or 0) % 5 != 1:
            for w in token(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(token(t)), sum(w in counts for w in token(t)), round(sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in token(t)), 6)) for _, t in corpus)
    assert sorted(zip(got.n_tokens, got.n_known, got.base_score.round(6))) == want
    assert (got.train_tokens == n).all() and np.isfinite(got.score).all() and (got.score < 0).all()
    assert hmm.score(frame(spark, []), train, rounds=1).count() == 0


def test_hmm_learns_from_whole_texts(spark):
    rng = np.random.default_rng(10)
    normal = lambda *n: (lambda a: a / a.sum(-1, keepdims=True))(rng.random(n))
    emit = np.zeros((hmm.SYMBOLS + 1, 3))
    emit[:4] = normal(3, 4).T
    model = hmm.Model(normal(3), normal(3, 3), emit)
    seqs = [rng.integers(0, 4, n).astype(np.uint16) for n in (1300, 700, 40, 1, 13, 26)]
    whole = hmm.expected(model, seqs)
    assert whole[:3].sum() == pytest.approx(len(seqs)) and whole[3:12].sum() == pytest.approx(sum(map(len, seqs)) - len(seqs))
    assert whole[-1] == pytest.approx(hmm.forward(model, seqs).sum())
    assert all(np.allclose(hmm.expected(model, seqs, longest=k), whole) for k in (1, 13, 512))
    # the first guess sees every token of every text: symbols at the end of a long text and in a text beyond the 2,000th
    share = np.full(hmm.SYMBOLS + 1, 1 / (hmm.SYMBOLS + 1))
    texts = [np.r_[np.zeros(3000), np.full(3000, 7)]] + [np.full(3, k % 5) for k in range(2500)]
    df = spark.createDataFrame([(x.astype("<u2").tobytes(),) for x in texts], "ids binary").repartition(3)
    guess = hmm.first_guess(df, share, 2)
    assert guess.start.sum() == pytest.approx(1) and guess.emit.sum(0) == pytest.approx(np.ones(2)) and guess.emit[7].max() > 0.3
    a = hmm.mixture_counts([x.astype(np.int64) for x in texts], guess.start, guess.emit)
    assert a[:2].sum() == pytest.approx(len(texts)) and a[2:].sum() == pytest.approx(sum(map(len, texts)))


def test_hmm_steps_do_not_follow_the_longest_text_of_each_run(monkeypatch):
    """Texts of like length step together: a long text among short ones costs its own steps once, and the counts stay."""
    rng = np.random.default_rng(11)
    normal = lambda *n: (lambda a: a / a.sum(-1, keepdims=True))(rng.random(n))
    emit = np.zeros((hmm.SYMBOLS + 1, 3))
    emit[:4] = normal(3, 4).T
    model = hmm.Model(normal(3), normal(3, 3), emit)
    seqs = [rng.integers(0, 4, 3000 if k % 50 == 7 else int(rng.integers(1, 40))).astype(np.uint16) for k in range(500)]
    runs = hmm._alike(seqs, 4000)
    assert sorted(np.concatenate(runs).tolist()) == list(range(500)) and all(sum(len(seqs[k]) for k in r) <= 4000 + 3000 for r in runs)
    assert np.allclose(sum(hmm.expected(model, [seqs[k] for k in r]) for r in runs), hmm.expected(model, seqs))
    mixed = [max(map(len, seqs[k : k + 50])) for k in range(0, 500, 50)]
    monkeypatch.setattr(hmm, "HOLD", 10_000)
    assert len(hmm._alike(seqs)) > 2 and sum(max(len(seqs[k]) for k in r) for r in hmm._alike(seqs)) < 0.5 * sum(mixed)
    # sums a state at a time are those over whole rows
    logs = np.log(emit + 1e-3)
    assert np.allclose(hmm.distances(seqs, logs), [logs[x].sum(0) for x in seqs])


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "> Hello there.\n> How are you?\nFine thanks!\n\nAnd you?"), (1, 2, "u", "> > how are YOU\n> Fine thanks!\nGood"),
        (1, 3, "a", "new topic"), (1, 4, "u", "> nothing here\nxx"), (1, 5, "u", "> Good\n>> fine thanks\nok"), (None, 1, "u", "> a"), (2, 0, "u", None), (2, 0, "u", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit(1))
    got = [tuple(r)[0:2] + (r.text, r.n_quotes, r.n_linked, r.reply_to, r.thread, r.depth) for r in quotes.link_quotes(df).collect()]
    assert (1, 1, "Fine thanks!\n\nAnd you?", 1, 1, 0, 0, 1) in got and (1, 2, "Good", 2, 2, 1, 0, 2) in got and (1, 5, "ok", 2, 2, 2, 0, 3) in got
    assert (1, 4, "xx", 1, 0, None, 4, 0) in got and (None, 1, "", 0, 0, None, 1, 0) in got and got.count((2, 0, "", 0, 0, None, 0, 0)) == 2
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_partial_quotes(spark):
    lines = ["We leave at nine.", "Bring a coat", "and good shoes.", "Lunch is paid. Dinner is not.", "Bus 7 goes there."]
    rows = [
        (1, 0, "\n".join(lines)), (1, 1, "One and two.\n\nThree here\nand four.\n\nFive."), (1, 2, "> Bring a coat\n> and good shoes.\nWhy?"), (1, 3, "> One and two.\n>\n> Three here\n> and four.\nyes"),
        (1, 4, "> dinner is not\nPity"), (1, 5, "> We leave at nine.\n> [...]\n> Bus 7 goes there.\nok"), (1, 6, "> and good shoes.\n> Bring a coat\nturned"), (1, 7, "> Lunch is paid. Dinner is not.\n> Bus 7 goes there.\n>> Pity\nlast"),
        (1, 8, "> Bring a coat\n> Five.\nof two messages"), (1, 9, "> see later\n> and more\nx"), (1, 10, "first\nsee later\nand more\nend"), (2, 1, "> Bring a coat\n> and good shoes.\nelsewhere"), (1, 11, "Bring a coat\nand good shoes."),
        (1, 12, "> Bring a coat\n> and good shoes.\nagain"),
    ]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.reply_to, r.thread) for r in quotes.link_quotes(df).collect()}
    assert got[1, 2] == (1, 1, 0, 0) and got[1, 3] == (1, 1, 1, 1) and got[1, 4] == (1, 1, 0, 0) and got[1, 5] == (1, 1, 0, 0) and got[1, 12] == (1, 1, 0, 0)
    assert got[1, 6] == (1, 0, None, 6) and got[1, 7] == (2, 2, 0, 0) and got[1, 8] == (1, 0, None, 8) and got[1, 9] == (1, 0, None, 9) and got[2, 1] == (1, 0, None, 1)


def test_urls(spark):
    urls = ["https://A.example.org/en/1?x", "http://b.example.org/en/2", "http://x.example.org/es/9", "http://q.com/fr/1", "http://q.com/de/1#t", "http://q.com", "no url", None, "http://bad.net/spam/1", "http://bad.net/spam/2", "http://bad.net/ok/1"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(100 + i, f"http://bad.net/spam/{i}") for i in range(40)] + [(200 + i, f"http://bad.net/ok/{i}") for i in range(40)] + [(None, "http://bad.net/ok/1")], "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(100 + i, 0) for i in range(30)] + [(200 + i, 1) for i in range(30)] + [(None, 0), (8, None)], "page_id long, good int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, labels).collect() if r.page_id is not None}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(6)] == [
        ("a.example.org", "/en/1", "example.org/en/1", "block"), ("b.example.org", "/en/2", "org/", "allow"), ("x.example.org", "/es/9", "example.org/es/", "block"),
        ("q.com", "/fr/1", "com/fr/", "allow"), ("q.com", "/de/1", "com/de/", "block"), ("q.com", "", None, got[5].verdict),
    ]
    assert (got[6].host, got[6].path, got[7].host, got[7].path) == ("", "", "", "")
    assert got[8].verdict == got[139].verdict == "block" and got[10].verdict == "allow" and got[8].template == "/spam/*"
    assert url_filter.judge_urls(pages.limit(0), labels.limit(0)).count() == 0


def test_deep_siblings_are_merged(spark):
    # under /shop the branches en and de are alike and bad, fr has no labels; the rest of the host is good
    kinds = [("shop/en/offer", 0, 30), ("shop/de/offer", 0, 30), ("shop/fr/offer", None, 5), ("help/en/text", 1, 60)]
    rows = [(f"http://h.org/{p}/{i}", g) for p, g, n in kinds for i in range(n)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(k, g) for k, (_, g) in enumerate(rows) if g is not None], "page_id long, good int")
    got = {r.path.rsplit("/", 1)[0]: (r.template, r.verdict) for r in url_filter.judge_urls(pages, labels, rules=[]).collect()}
    assert got["/shop/fr/offer"] == got["/shop/en/offer"] == got["/shop/de/offer"] == ("/{}/{}/offer/*", "block") and got["/help/en/text"][1] == "allow"


def test_lines_of_edit_similarity_meet():
    """The share of pairs at edit similarity 0.8 or more that block SimHashes bring together, by words and kind of edit."""
    rng = np.random.default_rng(1)

    def changed(words, kind, k):
        words = list(words)
        for _ in range(k):
            at = int(rng.integers(0, len(words)))
            w = words[at]
            if kind == "letter":
                i = int(rng.integers(0, len(w)))
                words[at] = w[:i] + str(rng.choice(list("qxz"))) + w[i + int(rng.integers(0, 2)) :]
            elif kind == "word":
                words[at] = str(rng.choice(WORDS))
            elif kind == "more":
                words.insert(at, str(rng.choice(WORDS)))
            elif len(words) > 1:
                del words[at]
        return words

    met, total = {}, {}
    for n in (1, 2, 3, 4, 6, 10, 15, 25, 50):
        for kind, most in (("letter", 1), ("letter", 2), ("word", 1), ("more", 1), ("less", 1)):
            pairs = []
            for _ in range(300):
                a = [str(w) for w in rng.choice(WORDS, n)]
                b = changed(a, kind, most)
                x, y = " ".join(a), " ".join(b)
                if x != y and line_dedup.within(x, y, int(0.2 * max(len(x), len(y)) + 1e-9)):
                    pairs += [x.encode(), y.encode()]
            if not pairs:
                continue
            sim = line_dedup.line_records(np.frombuffer(b"".join(pairs), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pairs])]))[3]
            d = sim[::2] ^ sim[1::2]
            same = sum((d >> np.uint64(lo) & np.uint64((1 << hi - lo) - 1) == 0).astype(int) for lo, hi in zip(line_dedup.CUTS, line_dedup.CUTS[1:]))
            hit = (same >= 2) & (np.bitwise_count(d) <= line_dedup.DISTANCE)
            met[n] = met.get(n, 0) + hit.sum()
            total[n] = total.get(n, 0) + len(hit)
    share = {n: met[n] / total[n] for n in met}
    assert sum(met.values()) / sum(total.values()) >= 0.9 and min(share.values()) >= 0.65, (sum(met.values()) / sum(total.values()), share)


def test_bounded_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = "".join(rng.choice(list("abé\U0001f600 "), rng.integers(0, 40)))
        b = list(a)
        for _ in range(rng.integers(0, 12)):
            k = int(rng.integers(0, len(b) + 1))
            b[k : k + int(rng.integers(0, 2))] = rng.choice(list("abx"), rng.integers(0, 2)).tolist()
        b = "".join(b)
        assert all(line_dedup.within(a, b, m) == (edit(a, b) <= m) for m in (0, 1, 3, 7, 40)), (a, b)


def test_edit_distances_of_many_pairs_equal_single_ones(monkeypatch):
    monkeypatch.setattr(edits, "FEW", 0)
    rng = np.random.default_rng(12)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz 0éж"))
    texts = []
    for k in range(600):
        x = rng.choice(letters, int(rng.choice([1, 3, 20, 63, 64, 65, 128, 129, 300, 1600]))).tolist()
        y = list(x)
        for i in rng.integers(0, len(y), int(len(y) * rng.random() * 0.3)).tolist():
            y[i] = str(rng.choice(["", "q", "xy"]))
        if k % 4 == 0:
            y = rng.choice(letters, len(x)).tolist() + x[-len(x) // 3 :]
        texts += ["".join(x), "".join(y) + "漢" * (k % 50 == 0)]
    a = np.arange(0, len(texts), 2)
    most = np.array([int(max(len(texts[i]), len(texts[i + 1])) * 0.2 + 1e-9) for i in a])
    got = edits.within_pairs(edits.Coded(pa.array(texts)), a, a + 1, most, line_dedup.within)
    assert got.tolist() == [line_dedup.within(texts[i], texts[i + 1], int(m)) for i, m in zip(a, most)]


def test_near_copies_are_told_without_a_table():
    """One way of writing a text as the other proves a link; it never proves one that is none, and few pairs of each width go together."""
    rng = np.random.default_rng(15)
    texts = []
    for k in range(300):
        x = prose(rng, int(rng.integers(2, 150))).split(" ")
        y = [str(rng.choice(WORDS)) if rng.random() < 0.03 * (k % 12) else w for w in x if rng.random() > 0.01 * (k % 5)]
        texts += [" ".join(x), " ".join(y) + ("" if k % 7 else " x")]
    a = np.arange(0, len(texts), 2)
    coded = edits.Coded(pa.array(texts))
    far = np.array([edit(x, y) for x, y in zip(texts[::2], texts[1::2])])
    size = np.maximum(coded.size[a], coded.size[a + 1])
    m, n = coded.size[a], coded.size[a + 1]
    for most in ((size * 0.2).astype(np.int64), far - 1, far):
        sure = edits._surely(coded, coded.start[a], m, coded.start[a + 1], n, most)
        assert not sure[far > most].any()
        asked = []
        got = edits.within_pairs(coded, a, a + 1, most, lambda x, y, k: asked.append(x) or line_dedup.within(x, y, k))
        assert (got == (far <= most)).all() and len(asked) < 150, len(asked)
    sure = edits._surely(coded, coded.start[a], m, coded.start[a + 1], n, (size * 0.2).astype(np.int64))
    assert sure[far <= size * 0.1].mean() > 0.9


def test_lines_that_meet_by_chance_do_not_go_on():
    """Rows that a bucket sends on are those whose sign counts allow a link: no link is lost, and most strangers stay behind."""
    rng = np.random.default_rng(14)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0éж漢\U0001f600"))
    word = lambda: "".join(rng.choice(letters, rng.integers(1, 9)))
    pairs = []
    for k in range(400):
        x = [word() for _ in range(rng.integers(1, 120))]
        y = list(" ".join(x))
        for i in rng.integers(0, len(y), int(len(y) * rng.random() * 0.3)).tolist():
            y[i] = str(rng.choice(["", "q", "xy", "é", " "]))
        pairs += [" ".join(x), " ".join("".join(y).split()) or "q"] if k % 2 else [" ".join(x), " ".join(x[:4] + [word() for _ in x[4:]])]
    raw = [t.encode() for t in pairs]
    records = line_dedup.line_records(np.frombuffer(b"\n".join(raw), np.uint8), np.array([0, sum(map(len, raw)) + len(raw) - 1]))
    chars, signs = records[4].astype(np.int64), records[8]
    one = np.concatenate([line_dedup.line_records(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[8] for r in raw], axis=1)
    assert (signs == one).all() and chars.tolist() == [len(t) for t in pairs]
    may = line_dedup.may_link(signs[:, ::2], signs[:, 1::2], chars[::2], chars[1::2])
    coded = edits.Coded(pa.array(pairs))
    least = coded.least(np.arange(0, len(pairs), 2), np.arange(1, len(pairs), 2))
    far = [edit(x, y) for x, y in zip(pairs[::2], pairs[1::2])]
    link = np.array([d <= 0.2 * max(len(x), len(y)) + 1e-9 for d, x, y in zip(far, pairs[::2], pairs[1::2])])
    assert (least <= far).all() and may[link].all() and link.sum() > 50 and not may.all()

    # buckets of two strangers with equal SimHashes; before, all of them went on
    lines = [" ".join(str(w) for w in rng.choice(WORDS, 12)) for _ in range(400)]
    texts = [t for k, x in enumerate(lines) for t in ([x, x[:-1]] if k % 40 == 0 else [x])]
    bucket = np.array([k // 2 * 16 for k, x in enumerate(lines) for _ in range(2 if k % 40 == 0 else 1)])
    raw = "\n".join(texts).encode()
    records = line_dedup.line_records(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    kept = line_dedup._close(bucket, np.zeros(len(texts), np.int64), records[4].astype(np.int64), records[8])
    pair = np.array([x == y[:-1] or y == x[:-1] for x, y in zip(texts, texts[1:])])
    assert pair.sum() == 10 and kept[:-1][pair].all() and kept[1:][pair].all() and kept.mean() < 0.5, kept.mean()


def test_lines_with_one_end_are_not_joined_in_pairs(spark, monkeypatch):
    """Strangers with one long end share a bucket; no table holds a row for each of their pairs, and links across the parts of a bucket are kept."""
    rng = np.random.default_rng(13)
    end = prose(rng, 16)
    lines = [prose(rng, 14) + " " + end for _ in range(150)]
    lines += [" ".join("qq" if k == n % 12 else w for k, w in enumerate(t.split(" "))) for n, t in enumerate(lines[:40])]
    sizes, own = [], line_dedup.written
    for module in (line_dedup, groups):
        monkeypatch.setattr(module, "written", lambda df: sizes.append((t := own(df)).count()) or t)
    monkeypatch.setattr(line_dedup, "WIDE", 16)
    rows = frame(spark, list(enumerate(lines)))
    _, got = line_dedup.groups(rows)
    norm = [line_dedup.line_records(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in lines]
    sims, own_h = [int(r[3][0]) for r in norm], [int(r[2].view(np.int64)[0]) for r in norm]
    same = lambda d: sum(d >> lo & ((1 << hi - lo) - 1) == 0 for lo, hi in zip(line_dedup.CUTS, line_dedup.CUTS[1:]))
    near = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if (sims[a] ^ sims[b]).bit_count() <= line_dedup.DISTANCE and same(sims[a] ^ sims[b]) >= 2]
    links = [(a, b) for a, b in near if line_dedup.within(lines[a], lines[b], int(max(len(lines[a]), len(lines[b])) * 0.2 + 1e-9))]
    root = merged(len(lines), links)
    want = {frozenset(own_h[k] for k in range(len(lines)) if root[k] == r) for r in root}
    found = {}
    for r in got.collect():
        found.setdefault(r.group, set()).add(r.h)
    assert {frozenset(g) for g in found.values() if len(g) > 1} == {g for g in want if len(g) > 1}
    assert len(near) > 10 * len(lines) and max(sizes) < len(near)


def test_packs_of_a_task_send_each_shard_one_row():
    out, shards = suffix_dedup._Outbox(), np.repeat(np.arange(50), 2)
    keys = [np.arange(100, dtype=np.uint64) + np.uint64(1000 * f) for f in range(30)]
    for f in range(30):
        out.add(f, shards, keys[f])
    rows = [r for b in out.flush() for r in b.to_pylist()]
    assert len(rows) == 50 and not list(out.flush())
    for r in rows:
        assert np.frombuffer(r["packs"], "<i8").tolist() == list(range(30)) and np.frombuffer(r["sizes"], "<i8").tolist() == [2] * 30
        assert np.frombuffer(r["keys"], "<u8").tolist() == [int(k) for f in range(30) for k in keys[f][2 * r["shard"] : 2 * r["shard"] + 2]]


def test_repeats_do_not_depend_on_what_is_sent_together(spark, corpus, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 2000)
    together = sorted(map(tuple, suffix_dedup.remove_repeats(frame(spark, corpus).coalesce(1)).collect()), key=str)
    monkeypatch.setattr(suffix_dedup, "OUTBOX_BYTES", 1)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(frame(spark, corpus).repartition(5)).collect()), key=str) == together


def test_rows_of_buckets_travel_packed(monkeypatch):
    """Ten rows a line are dealt many in one; the rows that go on are those of all pairs, also where a part is too long to hold."""
    rng = np.random.default_rng(16)
    texts = [prose(rng, int(rng.integers(3, 40))) for _ in range(300)]
    texts += [t[:-1] for t in texts[:60]] + [" ".join(t.split(" ")[:1] + ["q"] + t.split(" ")[2:]) for t in texts[40:90]]
    end = prose(rng, 16)
    texts = sorted({*texts, *(prose(rng, 3) + " " + end for _ in range(40))})
    raw = "\n".join(texts).encode()
    records = line_dedup.line_records(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    sim, chars, signs = records[3], records[4].astype(np.int64), records[8]
    assert len(sim) == len(texts)

    def met():
        columns = [pa.array(x.view(np.int64)) for x in (sim, chars, *signs)]
        lines = pa.RecordBatch.from_arrays(columns, names=["sim", "chars", "signs", "signs2"])
        dealt = pa.Table.from_batches(line_dedup._dealt(8)(lines.slice(k, 50) for k in range(0, len(sim), 50)))
        rows = [r for b in line_dedup._met(iter(dealt.sort_by("part").to_batches(max_chunksize=3))) for r in b.to_pylist()]
        return dealt.num_rows, sorted((r["bucket"], r["sim"]) for r in rows)

    want = set()
    for k, (i, j) in enumerate(line_dedup.PAIRS):
        cut = lambda s, c: s >> line_dedup.CUTS[c] & (1 << line_dedup.CUTS[c + 1] - line_dedup.CUTS[c]) - 1
        bucket = [(cut(int(s), i) << 13 | cut(int(s), j)) << 4 | k for s in sim]
        for a, b in itertools.combinations(range(len(sim)), 2):
            if bucket[a] != bucket[b] or (int(sim[a]) ^ int(sim[b])).bit_count() > line_dedup.DISTANCE or min(chars[a], chars[b]) < 0.8 * max(chars[a], chars[b]) - 1e-9:
                continue
            if line_dedup._first_key(sim[a : a + 1] ^ sim[b : b + 1])[0] == k and line_dedup.may_link(signs[:, a : a + 1], signs[:, b : b + 1], chars[a : a + 1], chars[b : b + 1])[0]:
                want |= {(bucket[x], int(sim[x].view(np.int64))) for x in (a, b)}
    n, got = met()
    assert len(want) > 100 and set(got) == want and n <= 16
    monkeypatch.setattr(line_dedup, "LONG", 4)
    some = met()[1]
    assert set(some) > want
    for name, value in (("HELD", 40), ("STEP", 16), ("PACKED", 7), ("DEALT", 30)):
        monkeypatch.setattr(line_dedup, name, value)
        assert met()[1] == some, name


def test_texts_of_lines_are_normalised_as_bytes():
    rng = np.random.default_rng(17)
    signs = list("aZ09 \t.-é漢\U0001f600\x7f\x80")
    for _ in range(100):
        lines = ["".join(rng.choice(signs, rng.integers(0, 12))) for _ in range(rng.integers(1, 30))]
        data = np.frombuffer("\n".join(lines).encode(), np.uint8)
        records = line_dedup.line_records(data, np.array([0, len(data)]), hashed=False)
        some = np.flatnonzero(rng.random(len(records[0])) < 0.7)
        norm = [re.sub("[0-9]", "0", re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", lines[k].translate({c: c + 32 for c in range(65, 91)}))).strip(" ") for k in records[1][some]]
        assert line_dedup.normalised(data, records[6][some], records[7][some]).to_pylist() == norm


def test_edit_distances_in_a_band_are_exact(monkeypatch):
    """Texts whose best way leads along the edge of the band, at the bound itself and one under it, in columns of one word and of many."""
    monkeypatch.setattr(edits, "FEW", 0)
    monkeypatch.setattr(edits, "_surely", lambda coded, xs, m, ys, n, most: np.zeros(len(m), bool))
    rng = np.random.default_rng(18)
    letters = np.array(list("abcdefgh ij"))
    texts = []
    for k in range(120):
        x = rng.choice(letters[: rng.integers(2, 12)], int(rng.choice([5, 40, 64, 65, 130, 260, 500])) + int(rng.integers(0, 20))).tolist()
        cut = int(len(x) * 0.15)
        new = rng.choice(letters, int(len(x) * rng.random() * 0.2)).tolist()
        y = [x[cut:] + new, new + x, x[: len(x) // 2] + new + x[len(x) // 2 + cut :], [c if rng.random() > 0.2 else "q" for c in x]][k % 4]
        texts += ["".join(x), "".join(y)]
    a = np.arange(0, len(texts), 2)
    coded = edits.Coded(pa.array(texts))
    far = np.array([edit(x, y) for x, y in zip(texts[::2], texts[1::2])])
    for most in (far - 1, far, far + 2, (np.maximum(coded.size[a], coded.size[a + 1]) * 0.2).astype(np.int64)):
        assert (edits.within_pairs(coded, a, a + 1, most, line_dedup.within) == (far <= most)).all()
        assert all(line_dedup.within(texts[i], texts[i + 1], int(m)) == (d <= m) for i, m, d in zip(a, most, far))


def test_counts_of_bits_in_words_equal_those_of_single_bits():
    """Runs of under 256 features are counted eight bits in a word; a longer line beside them has all counted one by one."""
    rng = np.random.default_rng(19)
    counts = np.array([1, 3, 5, 9, 10, 40, 255, 400])
    h = rng.integers(0, 1 << 63, int(counts.sum()), dtype=np.uint64)
    h[::3] |= np.uint64(0xFFFF)
    long = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    alone = line_dedup.block_hashes(h, counts)
    assert (alone == line_dedup.block_hashes(np.append(h, long), np.append(counts, 5000))[:-1]).all() and len(set(alone.tolist())) == len(counts)
