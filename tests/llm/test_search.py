"""Whitening, lexical search and top-k against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from authscope.llm import lexical, topk, vectors, whitening
from authscope.llm.common import load_documents

SF = "/root/testdata/sf0.001"
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("ids", T.StringType()), T.StructField("score", T.StringType())])
NAN, INF = float("nan"), float("inf")


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], "x", None) for i, v in rows], VECTORS).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    out = [(i, r.normal(0, 0.2, 6).round(3).tolist()) for i in range(900)]
    same = [0.5, -0.25, 0.0, 0.125, 0.3, -0.1]
    out += [(i, same) for i in range(900, 960)]  # a great many ties
    out += [(700, same), (700, [0.1] * 6), (None, same), (None, [0.2] * 6)]
    return out + [(1000, None), (1001, []), (1002, [0.1, None, 0, 0, 0, 0]), (1003, [NAN] + [0.0] * 5), (1004, [INF] + [0.0] * 5), (1100, [1.0, 2.0]), (1200, [-0.0] * 6)]


def took_part(rows):
    return [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]


def brute_topk(rows, every, k):
    out, part = [], took_part(rows)
    for q, a in part:
        if q is not None and q % every == 0:
            found = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0, i) for i, b in part if i != q]
            out += [(q, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("size", [1, 1e6])
def test_topk_matches_brute_force(spark, rows, size):
    """Also where sums leave the range of doubles, or only some blocks' do, and with repeated ids, ties and odd vectors."""
    big = [(i, v and [c and c * size if i is None or i < 500 else c for c in v]) for i, v in rows]
    got = topk.search(table(spark, big), 50, 7)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_topk(big, 50, 7)


def test_topk_small_blocks(rows):
    """Blocks of few rows, one after the other, as a task reads them; the bound keeps whole blocks out."""
    part = took_part(rows)
    ids = np.array([vectors.NO_ID if i is None else i for i, _ in part])
    x = np.array([v for _, v in part], float)
    at = np.flatnonzero((ids % 50 == 0) & (ids != vectors.NO_ID))
    best, read = topk.Best(ids[at], x[at], 7), 0
    for a in range(0, len(ids), 64):
        read += topk.read_block(best, ids[a : a + 64], x[a : a + 64], np.argsort(x[a : a + 64], axis=0, kind="stable"))
    got = [(int(q), r + 1, None if f == vectors.NO_ID else int(f), int(s)) for q, fs, ss in zip(best.ids, best.found, best.scores) for r, (f, s) in enumerate(zip(fs, ss))]
    assert sorted(map(str, got)) == brute_topk(rows, 50, 7)
    low = topk.Best(np.array([1]), np.full((1, 6), 1000.0), 1)
    topk.read_block(low, np.array([2]), np.full((1, 6), 500.0), np.zeros((1, 6), int))
    assert topk.read_block(low, np.arange(3, 67), x[:64] / 10, np.argsort(x[:64], axis=0)) == 0


def test_topk_without_rows(spark):
    assert topk.search(table(spark, [])).count() == 0
    assert topk.search(table(spark, [(1, [0.5])])).count() == 0
    assert topk.search(table(spark, [(100, [0.5])])).count() == 0
    assert [tuple(r) for r in topk.search(table(spark, [(100, [0.5]), (1, [0.25])])).collect()] == [(100, 1, 1, 512 * 256)]


def whitened(spark, rows, k=8):
    got = whitening.whiten(table(spark, rows), k).collect()
    return got, sorted({(r.component, r.explained) for r in got})


def test_whitening_matches_eigenvectors(spark, rows):
    part = took_part(rows)
    x = np.array([v for _, v in part], float) + 100_000
    e, vectors_ = np.linalg.eigh(np.cov(x.T, bias=True))
    e, vectors_ = e[::-1], vectors_[:, ::-1]
    got, explained = whitened(spark, rows, 4)
    assert len(got) == 4 * len(part) and {r.n for r in got} == {len(part)} and all(r.identity_error < 1e-9 for r in got)
    assert np.allclose([x for _, x in explained], e[:4] / e.sum(), rtol=1e-10)
    z = ((x - x.mean(axis=0)) @ vectors_ / np.sqrt(np.abs(e)))[:, :4]
    key = lambda i, n, d: (i is None, i or 0, d, n)
    n, s = len(part), [sum(v[j] + 100_000 for _, v in part) for j in range(6)]
    deviation = [sum((n * (c + 100_000) - t) ** 2 for c, t in zip(v, s)) for _, v in part]
    for c in range(4):
        own = sorted((key(r.vec_id, round(abs(r.whitened), 6), int(r.deviation)), r.whitened) for r in got if r.component == c + 1)
        want = sorted((key(i, round(abs(a), 6), d), a) for (i, _), a, d in zip(part, z[:, c], deviation))
        a, b = np.array([x[1] for x in own]), np.array([x[1] for x in want])
        assert [x[0][:3] for x in own] == [x[0][:3] for x in want] and min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = np.floor(np.array([r.embedding for r in df.collect()], float) * 1024)
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    got = whitening.whiten(df).groupBy("component").agg({"explained": "max", "whitened": "stddev_pop", "*": "count"}).orderBy("component").collect()
    assert [r["count(1)"] for r in got] == [len(x)] * 8
    assert np.allclose([r["max(explained)"] for r in got], e[:8] / e.sum(), rtol=1e-9) and np.allclose([r["stddev_pop(whitened)"] for r in got], 1)


def test_whitening_equal_eigenvalues_and_few_dimensions(spark):
    """Axes of equal weight (one start vector meets them as one), vectors in a plane, one vector, none."""
    cross = [(n, [(0.5 if n % 2 else -0.5) * (j == n // 2) for j in range(6)]) for n in range(12)]
    got, explained = whitened(spark, cross)
    assert [c for c, _ in explained] == [1, 2, 3, 4, 5, 6] and np.allclose([x for _, x in explained], 1 / 6) and got[0].identity_error < 1e-9
    r = np.random.default_rng(5)
    plane = [(n, [a, b, 0.25, 0.0, 0.0, 0.0]) for n, (a, b) in enumerate(r.normal(size=(50, 2)).tolist())]
    got, explained = whitened(spark, plane)
    assert [c for c, _ in explained] == [1, 2] and abs(sum(x for _, x in explained) - 1) < 1e-9 and got[0].identity_error < 1e-9
    assert whitened(spark, [(1, [0.5, 0.25])])[0] == [] and whitened(spark, [(1, [0.5]), (1, [0.5])])[0] == [] and whitened(spark, [])[0] == []
    far = [(n, [float(n % 2) * 4e9, float(n % 3)]) for n in range(40)] + [(99, [1e300, 0.0])]  # the last one's entry is no whole number of a long
    got, _ = whitened(spark, far)
    assert {r.vec_id for r in got} == set(range(40)) and max(int(r.deviation) for r in got) > 2**63


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_rank(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for item, ts in asked.items():
        found = []
        for i, c in counts:
            m = 10 + (90 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(map(str, out))


def ranked(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_search_matches_brute_force(spark, odd, empty):
    docs = load_documents(spark, SF)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert ranked(lexical.rank(docs, items)) == brute_rank(texts, [(r.item_id, r.text) for r in items.collect()])
    asked = [(1, "the QUICK brown-fox", "a"), (1, "w5 w6 w7", "b"), (2, None, "c"), (None, "token secret É é 😀 ONE", "d"), (3, "!! ..", "e"), (4, "nowhere", "f"), (5, "x one two", "g")]
    asked = spark.createDataFrame(asked, "item_id long, text string, doc_id string")
    want = brute_rank([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in asked.collect()], 4)
    assert ranked(lexical.rank(odd, asked, 4)) == want and any("None" in w for w in want)
    assert lexical.rank(empty, asked).count() == 0 and lexical.rank(odd, asked.limit(0)).count() == 0


def test_item_blocks(spark, monkeypatch, odd):
    monkeypatch.setattr(lexical, "ITEM_TERMS", 3)
    asked = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "one"), (3, "two x"), (4, "dog")], "item_id long, text string")
    assert ranked(lexical.rank(odd, asked)) == brute_rank([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in asked.collect()])


def test_occurrences_by_pieces(monkeypatch):
    r = random.Random(2)
    for size in (1, 2, 5, 17):
        monkeypatch.setattr(lexical, "PIECE", size)
        for _ in range(300):
            text = "".join(r.choice(["a", "B", " ", "\n", "é", "日", "-", "9", "\x00", "zz"]) for _ in range(r.randint(0, 40)))
            assert lexical.occurrences(text.encode()) == Counter(t.encode() for t in terms(text))


def test_best_positions_stop_early_and_lose_nothing():
    """Random shards in a row against sums over all postings; ties by id; a shard whose bound is low is left after the first reach."""
    r, weights, best = np.random.default_rng(4), np.array([900, 5, 300, 40, 7, 0]), lexical.Best(5)
    sums, asked = [], np.array([0, 1, 2, 4, 5])
    for part in range(6):
        ids = r.permutation(np.arange(part * 400, part * 400 + 400))
        held = r.random((400, 6)) < np.array([0.1, 0.9, 0.02, 0.5, 0.9, 0.9])
        tf, n = r.integers(1, 4, (400, 6)), r.integers(1, 60, 400)
        docs, ts = np.nonzero(held)
        shard = lexical.Shard(ids, n, ts, held.sum(axis=1), tf[docs, ts], weights, 2400, 72_000)
        shard.search(asked, best)
        one = lexical.impacts(weights[ts], tf[docs, ts], n[docs], 2400, 72_000) * np.isin(ts, asked)
        sums += zip((-np.bincount(docs, one, 400)).astype(int).tolist(), ids.tolist())
    assert list(zip((-best.found).tolist(), best.ids.tolist())) == sorted(sums)[:5]
    looked = []
    best.offer = lambda ids, scores: looked.append(len(ids))
    best.least = int(best.found[-1]) * 10
    shard.search(asked, best)
    assert sum(looked) <= lexical.FIRST * len(asked)


def test_impacts_beyond_a_long():
    got = lexical.impacts(np.array([3, 3]), np.array([2, 10**11]), np.array([50, 2 * 10**12]), 10**9, 10**12)
    assert got.tolist() == [3 * ((10**9 * f) // (1000 * f + 8 * (10 + (90 * n * 10**9) // 10**12))) for f, n in ((2, 50), (10**11, 2 * 10**12))]
