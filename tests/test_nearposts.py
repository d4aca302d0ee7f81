"""Near copies of an account's posts against sequential brute force, and how many pairs are tried on a large account."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from authscope.operators import nearposts, similarity, writing

POSTS = "account_id long, post_id long, text string"


def texts(seed, n, words=60):
    """Texts of common and rare words, near copies and exact ones among them; blank and NULL ones."""
    r, out = random.Random(seed), []
    for i in range(n):
        if out and r.random() < 0.45:
            old = list(r.choice(out) or "")
            for _ in range(r.randrange(4)):
                if old:
                    old[r.randrange(len(old))] = r.choice("abc é")
            out.append("".join(old))
        else:
            out.append(" ".join(r.choice(["the", "of", "and", f"w{r.randrange(40)}", f"Señor{r.randrange(300)}"]) for _ in range(r.randrange(words))))
    return out[:-3] + [None, "", " \n "]


@pytest.fixture(scope="module")
def rows():
    out = [(1, t) for t in texts(1, 70)] + [(2, t) for t in texts(2, 60, 12)] + [(3, "alone here")] + [(4, None), (4, "")] + [(5, "same words again")] * 30
    return [(a, 1000 - i if a == 2 else i, t) for i, (a, t) in enumerate(out)]


@pytest.fixture(scope="module")
def posts(spark, rows):
    return spark.createDataFrame(rows, POSTS).repartition(3)


def by_account(rows):
    out = {}
    for a, p, t in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(a, []).append(t)
    return out


def ratio(k, n):
    return (k, round(k / (n * (n - 1) / 2), 4) if n > 1 else 0.0)


def test_jaccard_matches_brute_force(posts, rows):
    want = {}
    for a, ts in by_account(rows).items():
        sets = [set((t or "").lower().split()) for t in ts]
        k = sum(bool(x | y) and round(len(x & y) / len(x | y), 9) > 0.7 for i, x in enumerate(sets) for y in sets[i + 1 :])
        want[a] = ratio(k, len(ts))
    assert {r.account_id: (r.n_similar, r.ratio) for r in nearposts.similar_posts(posts, 0.7, False).collect()} == want and want[5][0] == 435 and want[1][0] > 20


def test_cosine_matches_brute_force(posts, rows):
    want = {}
    for a, ts in by_account(rows).items():
        counts = [Counter(re.findall(r"\w{2,}", (t or "").lower())) for t in ts]
        df = Counter(t for c in counts for t in c)
        vectors = [{t: f * (math.log((1 + len(ts)) / (1 + df[t])) + 1) for t, f in c.items()} for c in counts]
        norm = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
        dot = lambda x, y: sum(w * y.get(t, 0) for t, w in x.items())
        k = sum(p * q > 0 and round(dot(x, y) / (p * q), 9) > 0.85 for i, (x, p) in enumerate(zip(vectors, norm)) for y, q in list(zip(vectors, norm))[i + 1 :])
        want[a] = ratio(k, len(ts))
    assert {r.account_id: (r.n_similar, r.ratio) for r in nearposts.similar_posts(posts, 0.85, True).collect()} == want and want[5][0] == 435 and want[1][0] > 20


def fingerprint(text):
    s = re.sub(r"\W+", "", (text or "").lower())
    votes = [0] * 64
    for i in range(max(len(s) - 3, 1)):
        h = int.from_bytes(hashlib.md5(s[i : i + 4].encode()).digest()[8:], "big")
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b, v in enumerate(votes) if v > 0)


def greedy(prints, radius):
    used, n = set(), 0
    for i, x in enumerate(prints):
        if i not in used:
            n += 1
            used |= {j for j in range(i, len(prints)) if (x ^ prints[j]).bit_count() <= radius}
    return n


@pytest.mark.parametrize("radius", [3, 12])
def test_clusters_match_sequential_leaders(posts, rows, radius):
    """At the wider radius chains of links are long: members of a leader that themselves are near others."""
    want = {a: greedy([fingerprint(t) for t in ts], radius) for a, ts in by_account(rows).items()}
    if radius == 3:
        got = {r.post_id: r.fp % 2**64 for r in nearposts.simhashes(posts).collect()}
        assert got == {p: fingerprint(t) for _, p, t in rows}
        assert {r.account_id: r.clusters for r in nearposts.cluster_counts(posts).collect()} == want and want[5] == 1 and want[1] < 67
    else:
        prints = [(a, i, fingerprint(t)) for a, ts in by_account(rows).items() for i, t in enumerate(ts)]
        one = [(i, x) for a, i, x in prints if a == 1]
        links = [(i, j) for i, x in one for j, y in one if i < j and (x ^ y).bit_count() <= radius]
        spark = posts.sparkSession
        assert nearposts.first_leaders(spark.createDataFrame([(i,) for i, _ in one], "id long"), spark.createDataFrame(links, "a long, b long")).count() == want[1]


def test_leaders_of_chains(spark):
    nodes = spark.range(40).select("id")
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert sorted(r.id for r in nearposts.first_leaders(nodes, chain).collect()) == [*range(0, 31, 2), *range(31, 40)]
    assert nearposts.first_leaders(nodes, chain.where("false")).count() == 40


def test_pairs_tried_grow_with_the_posts(spark):
    """One account whose posts share common words and each have rare ones: pairs through common words would grow with the square."""
    tried = {}
    for n in (2_500, 10_000):
        text = F.concat_ws(" ", F.lit("the of and to in is that it"), *[F.concat(F.lit(f"r{k}x"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("string")) for k in range(10)])
        posts = spark.range(n).select(F.lit(1).cast("long").alias("account_id"), F.col("id").alias("post_id"), text.alias("text"))
        for weighted, limit in ((False, 0.7), (True, 0.85)):
            shape = nearposts.TERMS if weighted else nearposts.WORDS
            rows = nearposts.classes(nearposts.counted(posts, shape, "account_id"), F.col("post_id").cast("string"), "account_id")
            found = nearposts.cosine_pairs(rows, posts.groupBy("account_id").agg(F.count(F.lit(1)).alias("n")), limit, "account_id") if weighted else nearposts.set_pairs(rows, limit, "account_id")
            tried[weighted, n] = found[0].count()
    for weighted in (False, True):
        assert tried[weighted, 10_000] <= 6 * max(tried[weighted, 2_500], 2_500) and tried[weighted, 10_000] < 10_000**2 / 100


def test_keys_widen_with_the_hashes(spark):
    """Links equal brute force at any number of blocks, and the pairs tried do not grow with the square."""
    assert [similarity.block_count(n, 7) for n in (100, 16_000, 1_000_000, 10**9)] == [9, 9, 11, 14]
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(60)]
    for _ in range(120):
        x = r.choice(base)
        for b in r.sample(range(64), r.randrange(9)):
            x ^= 1 << b
        base.append(x)
    hashes = sorted(set(base))
    df = spark.createDataFrame([(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)], "vec_id long, phash long")
    want = {(i, j, (x ^ y).bit_count()) for i, x in enumerate(hashes) for j, y in enumerate(hashes) if i < j and (x ^ y).bit_count() <= 7}
    for blocks in (None, 10, 11):
        assert {tuple(r) for r in similarity.hamming_links(df, 7, blocks).collect()} == want
    tried = [similarity.hamming_tried(spark.range(n).select(F.col("id").alias("vec_id"), F.xxhash64("id").alias("phash")), 7, None, ()).count() for n in (16_000, 64_000)]
    assert tried[1] <= 6 * tried[0] and tried[1] < 10 * 64_000


def test_mood_of_words():
    assert {"wrong", "broken", "false", "spam", "scam", "fake", "fraud"} <= set(writing.NEGATIVE) and len(set(writing.NEGATIVE)) == 21


def test_mood_of_a_post(spark):
    df = spark.createDataFrame([("what a scam",), ("good scam",), ("nothing",)], "text string")
    assert [r[0] for r in df.select(writing.sentiment(writing.tokens(F.col("text")))).collect()] == [-1.0, 0.0, 0.0]


def test_open_interval_of_the_ratio(spark):
    from authscope.operators import explain

    df = spark.createDataFrame([(1, 0.05), (2, 0.05000005), (3, 19.99999995), (4, 20.0)], "account_id long, ff_ratio double").withColumns({"prediction": F.lit("Legit"), "confidence": F.lit(60.0)})
    assert {r.account_id: r.agreeing for r in explain.explained(df).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}
    assert {r.account_id: r.shown > 60 for r in explain.shown_confidence(df).collect()} == {1: False, 2: True, 3: True, 4: False}
