"""Findings of round 3: each test failed before its change."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from authscope.operators import knn, monitor, ngrams, rules, similarity


def test_avatar_pairs_are_not_broadcast(spark):
    """The keyed hashes are many times the hashes: their join must not take a side through the driver."""
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.xxhash64("id").alias("phash"))
    links = similarity.hamming_tried(df, 7, None, ())
    links.collect()
    assert "Broadcast" not in links._jdf.queryExecution().toString()


def test_merged_confidence_rounds_like_sql(spark):
    grid = "SELECT s1 / 10.0 AS s1, s2 / 10.0 AS s2, c1, c2 FROM range(500, 600) a(s1), range(500, 600, 3) b(s2), (VALUES (0.3333), (0.6667), (1.0)) c(c1), (VALUES (0.3333), (0.6667), (1.0)) d(c2)"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE g AS SELECT CAST(s1 AS DOUBLE) AS s1, CAST(s2 AS DOUBLE) AS s2, CAST(c1 AS DOUBLE) AS c1, CAST(c2 AS DOUBLE) AS c2 FROM ({grid})")
    want = {r[:4]: r[4] for r in con.execute("SELECT s1, s2, c1, c2, round((s1 * c1 + s2 * c2) / greatest(c1 + c2, 1e-9), 1) FROM g WHERE s1 - s2 <= 15 AND c2 >= 0.7e0 * c1 AND s2 < s1").fetchall()}
    df = spark.createDataFrame(con.execute("SELECT * FROM g").fetchall(), "s1 double, s2 double, c1 double, c2 double")
    got = {(r.s1, r.s2, r.c1, r.c2): r.confidence for r in rules.merged(df).where("source = 'weighted_merge'").collect()}
    assert got == want and len(want) > 1000


def test_languages_are_told_without_a_table_of_grams(spark, monkeypatch):
    """The same ranks as by counting rows of grams; only the texts of a group are shuffled."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") % 70).alias("k"), "doc_id", "lang", F.concat("text", F.lit(" \U0001d4d0x Ünï a a ß")).alias("text"))
    want = {}
    for r in ngrams.ranked(ngrams.gram_counts(docs, ["k"]), ["k"]).select("k", "rank", ngrams.code("gram").alias("c")).orderBy("k", "rank").collect():
        want.setdefault(r.k, []).append(r.c)
    known = ngrams.profiles(docs)

    def no_table(df):
        raise AssertionError("a table is written")

    monkeypatch.setattr(ngrams, "settled", no_table)
    told = ngrams.told(docs, known, ["k"])
    assert {r.k: r.grams for r in ngrams.ranked_codes(docs, ["k"]).collect()} == want and told.count() == 70


def test_neighbours_ask_few_leaves(spark, monkeypatch):
    """12,000 spread points, 6,000 equal ones among them: exact, and a point asks few leaves besides its own."""
    u = lambda i: F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)) / float(1 << 20))
    df = spark.range(18_000).select("id", F.array(*map(u, range(5))).alias("x")).repartition(4, "id")
    asked, kept = [], knn.in_leaves
    monkeypatch.setattr(knn, "in_leaves", lambda rows, *a: (asked.append(rows.count()), kept(rows, *a))[1])
    got = {}
    for r in knn.nearest(df, df, 5).collect():
        got.setdefault(r.a, set()).add(r.b)
    assert asked[0] == 12_001 and asked[1] < 8 * asked[0]  # of about 17 leaves
    x = np.array([r.x for r in df.orderBy("id").collect()])
    for a in [0, 3, 17_997, *range(1, 18_000, 450)]:
        d = np.sqrt(((x - x[a]) ** 2).sum(axis=1))
        order = [int(b) for b in np.lexsort((np.arange(len(x)), np.round(d, 12))) if b != a][:5]
        assert got[a] == set(order)
    assert len(got) == 18_000


def test_drift_rows_are_not_dealt_by_feature(spark):
    """The ends of each feature go to the values; the values aren't shuffled before they are counted."""
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "train").otherwise("recent").alias("side"), F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = monitor.psi(df, "side", ["a", "b"])
        assert out.count() == 2 and "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sparse_keys_share_groups(spark, monkeypatch):
    """3,000 keys of a part of time are few groups, and so few calls to the state; answers stay those of each key."""
    from authscope.streaming import sessions

    sizes, table = [], type(spark.range(1))
    kept = table.groupBy
    monkeypatch.setattr(table, "groupBy", lambda df, *by: (sizes.append(kept(df, *by).count().count()), kept(df, *by))[1])
    rows = spark.range(3000).select(F.col("id").alias("event_id"), F.col("id").alias("guild_id"), F.timestamp_seconds(F.lit(600 * 1000)).alias("ts"))
    sessions.trailing_counts(rows, ["guild_id"], 120)
    assert sizes and sizes[0] <= 200


def test_sessions_of_sparse_keys_share_groups(spark, monkeypatch):
    from authscope.streaming import sessions

    sizes, table = [], type(spark.range(1))
    kept = table.groupBy
    monkeypatch.setattr(table, "groupBy", lambda df, *by: (sizes.append(kept(df, *by).count().count()), kept(df, *by))[1])
    rows = spark.range(5000).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.timestamp_seconds("id").alias("ts"))
    sessions.message_bursts(rows, ["user_id"], 60, 3, 600, F.col("event_id") % 2 == 0)
    assert sizes and sizes[0] <= 1024


def test_posts_of_small_accounts_meet_by_account(spark):
    """No rows of words are made for accounts of few posts; ratios are those of the way by prefixes."""
    from authscope.operators import nearposts

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120")
    near = docs.select((F.col("doc_id") % 30).alias("account_id"), "doc_id", "text").unionByName(docs.select((F.col("doc_id") % 30).alias("account_id"), (F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" x y é")).alias("text")))
    posts = near.withColumnRenamed("doc_id", "post_id").unionByName(spark.createDataFrame([(31, 1, None), (31, 2, ""), (32, 3, "one two"), (32, 4, "Two one")], "account_id long, post_id long, text string"), allowMissingColumns=True)
    for limit, weighted in ((0.7, False), (0.85, True)):
        got = nearposts.similar_posts(posts, limit, weighted)
        assert "Generate" not in got._jdf.queryExecution().toString()
        kept, nearposts.FEW = nearposts.FEW, 0
        try:
            want = {tuple(r) for r in nearposts.similar_posts(posts, limit, weighted).collect()}
        finally:
            nearposts.FEW = kept
        assert {tuple(r) for r in got.collect()} == want and sum(r[1] for r in want) > 100 and (32, 1, 1.0) in want


def test_triangles_without_rows_of_wedges(spark):
    """Lists of neighbours meet along the edges; hubs, doubled and turned edges, loops and a clique among them."""
    from itertools import combinations

    from authscope.operators import graph

    pairs = {(i, (i * 7 + k * k) % 90) for i in range(90) for k in range(6)} | {(0, i) for i in range(90)} | {(i, 1) for i in range(90)} | set(combinations(range(40, 48), 2)) | {(500, 501)}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {n: (len(m), sum(y in near[x] for x, y in combinations(m, 2))) for n, m in near.items()}
    got = graph.clustering(spark.createDataFrame([*pairs, *[(b, a) for a, b in list(pairs)[:50]]], "src long, dst long"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and {r.account_id: (r.degree, r.triangles) for r in got.collect()} == want


def test_template_likeness_in_numbers(spark):
    """Trigrams are numbers of a row, not cut from an array of its characters; short, empty, NULL and far code points among the texts."""
    texts = ["  Earn MONEY daily ", "ab", "", None, "𝒜𝒷𝒸𝒹 𝒜𝒷𝒸𝒹", "earn money dail", "ÄÖÜ äöü", "aaaaaaa"]
    known = ["earn money daily", "𝒜𝒷𝒸", "ab", "äöü"]
    cut = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    want = {i: max(round(len(a & b) / len(a | b), 4) if a | b else 0.0 for b in map(cut, known)) for i, a in enumerate(cut((t or "").strip(" ").lower()) for t in texts)}
    got = similarity.template_similarity(spark.createDataFrame(list(enumerate(texts)), "account_id long, bio string"), known)
    assert "array_distinct" not in got._jdf.queryExecution().toString() and {r.account_id: r.similarity for r in got.collect()} == want


def test_topics_and_bios_meet_in_one_shuffle(spark):
    from authscope.operators import identity, language

    left, right = (spark.createDataFrame(rows, "account_id long, text string") for rows in ([(1, "red fox"), (2, None), (3, "one")], [(1, "red red dog"), (1, "fox"), (2, "cat")]))
    got = language.topic_similarity(left, right)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.account_id: r.similarity for r in got.collect()} == {1: 0.8032, 2: 0.0, 3: 0.0}  # 3 / sqrt(2 * (5 + (ln(3 / 2) + 1)^2))
    many = right.unionByName(spark.createDataFrame([(1, "fox dog"), (2, "")] * 20, right.schema))
    got = language.topic_similarity(left, many)
    assert "Generate" in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.account_id: r.similarity for r in got.collect()} == {1: round(23 / (2 * (445 + 21**2 * (np.log(1.5) + 1) ** 2)) ** 0.5, 4), 2: 0.0, 3: 0.0}
    rows = [(1, "a", "red fox"), (1, "b", "fox fox"), (1, "c", "!"), (1, "d", None), (2, "a", "one"), (3, "a", "x y"), (3, "b", "y x")]
    got = identity.pair_likeness(spark.createDataFrame(rows, "identity long, platform string, bio string"))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.identity: round(r.bio_similarity, 6) for r in got.collect()} == {1: round(0.5**0.5 / 3, 6), 2: 1.0, 3: 1.0}


def test_fits_read_their_rows_few_times(spark):
    """A platform's passes read what was written once; importances fit the forest alone."""
    from pyspark.ml.classification import RandomForestClassificationModel

    import __spark_entry__
    from authscope.operators import training

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        seen.add(1)
        return float((i * 37) % 101)

    rows = spark.range(600).select(F.col("id").alias("account_id"), F.when(F.col("id") % 2 == 0, "x").otherwise("github").alias("platform"), value.asNondeterministic()("id").alias("a"), (F.col("id") % 7 < 3).cast("int").alias("y"))
    assert training.history(rows, ["a"]).count() == 2 and 600 <= seen.value <= 1200
    fitted, kept = [], training.fit
    training.fit = lambda *a, **b: (fitted.append(kept(*a, **b)), fitted[-1])[1]
    try:
        assert __spark_entry__.queries()["mdl6_mdl17_importances"](spark, "/root/testdata/sf0.001").count() == 5
    finally:
        training.fit = kept
    names = [type(m).__name__ for m in fitted[0].stages]
    assert isinstance(fitted[0].stages[-1], RandomForestClassificationModel) and len(names) == 5
