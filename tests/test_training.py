"""Neighbours, balancing, margins, folds, retraining, search, versions and languages, against brute force or SQL over what they write."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from authscope.operators import knn, margins, ngrams, training
from authscope.plans import network
from authscope.sources import versions

DIR = "/root/testdata/sf0.01"


def brute(points, rows, k):
    ids = sorted(points)
    x = np.array([points[i] for i in ids])
    out = set()
    for a in rows:
        d = np.sqrt(((x - np.array(points[a])) ** 2).sum(axis=1))
        out |= {(a, b) for _, b in sorted((round(v, 12), i) for v, i in zip(d.tolist(), ids) if i != a)[:k]}
    return out


def test_neighbours_of_dense_and_sparse_parts(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, (400, 3)), r.normal(8, 0.05, (200, 3)), np.zeros((9, 3)), r.normal(-40, 20, (25, 3))])
    points = dict(enumerate(x.tolist()))
    df = spark.createDataFrame(list(points.items()), "id long, x array<double>").repartition(4)
    own = df.where("id % 3 = 0")
    assert {(g.a, g.b) for g in knn.nearest(own, df, 5).collect()} == brute(points, range(0, len(x), 3), 5)
    few = df.where("id < 4")
    assert {(g.a, g.b) for g in knn.nearest(few, few, 5).collect()} == {(a, b) for a in range(4) for b in range(4) if a != b}
    assert knn.nearest(df.where("false"), df, 5).count() == 0


@pytest.fixture(scope="module")
def placed(spark):
    return training.placed_rows(network.examples(spark, DIR), network.FEATURES, "account_id").persist()


def test_neighbours_and_quotas_of_the_table(spark, placed):
    """Neighbours of the rarer class equal brute force; the quotas of ADASYN follow by SQL from the neighbours."""
    rows = {r.id: (r.x, r.y) for r in placed.collect()}
    sizes = [sum(y == c for _, y in rows.values()) for c in (0, 1)]
    rare = min((0, 1), key=lambda c: (sizes[c], c))
    own = placed.where(F.col("y") == rare)
    around = knn.nearest(own, placed, 5)
    got = [(g.a, g.b) for g in around.collect()]
    assert len(got) == 5 * min(sizes) and set(got) == brute({i: x for i, (x, _) in rows.items()}, [i for i, (_, y) in rows.items() if y == rare], 5)
    need = max(sizes) - min(sizes)
    quota = {q.a: q.n for q in training.quotas(placed, own, knn.nearest(own, own, 5), need, rare, True, 5).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE near(a BIGINT, b BIGINT); CREATE TABLE kind(b BIGINT, y INT)")
    con.executemany("INSERT INTO near VALUES (?, ?)", got)
    con.executemany("INSERT INTO kind VALUES (?, ?)", [(i, y) for i, (_, y) in rows.items()])
    sql = f"""WITH w AS (SELECT a, avg(CAST(y <> {rare} AS INT)) AS w FROM near JOIN kind USING (b) GROUP BY a), s AS (SELECT a, w * {need} / sum(w) OVER () AS s FROM w),
    r AS (SELECT a, floor(s) AS f, row_number() OVER (ORDER BY round(s - floor(s), 12) DESC, a) AS r FROM s) SELECT a, CAST(f + CAST(r <= {need} - (SELECT sum(f) FROM r) AS INT) AS BIGINT) FROM r"""
    want = dict(con.execute(sql).fetchall())
    assert quota == want and sum(quota.values()) == need


@pytest.fixture(scope="module")
def rings(spark):
    r = np.random.default_rng(4)
    a, radius = r.uniform(0, 6.28, 500), np.where(np.arange(500) % 2 == 0, 1, 3) + r.normal(0, 0.3, 500)
    rows = [(i, float(d * np.cos(t)), float(d * np.sin(t)), i % 2) for i, (t, d) in enumerate(zip(a, radius))]
    return spark.createDataFrame(rows, "account_id long, a double, b double, y int").withColumn("_x", array_to_vector(F.array("a", "b"))).coalesce(1).persist()


def test_kernel_margin_beats_a_line_on_rings(rings):
    train, held = rings.where("account_id % 5 <> 0"), rings.where("account_id % 5 = 0")
    right = lambda df, p: df.select(F.avg(((vector_to_array(p)[1] >= 0.5).cast("int") == F.col("y")).cast("int"))).first()[0]
    kernel = right(margins.KernelMargin(weight=None, out="q").fit(train).transform(held), "q")
    line = right(LogisticRegression(featuresCol="_x", labelCol="y", probabilityCol="q").fit(train).transform(held), "q")
    assert kernel >= 0.95 and line <= 0.7


def test_log_step(spark):
    df = spark.createDataFrame([(1.0, 5.0), (100.0, 6.0), (-3.0, 7.0), (None, 8.0), (10_000.0, 9.0)], "followers double, is_verified double")
    from pyspark.ml import Pipeline

    model = Pipeline(stages=training.prepared(["followers", "is_verified"])).fit(df)
    got = [r["_raw"].toArray().tolist() for r in model.transform(df).collect()]
    want = duckdb.sql("SELECT ln(1 + greatest(coalesce(f, 1.0), 0)), v FROM (VALUES (1.0, 5.0), (100.0, 6.0), (-3.0, 7.0), (NULL, 8.0), (10000.0, 9.0)) t(f, v)").fetchall()
    assert np.allclose(sorted(got, key=lambda r: r[1]), [[float(x) for x in w] for w in want])


METRICS = """SELECT count(*), CAST(sum(n) AS BIGINT), round(avg(ok / n), 4), round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 4), round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 4), round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 4)
FROM (SELECT fold, count(*) AS n, count(*) FILTER (pred = y) AS ok, count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp, count(*) FILTER (pred = 0 AND y = 1) AS fn FROM p GROUP BY fold)"""


def by_sql(predictions):
    con = duckdb.connect()
    con.execute("CREATE TABLE p(fold INT, y INT, pred INT)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", [(r.fold, r.y, r.pred) for r in predictions])
    return con.execute(METRICS).fetchone()


def test_folds_and_their_metrics(spark):
    """Every row is scored once, by a model of the other folds; means over folds by SQL over what was written."""
    rows = network.examples(spark, DIR).where("account_id % 4 = 0")
    out = training.out_of_fold(rows, network.FEATURES, most=3, votes=(2,)).persist()
    got = out.collect()
    assert sorted(r.account_id for r in got) == sorted(r.account_id for r in rows.collect()) and {r.fold for r in got} == {0, 1, 2}
    assert tuple(training.cross_validated(out).first()) == by_sql(got)
    with pytest.raises(ValueError):
        training.out_of_fold(rows.where("y = 1"), network.FEATURES)


def test_retraining_takes_both_sides(spark):
    first = spark.range(60).select(F.col("id").alias("account_id"), (F.col("id") * 10).alias("followers"), (F.col("id") % 2).cast("int").alias("label"))
    known = spark.range(40).select(F.col("id").alias("account_id"), (F.col("id") * 7).cast("double").alias("followers"), F.col("id").cast("double").alias("posts"), F.when(F.col("id") != 3, F.col("id") % 2).cast("int").alias("label"))
    _, out = training.retrained(first, known, ["followers", "posts"])
    got = out.collect()
    assert len(got) == 99 and sum(":1:" in r["_id"] for r in got) == 39
    assert tuple(training.cross_validated(out).first()) == by_sql(got)


def test_halving_finds_the_full_searchs_winner(spark):
    choices = [(5, 2, 1), (10, 5, 1), (20, 6, 5), (8, 3, 20)]
    rows = network.examples(spark, DIR)
    log = training.searched(rows, network.FEATURES, 2, choices, keep=2).collect()
    assert [(r["round"], len([x for x in log if x["round"] == r["round"]])) for r in log] == [(1, 4)] * 4 + [(2, 2)] * 2 + [(3, 1)]
    n = [max(r["rows"] for r in log if r["round"] == i) for i in (1, 2, 3)]
    assert n[0] < n[1] < n[2] == rows.count()
    for i in (1, 2):
        tried = sorted((-r["f1"], r["trees"], r["depth"], r["leaf"]) for r in log if r["round"] == i)
        assert sorted(t[1:] for t in tried[: -(-len(tried) // 2)]) == sorted((r["trees"], r["depth"], r["leaf"]) for r in log if r["round"] == i and r["stays"])
    winner = next(r for r in log if r["round"] == 3)
    full = training.searched(rows, network.FEATURES, 2, choices, keep=5)  # two rounds: the second, with all rows, for the best of the first
    best = max(r["f1"] for r in full.where("round = 2").collect())
    assert winner["stays"] and winner["f1"] >= best - 0.01
    assert len(set(training.sampled_forests(20))) == 20


def test_calibrator_choice(spark):
    from authscope.plans.registry import QUERIES

    rows = [tuple(r) for r in QUERIES["mdl13_mdl14_calibrators"](spark, DIR).select("method", "brier", "chosen").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE c(method VARCHAR, brier DOUBLE)")
    con.executemany("INSERT INTO c VALUES (?, ?)", [r[:2] for r in rows])
    pick = con.execute("SELECT CASE WHEN min(brier) < 0.98 * min(brier) FILTER (method = 'raw') THEN arg_min(method, brier) ELSE 'raw' END FROM c").fetchone()[0]
    assert [m for m, _, chosen in rows if chosen] == [pick]


def test_versions_swap_at_once(spark, tmp_path, monkeypatch):
    """Two rounds of sightings by SQL; a write that fails half-way leaves the version before, and the next one takes its number."""
    v = versions.Versions(spark, str(tmp_path / "avatars"), versions.REGISTRY)
    assert v.current() == 0 and v.read().count() == 0
    rounds = [[(1, "x", "a", 100), (1, "x", "a", 50), (2, "x", "b", 70)], [(1, "x", "a", 20), (2, "x", None, 30), (2, "x", None, 31)]]
    seen = lambda rows: spark.createDataFrame(rows, "phash long, platform string, profile string, t long").withColumn("seen_at", F.timestamp_seconds("t"))
    for rows in rounds:
        versions.register_avatars(v, seen(rows))
    got = sorted((r.phash, r.profile or "", r.seen_count, int(r.first_seen.timestamp()), int(r.last_seen.timestamp())) for r in v.read().collect())
    assert v.current() == 2 and got == [(1, "a", 3, 20, 100), (2, "", 2, 30, 31), (2, "b", 1, 70, 70)]
    bad = seen(rounds[0]).withColumn("platform", F.when(F.col("phash") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("platform")))
    with pytest.raises(Exception):
        versions.register_avatars(v, bad)
    assert v.current() == 2 and v.read().count() == 3
    assert versions.register_avatars(v, seen(rounds[0])) == 3 and v.read().where("phash = 1").first().seen_count == 5
    v.drop_before(3)
    assert v.current() == 3 and v.read().count() == 3 and not (tmp_path / "avatars" / "2").exists()


def test_language_of_held_out_posts(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("lang is not null")
    known = ngrams.profiles(docs.where(~ngrams.held_out(F.col("doc_id"))))
    rest = docs.where(ngrams.held_out(F.col("doc_id")))
    tags = ngrams.told(rest, known, ["doc_id"]).join(rest.select("doc_id", "lang"), "doc_id")
    one = tags.where("tag is not null").agg(F.avg((F.col("tag") == F.col("lang")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert one.n > 100 and one.right >= 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "1 2 ."), (4, "the of")], "doc_id long, text string")
    assert {r.doc_id: r.tag for r in ngrams.told(odd, known, ["doc_id"]).collect()} == {4: None}
