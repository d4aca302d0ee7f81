"""Registered queries of communities, avatars, identities, comparisons, drift of tables and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from authscope.operators import calibration, graph, identity, monitor, rules, similarity, training
from authscope.plans.registry import _SCORED, query, scored
from authscope.sources import tables
from authscope.sources.tables import shared_folder
from authscope.sources.views import ctes, load
from authscope.streaming import guild

_E = ctes("v_edges") + ", u AS (SELECT src, dst FROM v_edges UNION SELECT dst, src FROM v_edges), l0 AS (SELECT DISTINCT src AS n, src AS c FROM u)"
_ROUND = lambda i: f"h{i} AS (SELECT src AS n, c, count(*) AS k FROM u JOIN l{i} ON l{i}.n = dst GROUP BY ALL), l{i + 1} AS MATERIALIZED (SELECT n, c FROM (SELECT n, c, row_number() OVER (PARTITION BY n ORDER BY k DESC, c) AS r FROM h{i}) WHERE r = 1)"


_MOST = 6
_MOVED = ", ".join(f"(SELECT count(*) FROM l{i} JOIN l{i + 1} USING (n) WHERE l{i}.c <> l{i + 1}.c) AS d{i + 1}" for i in range(_MOST))
_RAN = "CASE " + " ".join(f"WHEN d{i} = 0 THEN {i}" for i in range(1, _MOST)) + f" ELSE {_MOST} END"
_STILL = "CASE " + " ".join(f"WHEN d{i} = 0 THEN 0" for i in range(1, _MOST)) + f" ELSE d{_MOST} END"


@query(f"WITH {_E}, {', '.join(_ROUND(i) for i in range(_MOST))}, m AS MATERIALIZED (SELECT {_MOVED}) SELECT u.src AS account_id, round(avg(CAST(x.c = y.c AS INT)), 4) AS share, CAST(any_value({_RAN}) AS INT) AS rounds, any_value({_STILL}) AS changed FROM u JOIN l{_MOST} x ON x.n = u.src JOIN l{_MOST} y ON y.n = u.dst, m GROUP BY u.src")
def jon10_same_community(spark, sf_dir):
    """Share of neighbours in the own community, by label propagation until labels settle, in six rounds at most; and how it ended."""
    lists, parts = graph.neighbour_lists(load(spark, sf_dir, "v_edges"))
    labels, rounds, changed = graph.communities(lists, parts, _MOST)
    return graph.same_community(lists, parts, labels).withColumns({"rounds": F.lit(rounds), "changed": F.lit(changed).cast("long")})


_HASH = "h AS (SELECT vec_id, list_sum([CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END for i in range(1, 65)]) AS p FROM embeddings), v AS (SELECT vec_id, p FROM h UNION ALL SELECT vec_id + 1000000000, xor(p, CAST(1 AS HUGEINT) << CAST(vec_id % 61 AS INT)) FROM h UNION ALL SELECT vec_id + 2000000000, xor(p, CAST(7 AS HUGEINT) << CAST(vec_id % 53 AS INT)) FROM h WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 3000000000, p FROM h WHERE vec_id % 4 = 0)"


def avatars(spark, sf_dir):
    """Sign hashes of the embeddings, copies of them, and variants of one and of three flipped bits."""
    h = similarity.sign_hashes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    flip = lambda m, n: F.col("phash").bitwiseXOR(F.call_function("shiftleft", F.lit(m).cast("long"), (F.col("vec_id") % n).cast("int")))
    one = h.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), flip(1, 61).alias("phash"))
    three = h.where("vec_id % 3 = 0").select((F.col("vec_id") + 2_000_000_000).alias("vec_id"), flip(7, 53).alias("phash"))
    return h.unionByName(one).unionByName(three).unionByName(h.where("vec_id % 4 = 0").select((F.col("vec_id") + 3_000_000_000).alias("vec_id"), "phash"))


@query(f"WITH {_HASH}, r AS (SELECT p, min(vec_id) AS id FROM v GROUP BY p) SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.p, b.p)) AS INT) AS distance FROM r a JOIN r b ON a.id < b.id WHERE bit_count(xor(a.p, b.p)) <= 7")
def jon15_hamming(spark, sf_dir):
    return similarity.hamming_links(avatars(spark, sf_dir), 7)


@query(f"WITH {_HASH}, s AS (SELECT a.vec_id, count(*) AS seen FROM v a JOIN v b ON bit_count(xor(a.p, b.p)) <= 7 GROUP BY a.vec_id) SELECT vec_id, seen, round(least((seen - 1) / 5, 1), 4) AS stock_score, CAST(seen > 3 AS INT) AS is_stock FROM s")
def jon15_stock_photos(spark, sf_dir):
    return similarity.stock_photos(avatars(spark, sf_dir), 7)


@query(f"WITH {_HASH} SELECT vec_id, CAST(bit_count(xor(p, CAST(281474976710655 AS HUGEINT))) < 26 OR bit_count(p) < 26 AS INT) AS is_default FROM v")
def jon16_default_avatars(spark, sf_dir):
    """A fixed list of two hashes; random signs lie about 32 bits away, so the limit is wider here."""
    return similarity.default_avatars(avatars(spark, sf_dir), [281474976710655, 0], 26)


_ID = f"{ctes('v_profiles')}, p AS (SELECT CAST(floor(account_id / 5) AS BIGINT) AS identity, * FROM v_profiles), o AS (SELECT * FROM p WHERE account_id % 5 <> 0), q AS (SELECT identity, username FROM p WHERE account_id % 5 = 0)"


@query(f"""WITH {_ID}, w AS (SELECT identity, platform, t, count(*) AS n FROM (SELECT identity, platform, unnest(regexp_extract_all(lower(bio), '[a-z0-9_]+')) AS t FROM o WHERE coalesce(bio, '') <> '') GROUP BY ALL), z AS (SELECT identity, platform, sqrt(sum(n * n)) AS s FROM w GROUP BY ALL), d AS (SELECT a.identity, a.platform AS p, b.platform AS q, sum(a.n * b.n) AS d FROM w a JOIN w b ON a.identity = b.identity AND a.t = b.t AND a.platform < b.platform GROUP BY ALL),
 t AS (SELECT d.identity, sum(d / (x.s * y.s)) AS total FROM d JOIN z x ON x.identity = d.identity AND x.platform = p JOIN z y ON y.identity = d.identity AND y.platform = q GROUP BY d.identity), b AS (SELECT identity, count(*) AS n FROM o WHERE coalesce(bio, '') <> '' GROUP BY identity), c AS (SELECT b.identity, CASE WHEN n > 1 THEN coalesce(total, 0) / (n * (n - 1) / 2) ELSE 1 END AS bios FROM b LEFT JOIN t USING (identity)),
 g AS (SELECT o.identity, o.username, CASE WHEN followers > 0 THEN log10(followers + 1) END AS lg, CASE WHEN account_age_days > 0 THEN account_age_days END AS age FROM o), k AS (SELECT *, age - lag(age) OVER (PARTITION BY identity ORDER BY age NULLS FIRST) AS gap FROM g), m AS (SELECT k.identity, count(*) AS found, CASE WHEN count(lg) >= 2 THEN greatest(0, 1 - (max(lg) - min(lg)) / 5) ELSE 1 END AS f, coalesce(least(min(gap) / 365, 1), 1) AS a, avg(jaro_winkler_similarity(lower(q.username), lower(k.username))) AS u FROM k JOIN q USING (identity) GROUP BY k.identity)
 SELECT q.identity, coalesce(found, 0) AS platforms_found, round(coalesce(found, 0) / 9, 4) AS presence_ratio, round(coalesce(bios, 1), 4) AS bio_similarity, round(coalesce(f, 1), 4) AS follower_consistency, round(coalesce(a, 1), 4) AS age_consistency, round(coalesce(u, 1), 4) AS name_similarity,
 round(CASE WHEN coalesce(found, 0) > 0 THEN 0.30E0 * coalesce(bios, 1) + 0.25E0 * coalesce(f, 1) + 0.25E0 * coalesce(a, 1) + 0.20E0 * coalesce(u, 1) ELSE 0.5 END, 4) AS overall FROM q LEFT JOIN m USING (identity) LEFT JOIN c USING (identity)""")
def jon17_jon18_identities(spark, sf_dir):
    """Five accounts on five platforms stand for one person; the first is the one that is asked about."""
    p = load(spark, sf_dir, "v_profiles").withColumn("identity", F.floor(F.col("account_id") / 5))
    return identity.consistency(p.where("account_id % 5 <> 0"), p.where("account_id % 5 = 0"), 9)


# Published accuracies by platform.
PUBLISHED = {"instagram": 0.977, "discord": 1.0, "facebook": 1.0, "x": 1.0, "linkedin": 1.0, "github": 0.98, "youtube": 1.0, "tiktok": 1.0, "reddit": 1.0, "snapchat": 1.0}


@query(f"WITH {_SCORED}, b(platform, published) AS (VALUES {', '.join(f'({p!r}, {v}E0)' for p, v in PUBLISHED.items())}), m AS (SELECT platform, avg(CAST((prediction = 'Fake') = (y = 1) AS INT)) AS accuracy FROM scored GROUP BY platform) SELECT platform, round(accuracy, 4) AS accuracy, published, round(accuracy - published, 4) AS delta FROM m JOIN b USING (platform)")
def jon21_against_published(spark, sf_dir):
    base = spark.createDataFrame(list(PUBLISHED.items()), "platform string, published double")
    own = scored(spark, sf_dir).groupBy("platform").agg(F.avg(((F.col("prediction") == "Fake") == (F.col("y") == 1)).cast("int")).alias("accuracy"))
    return own.join(base, "platform").select("platform", F.round("accuracy", 4).alias("accuracy"), "published", F.round(F.col("accuracy") - F.col("published"), 4).alias("delta"))


@query(f"WITH {_SCORED}, b AS (SELECT account_id, CASE WHEN (account_id * 31) % 100 >= 55 THEN 'Fake' ELSE 'Legit' END AS other FROM v_profiles) SELECT account_id, prediction, other, prediction = other AS same FROM scored JOIN b USING (account_id) ORDER BY account_id LIMIT 200")
def jon19_side_by_side(spark, sf_dir):
    other = load(spark, sf_dir, "v_profiles").select("account_id", F.when((F.col("account_id") * 31) % 100 >= 55, "Fake").otherwise("Legit").alias("other"))
    both = scored(spark, sf_dir).select("account_id", "prediction").join(other, "account_id")
    return both.withColumn("same", F.col("prediction") == F.col("other")).orderBy("account_id").limit(200)


_FEATURES = "['followers', 'following', 'posts', 'account_age_days']"
_DRIFT = f"""{ctes('v_profiles')}, l AS (SELECT account_id % 3 = 0 AS recent, unnest({_FEATURES}) AS feature, unnest([CAST(followers AS DOUBLE), CASE WHEN account_id % 3 = 0 THEN following / 2 ELSE following END, posts, account_age_days]) AS v FROM v_profiles), e AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM l GROUP BY feature),
 c AS (SELECT feature, least(CAST(floor((v - lo) / (hi - lo) * 10) AS BIGINT), 9) AS b, count(*) FILTER (NOT recent) AS e, count(*) FILTER (recent) AS a FROM l JOIN e USING (feature) GROUP BY ALL), r AS (SELECT feature, e / sum(e) OVER (PARTITION BY feature) AS e, a / sum(a) OVER (PARTITION BY feature) AS a FROM c),
 p AS (SELECT feature, greatest(round(sum((a - e) * ln((a + 1e-9) / (e + 1e-9))), 6), 0) AS psi FROM r GROUP BY feature), d AS (SELECT feature, psi, CASE WHEN psi < 0.1 THEN 'ok' WHEN psi < 0.2 THEN 'warn' ELSE 'alert' END AS level FROM p)"""


def halves(spark, sf_dir):
    p = load(spark, sf_dir, "v_profiles").select("account_id", *[F.col(c).cast("double").alias(c) for c in ("followers", "following", "posts", "account_age_days")])
    recent = p.where("account_id % 3 = 0").withColumn("following", F.col("following") / 2).withColumn("confidence", F.lit(1.0))
    return p.where("account_id % 3 <> 0").drop("account_id").withColumn("confidence", F.lit(2.0)), recent.drop("account_id")


@query(f"WITH {_DRIFT} SELECT * FROM d")
def agg14_feature_drift(spark, sf_dir):
    return monitor.feature_drift(*halves(spark, sf_dir))


@query(f"WITH {_DRIFT}, m AS (SELECT max(psi) AS max_psi, coalesce(array_to_string(list(feature ORDER BY feature) FILTER (psi >= 0.1), ','), '') AS drifted FROM d) SELECT max_psi, CASE WHEN max_psi < 0.1 THEN 'ok' WHEN max_psi < 0.2 THEN 'warn' ELSE 'alert' END AS level, drifted, max_psi >= 0.2 AS retrain FROM m")
def agg15_drift_summary(spark, sf_dir):
    return monitor.drift_summary(monitor.feature_drift(*halves(spark, sf_dir))).withColumn("drifted", F.array_join("drifted", ","))


@query("SELECT event_id, CAST(ntile(6) OVER (ORDER BY ts, event_id) AS INT) AS bucket FROM events")
def mdl4_temporal_folds(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return calibration.expanding_folds(e, 5, ["ts", "event_id"]).select("event_id", "bucket")


@query("WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O') SELECT 'both' AS kind, id FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'either', id FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'first', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b)")
def set3_sets(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")) for s in "FO")
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "id")
    return named("both", a.intersect(b)).unionByName(named("either", a.union(b).distinct())).unionByName(named("first", a.subtract(b)))


# The table comes in as six arrivals: two of 60 rows, which only together are enough for a check, then quarters of the rest.
_ARRIVAL = "CASE WHEN event_id < 60 THEN 0 WHEN event_id < 120 THEN 1 ELSE 2 + event_id % 4 END"


@query(f"""WITH e AS (SELECT value AS v, CAST(event_id % 2 = 0 AS INT) AS train, CASE WHEN event_id < 120 THEN 1 ELSE 2 + event_id % 4 END AS batch FROM events WHERE value IS NOT NULL),
x AS (SELECT b.batch, e.v, 1 AS recent FROM (SELECT DISTINCT batch FROM e) b JOIN e USING (batch) UNION ALL SELECT b.batch, e.v, 0 FROM (SELECT DISTINCT batch FROM e) b, e WHERE train = 1),
l AS (SELECT batch, min(v) AS lo, max(v) AS hi FROM x GROUP BY batch), c AS (SELECT batch, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / (hi - lo) * 10), 9) END AS bin, count(*) FILTER (recent = 0) AS e, count(*) FILTER (recent = 1) AS a FROM x JOIN l USING (batch) GROUP BY ALL),
s AS (SELECT batch, e / sum(e) OVER (PARTITION BY batch) AS e, a / sum(a) OVER (PARTITION BY batch) AS a FROM c), p AS (SELECT batch, greatest(round(sum((a - e) * ln((a + 1e-9) / (e + 1e-9))), 6), 0) AS psi FROM s GROUP BY batch)
SELECT CAST(batch AS BIGINT) AS batch, CASE WHEN batch = 1 THEN 0 ELSE CAST(batch AS BIGINT) END AS first_batch, (SELECT count(*) FROM e WHERE e.batch = p.batch) AS n, 'value' AS feature, psi, CASE WHEN psi < 0.1 THEN 'ok' WHEN psi < 0.2 THEN 'warn' ELSE 'alert' END AS level FROM p""")
def stm6_incremental_drift(spark, sf_dir):
    """A stream that is stopped and started for each arrival: whenever 100 rows have come in that no check has seen, their drift against the training half is checked."""
    events, folder = spark.read.parquet(f"{sf_dir}/events.parquet"), shared_folder(spark, "drift")
    ledger = guild.DriftLedger(spark, folder, events.where("event_id % 2 = 0").select("value"), 100)
    for k in range(6):
        events.select("event_id", "value").where(f"{_ARRIVAL} = {k} and value is not null").write.mode("append").parquet(f"{folder}/arrivals")
        out = ledger.drained(spark.readStream.schema("event_id long, value double").parquet(f"{folder}/arrivals").select("value"))
    return out


# models
FEATURES = ["followers", "following", "posts", "account_age_days", "is_verified"]


def examples(spark, sf_dir):
    return load(spark, sf_dir, "v_profiles").select("account_id", "platform", *FEATURES).join(load(spark, sf_dir, "v_scores").select("account_id", "y"), "account_id")


@query()
def mdl2_stacking(spark, sf_dir):
    """A logistic model over out-of-fold probabilities of the base classifiers."""
    rows = tables.settled(examples(spark, sf_dir).withColumn("held_out", F.pmod(F.xxhash64("account_id"), F.lit(5)) == 0))  # read by the fits and by the scores
    return rules.decided(training.stacked(rows.where("not held_out"), rows, FEATURES)).select("account_id", "y", "held_out", "prediction", "confidence")


@query()
def mdl7_smote(spark, sf_dir):
    return training.oversampled(examples(spark, sf_dir), FEATURES, adaptive=False)


@query()
def mdl8_adasyn(spark, sf_dir):
    return training.oversampled(examples(spark, sf_dir), FEATURES, adaptive=True)


@query()
def mdl10_search(spark, sf_dir):
    return training.searched(examples(spark, sf_dir), FEATURES)


@query()
def mdl16_anomalies(spark, sf_dir):
    return training.anomalies(examples(spark, sf_dir), FEATURES)


@query()
def mdl18_stability(spark, sf_dir):
    rows = examples(spark, sf_dir)
    return training.stability(training.fit(rows, FEATURES), rows, FEATURES)


@query()
def mdl19_history(spark, sf_dir):
    """A row of metrics for each platform that can be trained, on rows held out."""
    return training.history(examples(spark, sf_dir), FEATURES)


@query()
def mdl3_cross_validation(spark, sf_dir):
    """Means over stratified folds of a vote's metrics on rows it has not seen."""
    return training.cross_validated(training.out_of_fold(examples(spark, sf_dir), FEATURES))


@query()
def mdl20_retraining(spark, sf_dir):
    """A vote trained anew on the first rows and on all corrected reviews, by folds: what it says of rows it has not seen."""
    from authscope.operators import feedback
    from authscope.plans import files

    sent = files.reviews(spark, sf_dir).withColumn("profile_data_json", F.to_json(F.struct("followers", "posts"))).where("corrected_label is not null")
    first = load(spark, sf_dir, "v_profiles").where("label is not null").select("account_id", "followers", "posts", feedback.binary(F.col("label")).alias("label"))
    return training.cross_validated(training.retrained(first, feedback.unpacked(sent, "followers double, posts double"), ["followers", "posts"])[1])


@query()
def prj27_noise(spark, sf_dir):
    return training.noisy(examples(spark, sf_dir), FEATURES)


@query("WITH s AS (SELECT c_custkey AS account_id, CASE WHEN (c_custkey * 7919) % 1000 + (c_custkey % 11) * 40 > 600 THEN 1 ELSE 0 END AS y FROM customer) SELECT y, CAST(least(count(*), round((SELECT count(*) FROM s) * CASE y WHEN 1 THEN 0.35E0 ELSE 0.65E0 END / 2)) AS BIGINT) AS n FROM s GROUP BY y")
def prj28_quotas(spark, sf_dir):
    """Half as many rows as the pool, 35 per cent of them fakes, chosen by a hash of the id."""
    s = load(spark, sf_dir, "v_scores").select("account_id", "y")
    return training.by_quota(s, "y", {1: 0.35, 0: 0.65}, 0.5).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
