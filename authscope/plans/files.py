"""Registered queries of readers, writers, adapters, logs and feedback. Files are written in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from authscope.operators import feedback
from authscope.plans.registry import _SCORED, query, scored
from authscope.sources import adapters, tables
from authscope.sources.views import ctes, load

_P, _A = ctes("v_profiles"), ctes("v_accounts")


@query(f"WITH {_P} SELECT account_id, username, CAST(followers AS BIGINT) AS followers FROM v_profiles WHERE platform = 'github'")
def src1_csv(spark, sf_dir):
    path = tables.shared_folder(spark, "csv")
    rows = load(spark, sf_dir, "v_profiles").where("platform = 'github'").select(F.col("account_id").alias(" Account_Id "), F.col("username").alias("USERNAME"), "followers")
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, "account_id long, username string, followers long")


_EXPECTED = {"instagram": ["username", "followers", "following", "posts", "bio"], "x": ["username", "followers", "tweets"], "github": ["username", "public_repos"]}
_COLS = "CASE account_id % 4 WHEN 0 THEN 'Username,followers , bio' WHEN 1 THEN 'username,TWEETS' WHEN 2 THEN '' ELSE 'username,followers,following,posts,bio,tweets,public_repos' END"


@query(f"WITH {_P}, f AS (SELECT account_id, platform, list_transform(string_split({_COLS}, ','), lambda c: lower(trim(c))) AS c FROM v_profiles), e AS (SELECT account_id, c, CASE platform WHEN 'instagram' THEN {_EXPECTED['instagram']} WHEN 'x' THEN {_EXPECTED['x']} WHEN 'github' THEN {_EXPECTED['github']} ELSE [] END AS w FROM f) SELECT CAST(account_id AS VARCHAR) AS path, array_to_string(list_filter(w, lambda x: NOT list_contains(c, x)), ',') AS missing FROM e")
def src5_expected_columns(spark, sf_dir):
    files = load(spark, sf_dir, "v_profiles").select(F.col("account_id").cast("string").alias("path"), "platform", F.split(F.expr(_COLS), ",").alias("columns"))
    return tables.missing_columns(files, _EXPECTED).select("path", F.array_join("missing", ",").alias("missing"))


_FAKE = "CASE account_id % 3 WHEN 0 THEN 'fake' WHEN 1 THEN '0' ELSE 'unknown' END"


@query(f"WITH {_A} SELECT account_id, followers, following, posts, profile_pic AS has_profile_pic, public_gists AS bio_len_raw, CASE account_id % 3 WHEN 0 THEN 1 ELSE 0 END AS label FROM v_accounts WHERE account_id % 3 < 2")
def src7_instagram_ready(spark, sf_dir):
    rows = load(spark, sf_dir, "v_accounts").select("account_id", F.col("followers").alias("#Followers"), F.col("following").alias("#follows"), F.col("posts").alias("#posts"), F.col("profile_pic").alias("profile pic "), F.col("public_gists").alias("description length"), F.expr(_FAKE).alias("fake"))
    return adapters.adapted(rows, "instagram_kaggle")


_SURVEY = "account_id, username, followers, following, tweets, is_verified, bio"


def layout(spark, sf_dir):
    return load(spark, sf_dir, "v_accounts").select("account_id", F.col("username").alias("screen_name"), F.col("followers").alias("Followers_Count"), F.col("following").alias("friends_count"), F.col("tweets").alias("statuses_count"), F.col("is_verified").alias("verified"), F.col("bio").alias("description"))


@query(f"WITH {_A} SELECT {_SURVEY}, CASE account_id % 3 WHEN 0 THEN 1 ELSE 0 END AS label FROM v_accounts WHERE account_id % 3 < 2")
def src8_bot_survey(spark, sf_dir):
    return adapters.adapted(layout(spark, sf_dir).withColumn("label", F.expr(_FAKE)), "twibot20")


@query(f"WITH {_A} SELECT {_SURVEY}, 1 AS label FROM v_accounts")
def src9_bot_study(spark, sf_dir):
    return adapters.bot_study(layout(spark, sf_dir), 1)


@query(f"WITH {_A} SELECT account_id, followers, friends AS following, videos AS tweets, CASE account_id % 3 WHEN 0 THEN 1 ELSE 0 END AS label FROM v_accounts WHERE account_id % 3 < 2")
def src10_generic(spark, sf_dir):
    rows = load(spark, sf_dir, "v_accounts").select("account_id", F.col("followers").alias("follower_count"), "friends", "videos", F.expr(_FAKE).alias("is_bot"))
    return adapters.adapted(rows, "no such adapter")


@query(f"WITH {_A} SELECT count(*) AS rows, CAST(count(*) FILTER (account_id % 3 = 0) AS BIGINT) AS fakes, CAST(count(*) FILTER (account_id % 3 = 1) AS BIGINT) AS legit FROM v_accounts WHERE account_id % 3 < 2")
def src11_dispatch(spark, sf_dir):
    """A file that lacks the asked adapter's label falls back to the generic one."""
    rows = load(spark, sf_dir, "v_accounts").select("account_id", "followers", F.expr(_FAKE).alias("bot"))
    return adapters.summary(adapters.adapted(rows, "instagram_kaggle"))


_PATH = "concat('data/', CASE account_id % 5 WHEN 0 THEN 'Instagram' WHEN 1 THEN 'x_train' WHEN 2 THEN 'Reddit-old' WHEN 3 THEN 'misc' ELSE 'twitter_set' END, '/file', CAST(account_id AS STRING), '.csv')"
_HEAD = "CASE account_id % 6 WHEN 0 THEN '#Followers,fake' WHEN 1 THEN 'followers_count,label' WHEN 2 THEN 'friends_count,bot' WHEN 3 THEN 'a,b' WHEN 4 THEN ' Label ,x' ELSE 'is_fake,target,y' END"


@query(f"""WITH {_P}, f AS (SELECT account_id, {_PATH} AS path, account_id % 6 AS h FROM v_profiles WHERE account_id % 6 <> 3) SELECT path, split_part(path, '/', 3) AS filename, CASE WHEN h = 0 THEN 'instagram' WHEN h IN (1, 2) THEN 'x' ELSE CASE account_id % 5 WHEN 0 THEN 'instagram' WHEN 2 THEN 'reddit' WHEN 3 THEN 'unknown' ELSE 'x' END END AS platform,
 CASE h WHEN 0 THEN 'instagram_kaggle' WHEN 1 THEN 'twibot20' WHEN 2 THEN 'cresci17' ELSE 'generic' END AS adapter, CASE h WHEN 0 THEN 'fake' WHEN 2 THEN 'bot' WHEN 5 THEN 'is_fake' ELSE 'label' END AS label_col FROM f""")
def src12_catalogue(spark, sf_dir):
    files = load(spark, sf_dir, "v_profiles").select(F.expr(_PATH).alias("path"), F.split(F.expr(_HEAD), ",").alias("columns"))
    return adapters.catalogue(files)


@query(f"WITH {_P} SELECT label AS value, count(*) AS n, 11 AS columns, 10 AS features, 'label' AS label_col FROM v_profiles GROUP BY label")
def src13_description(spark, sf_dir):
    return adapters.described(load(spark, sf_dir, "v_profiles").withColumn("row", F.lit(1)))


@query("SELECT lower(trim(c_mktsegment)) || CAST(c_custkey AS VARCHAR) AS entry, 'all' AS platform FROM customer WHERE c_custkey % 5 >= 2 UNION ALL SELECT lower(c_name), CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'reddit' END FROM customer")
def src14_reference_lists(spark, sf_dir):
    """Lists as lines with comments, written as text and read back, and as JSON by platform."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, path = F.col("c_custkey"), tables.shared_folder(spark, "list")
    c.select(F.when(k % 5 == 0, F.concat(F.lit("# "), "c_name")).when(k % 5 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_mktsegment", k.cast("string"), F.lit(" "))).alias("value")).write.text(path)
    body = c.select(F.to_json(F.create_map(F.when(k % 2 == 0, "X").otherwise("reddit"), F.array("c_name"))).alias("body"))
    return adapters.listed(spark.read.text(path)).withColumn("platform", F.lit("all")).unionByName(adapters.listed_by_platform(body))


@query(f"WITH {_SCORED} SELECT account_id, platform, prediction, confidence FROM scored")
def src15_results(spark, sf_dir):
    path = tables.shared_folder(spark, "results")
    tables.write_results(scored(spark, sf_dir), path)
    return spark.read.parquet(path).select("account_id", "platform", "prediction", "confidence")


@query(f"WITH {_P} SELECT account_id, followers, label FROM v_profiles WHERE label IS NOT NULL")
def src16_training_set(spark, sf_dir):
    path = tables.shared_folder(spark, "training")
    tables.write_training_set(load(spark, sf_dir, "v_profiles").select("account_id", "followers", "label"), path, "label is not null")
    return spark.read.parquet(path)


@query(f"WITH {_SCORED} SELECT username, platform, prediction, confidence, 'quick' AS analysis_depth, '{{\"followers\":' || CAST(followers AS VARCHAR) || ',\"posts\":' || CAST(posts AS VARCHAR) || '}}' AS features_json FROM scored UNION ALL SELECT username, platform, prediction, confidence, 'quick', '{{\"following\":' || CAST(following AS VARCHAR) || '}}' FROM scored WHERE prediction = 'Fake'")
def src17_jsn2_audit_log(spark, sf_dir):
    """Two batches appended to one log."""
    path, rows = tables.shared_folder(spark, "audit"), scored(spark, sf_dir)
    tables.append_log(tables.audit_rows(rows, ["followers", "posts"], "2024-02-01"), path)
    tables.append_log(tables.audit_rows(rows.where("prediction = 'Fake'"), ["following"], "2024-02-02"), path)
    return spark.read.parquet(path).drop("created_at")


@query("SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'signup'")
def src21_signal_sink(spark, sf_dir):
    """A stream that appends signal rows."""
    from authscope.streaming import guild

    return guild.drained(guild.events(spark, sf_dir).where("event_type = 'signup'").select("event_id", "user_id", F.unix_micros("ts").alias("at")))


@query(f"WITH {_SCORED}, l AS (SELECT unnest(['followers', 'following']) AS feature, unnest([followers, following]) AS v FROM scored) SELECT 'summary' AS sheet, 'fake_rate' AS name, round(100 * avg(CAST(prediction = 'Fake' AS INT)), 1) AS value FROM scored UNION ALL SELECT 'predictions', platform, CAST(count(*) AS DOUBLE) FROM scored GROUP BY platform UNION ALL SELECT 'statistics', feature, round(avg(v), 3) FROM l GROUP BY feature")
def src22_report(spark, sf_dir):
    sheets = tables.report(scored(spark, sf_dir), ["followers", "following"])
    a = sheets["summary"].select(F.lit("summary").alias("sheet"), F.lit("fake_rate").alias("name"), F.col("fake_rate").alias("value"))
    b = sheets["predictions"].groupBy("platform").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("predictions").alias("sheet"), F.col("platform").alias("name"), "value")
    return a.unionByName(b).unionByName(sheets["statistics"].select(F.lit("statistics").alias("sheet"), F.col("feature").alias("name"), F.col("mean").alias("value")))


# feedback: orders stand for reviews of accounts
_FB = "SELECT o_orderkey AS id, p.platform, p.account_id, CASE WHEN o_totalprice > 200000 THEN 'Fake' ELSE 'Legit' END AS predicted_label, CASE o_orderstatus WHEN 'F' THEN 'Fake' WHEN 'O' THEN 'Legit' END AS corrected_label, 50 + o_orderkey % 50 AS confidence, o_orderdate AS told_at, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS is_reviewed, p.followers, p.posts FROM orders JOIN v_profiles p ON p.account_id = o_custkey"
_F = f"{_P}, fb AS ({_FB})"


def reviews(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p = load(spark, sf_dir, "v_profiles").select("account_id", "platform", "followers", "posts")
    return o.join(p, o.o_custkey == p.account_id).select(F.col("o_orderkey").alias("id"), "platform", "account_id", F.when(F.col("o_totalprice") > 200000, "Fake").otherwise("Legit").alias("predicted_label"), F.when(F.col("o_orderstatus") == "F", "Fake").when(F.col("o_orderstatus") == "O", "Legit").alias("corrected_label"), (50 + F.col("o_orderkey") % 50).alias("confidence"), F.col("o_orderdate").cast("timestamp").alias("told_at"), F.rlike("o_orderpriority", F.lit("^[12]")).alias("is_reviewed"), "followers", "posts")


@query(f"WITH {_F}, a AS (SELECT id, 'pending' AS list FROM fb WHERE NOT is_reviewed ORDER BY told_at DESC, id LIMIT 100), b AS (SELECT id, 'all' AS list FROM fb ORDER BY told_at DESC, id LIMIT 500) SELECT * FROM a UNION ALL SELECT * FROM b")
def flt5_top4_reviews(spark, sf_dir):
    r = reviews(spark, sf_dir)
    return feedback.pending(r).select("id", F.lit("pending").alias("list")).unionByName(feedback.newest(r).select("id", F.lit("all").alias("list")))


@query(f"WITH {_F} SELECT id, platform, corrected_label FROM fb WHERE corrected_label IS NOT NULL AND platform = 'github'")
def flt6_corrected(spark, sf_dir):
    return feedback.corrected(reviews(spark, sf_dir), "github").select("id", "platform", "corrected_label")


@query(f"WITH {_F} SELECT id, is_reviewed OR id % 7 = 0 AS is_reviewed FROM fb")
def flt7_mark_reviewed(spark, sf_dir):
    r = reviews(spark, sf_dir)
    return feedback.marked(r, r.where("id % 7 = 0").select("id")).select("id", "is_reviewed")


@query(f"WITH {_F} SELECT coalesce(platform, 'all') AS platform, count(*) AS total, count(*) FILTER (NOT is_reviewed) AS pending, round(avg(CAST(corrected_label IS NOT NULL AND corrected_label <> predicted_label AS INT)), 3) AS correction_rate FROM fb GROUP BY ROLLUP (platform)")
def agg11_review_statistics(spark, sf_dir):
    return feedback.statistics(reviews(spark, sf_dir))


@query(f"WITH {_F} SELECT account_id, CAST(followers AS DOUBLE) AS followers, CAST(posts AS DOUBLE) AS posts, CASE WHEN corrected_label = 'Fake' THEN 1 ELSE 0 END AS label FROM fb WHERE corrected_label IS NOT NULL AND platform = 'reddit' UNION ALL SELECT account_id, CAST(followers AS DOUBLE), NULL, CASE WHEN label = 'fake' THEN 1 ELSE 0 END FROM v_profiles WHERE label IS NOT NULL AND platform = 'reddit'")
def set2_jsn1_retraining_rows(spark, sf_dir):
    """Reviewed rows, their features from JSON, and the rows of the first training, which know fewer features."""
    sent = reviews(spark, sf_dir).withColumn("profile_data_json", F.to_json(F.struct("followers", "posts")))
    first = load(spark, sf_dir, "v_profiles").where("label is not null and platform = 'reddit'").select("account_id", F.col("followers").cast("double").alias("followers"), F.col("label"))
    return feedback.retraining(feedback.corrected(sent, "reddit"), first, "followers double, posts double")


_CAL = f"{_F}, c AS (SELECT platform, least(greatest(CASE WHEN predicted_label = 'Fake' THEN confidence / 100 ELSE 1 - confidence / 100 END, 1e-6), 1 - 1e-6) AS p, CASE WHEN corrected_label = 'Fake' THEN 1 ELSE 0 END AS y FROM fb WHERE corrected_label IS NOT NULL)"


@query(f"WITH {_CAL}, g AS (SELECT i / 10 AS temperature FROM range(3, 30) t(i)) SELECT temperature, round(avg(pow(1 / (1 + exp(-ln(p / (1 - p)) / temperature)) - y, 2)), 6) AS brier FROM c, g GROUP BY temperature")
def mdl15_recalibration(spark, sf_dir):
    """Temperatures over corrected feedback: confidence as a probability of Fake."""
    from authscope.operators import calibration

    return calibration.temperature(feedback.calibration_rows(reviews(spark, sf_dir)))


# latest and trends: orders as a log of metrics by platform
_LOG = f"{_P}, log AS (SELECT p.platform, o_orderkey AS id, o_orderdate AS tm, o_totalprice AS psi FROM orders JOIN v_profiles p ON p.account_id = o_custkey)"


def log(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p = load(spark, sf_dir, "v_profiles").select("account_id", "platform")
    return o.join(p, o.o_custkey == p.account_id).select("platform", F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("tm"), F.col("o_totalprice").alias("psi"))


@query(f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY tm DESC, id DESC) AS r FROM log) SELECT platform, max(id) FILTER (r = 1) AS id, round(max(psi) FILTER (r = 1), 2) AS psi, array_to_string(list(CAST(id AS VARCHAR) ORDER BY r DESC) FILTER (r <= 10), ',') AS trend FROM r GROUP BY platform")
def win8_win9_latest(spark, sf_dir):
    return feedback.latest(log(spark, sf_dir), "platform", ["tm", "id"], 10).select("platform", F.col("last.id").alias("id"), F.round("last.psi", 2).alias("psi"), F.array_join(F.transform("trend", lambda x: x["id"]), ",").alias("trend"))


@query(f"WITH {_LOG}, m AS (SELECT platform, max(psi) AS max_psi FROM log GROUP BY platform) SELECT platform, round(max_psi, 2) AS max_psi, row_number() OVER (ORDER BY max_psi DESC, platform) AS place FROM m")
def top3_drift_order(spark, sf_dir):
    m = log(spark, sf_dir).groupBy("platform").agg(F.max("psi").alias("max_psi"))
    return feedback.placed(m, [F.desc("max_psi"), F.col("platform")]).withColumn("max_psi", F.round("max_psi", 2))


@query(f"WITH {_SCORED} SELECT account_id, confidence FROM scored ORDER BY confidence DESC, account_id LIMIT 200")
def top2_anomaly_head(spark, sf_dir):
    """The 200 rows of the highest score."""
    return scored(spark, sf_dir).orderBy(F.desc("confidence"), "account_id").limit(200).select("account_id", "confidence")


@query()
def top5_shuffled(spark, sf_dir):
    """All rows in an order that a seed decides, the same at every run."""
    return feedback.shuffled(load(spark, sf_dir, "v_profiles"), "account_id", 42).select("account_id", "platform")
