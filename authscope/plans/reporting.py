"""Registered queries of the report and content operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from authscope.operators import content, language, profiles, reports, scaling
from authscope.plans.registry import _SCORED, MARKED, query, scored
from authscope.sources import tables, versions
from authscope.sources.views import PLATFORMS, ctes, load

_Y = "CASE WHEN lower(label) = 'fake' THEN 1 WHEN lower(label) = 'legit' THEN 0 END"
_P = ctes("v_profiles") + f", p AS (SELECT *, {_Y} AS y FROM v_profiles)"
# Platforms and names of known figures, of the kind the operator takes as a table.
KNOWN = [("x", "building.42"), ("instagram", "user1000020"), ("reddit", "googie8")]


def labelled(spark, sf_dir):
    return load(spark, sf_dir, "v_profiles").withColumn("y", profiles.binary_label(F.col("label")))


def predicted(spark, sf_dir):
    return load(spark, sf_dir, "v_scores").select("account_id", "y", F.expr(f"cast({MARKED} as int)").alias("pred"))


@query(f"WITH {_SCORED} SELECT platform, count(*) AS n, round(100 * avg(CAST(prediction = 'Fake' AS INT)), 1) AS fake_rate FROM scored GROUP BY platform")
def agg1_agg2_fake_rate(spark, sf_dir):
    return reports.fake_rate(scored(spark, sf_dir), "platform", F.col("prediction") == "Fake")


@query(f"WITH {ctes('v_scores')}, s AS (SELECT count(*) AS n, sum(y) AS f, sum(CAST(raw_proba >= 0.45E0 AS INT)) AS c FROM v_scores) SELECT n, greatest(f - c, 0) AS net_missed, greatest(c - f, 0) AS net_wrong, round(CASE WHEN f > 0 THEN 100 * greatest(f - c, 0) / f ELSE 0 END, 2) AS missed_rate, round(CASE WHEN n > f THEN 100 * greatest(c - f, 0) / (n - f) ELSE 0 END, 2) AS wrong_rate FROM s")
def agg4_net_errors(spark, sf_dir):
    return reports.net_errors(predicted(spark, sf_dir))


@query(f"WITH {_P} SELECT y, count(*) AS n FROM p GROUP BY y")
def agg5_classes(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


_NUM = ["followers", "following", "posts", "account_age_days"]
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


@query(f"WITH {_P} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM p" for a, b in _PAIRS))
def agg7_correlations(spark, sf_dir):
    return reports.correlations(load(spark, sf_dir, "v_profiles"), _NUM)


@query(f"""WITH {_P}, l AS (SELECT y, unnest(['followers', 'following', 'posts']) AS feature, unnest([CAST(followers AS DOUBLE), following, posts]) AS v FROM p WHERE y IS NOT NULL), e AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM l GROUP BY feature HAVING max(v) > min(v)),
 c AS (SELECT feature, y, CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, (hi - lo) / 20 AS width, count(*) AS n FROM l JOIN e USING (feature) GROUP BY ALL) SELECT feature, y, bin, n, round(n / (sum(n) OVER (PARTITION BY feature, y) * width), 9) AS density FROM c""")
def agg8_histograms(spark, sf_dir):
    return reports.histograms(labelled(spark, sf_dir), "y", ["followers", "following", "posts"])


@query(f"WITH {_P} SELECT platform, coalesce(median(followers) FILTER (y = 0), 150) AS followers, coalesce(median(posts) FILTER (y = 0), 15) AS posts FROM p GROUP BY platform")
def agg10_platform_defaults(spark, sf_dir):
    return reports.platform_defaults(labelled(spark, sf_dir), ["followers", "posts"], {"followers": 150.0, "posts": 15.0})


@query(f"WITH {_SCORED} SELECT CASE WHEN grouping(platform) = 1 THEN 'all' ELSE platform END AS segment, count(*) AS n, count(*) FILTER (account_id % 3 = 0) AS pending, round(avg(CAST((prediction = 'Fake') <> (y = 1) AS INT)), 3) AS correction_rate FROM scored GROUP BY ROLLUP (platform)")
def agg11_feedback(spark, sf_dir):
    return reports.totals(scored(spark, sf_dir), "platform", (F.col("prediction") == "Fake") != (F.col("y") == 1), F.col("account_id") % 3 == 0)


@query(f"WITH {ctes('v_posts')}, w AS (SELECT account_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w, CAST(regexp_matches(text, 'https?://|www\\.') AS INT) AS u, length(text) AS c, CAST(coalesce(regexp_matches(lower(trim(text)), '{language.REPOST}'), false) AS INT) AS o, CAST(coalesce(contains(lower(text), 'reply'), false) OR length(text) % 7 = 3 AS INT) AS s FROM v_posts) SELECT account_id, round(avg(w), 4) AS mean_words, round(coalesce(var_samp(w), 0), 3) AS var_words, round(avg(u), 4) AS url_ratio, round(avg(c), 4) AS mean_chars, round(var_pop(c), 4) AS var_chars, round(1 - avg(o), 4) AS original_ratio, round(avg(s), 4) AS self_reply_ratio FROM w GROUP BY account_id")
def agg20_agg24_post_shape(spark, sf_dir):
    reply = F.lower("text").contains("reply") | (F.length("text") % 7 == 3)
    return content.post_shape(load(spark, sf_dir, "v_posts"), reply=reply)


# Posts of four platforms: each kind of event knows its likes and comments by other names, some are 0 or not known.
_METRICS = [("like_count", "event_type = 'view'", "floor(value)"), ("ups", "event_type IN ('view', 'click')", "floor(value / 2)"), ("score", "event_type = 'purchase'", "floor(value) - 20"), ("likes", "event_type <> 'error'", "floor(value / 3)")]
_TALK = [("reply_count", "event_type = 'view'", "floor(value / 4)"), ("num_comments", "event_type <> 'view'", "floor(value / 10)")]
_NAMED = ", ".join(f"CASE WHEN {w} THEN {v} END AS {c}" for c, w, v in [*_METRICS, *_TALK])
_FIRST = lambda cols: "coalesce(" + ", ".join(f"nullif({c}, 0)" for c, _, _ in cols) + ", 0)"


@query(f"WITH m AS (SELECT user_id AS account_id, {_NAMED} FROM events), e AS (SELECT account_id, {_FIRST(_METRICS)} + {_FIRST(_TALK)} AS e FROM m) SELECT account_id, round(avg(e), 4) AS mean, round(coalesce(var_samp(e), 0), 3) AS variance, round(avg(CAST(e = 0 AS INT)), 4) AS zero_share FROM e GROUP BY account_id")
def agg21_engagement(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return content.engagement(e.select(F.col("user_id").alias("account_id"), *[F.expr(f"CASE WHEN {w} THEN {v} END").alias(c) for c, w, v in [*_METRICS, *_TALK]]))


@query(f"WITH {ctes('v_activity')}, d AS (SELECT account_id, CAST(ts AS DATE) AS d, count(*) AS n FROM v_activity GROUP BY ALL) SELECT account_id, round(CASE WHEN count(*) >= 3 THEN stddev_samp(n) ELSE 0 END, 4) AS regularity, datediff('day', max(d), DATE '2024-03-01') AS recency FROM d GROUP BY account_id")
def agg28_day_regularity(spark, sf_dir):
    return content.day_regularity(load(spark, sf_dir, "v_activity"), "2024-03-01")


@query(f"WITH {ctes('v_activity')}, g AS (SELECT account_id, floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY account_id ORDER BY ts, event_id)) / 86400000000) AS g FROM v_activity) SELECT account_id, round(coalesce(avg(g), 0), 4) AS gap_mean, round(coalesce(stddev_samp(g), 0), 4) AS gap_std FROM g GROUP BY account_id")
def agg31_day_gaps(spark, sf_dir):
    return content.day_gaps(load(spark, sf_dir, "v_activity"))


_TAGS = "regexp_extract_all(p.text, '[a-z]{{12,}}'{})"
_VIDEOS = "SELECT p.account_id, p.post_id AS video_id, e.ts, p.text AS description, {} AS tags, CASE WHEN e.event_type <> 'error' THEN floor(e.value) END AS comment_count FROM v_posts p LEFT JOIN events e ON e.event_id = p.post_id"


@query(f"""WITH {ctes('v_accounts', 'v_posts')}, v AS ({_VIDEOS.format(_TAGS.format(''))}), g AS (SELECT account_id, floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY account_id ORDER BY ts NULLS FIRST, video_id)) / 86400000000) AS g, len(regexp_extract_all(coalesce(description, ''), '\\S+')) AS w, coalesce(len(tags), 0) AS t, CAST(comment_count IS NULL AS INT) AS o FROM v),
 q AS (SELECT account_id, avg(g) AS g, stddev_samp(g) AS s, avg(w) AS w, avg(t) AS t, avg(o) AS o FROM g GROUP BY account_id), c AS (SELECT account_id, coalesce(subscribers, 0) AS s, greatest(coalesce(videos, 0), 1) AS n, avg_views * coalesce(videos, 0) AS views FROM v_accounts)
 SELECT account_id, round(c.s / n, 4) AS subscriber_to_video_ratio, round(views / n, 4) AS avg_views_per_video, round(coalesce(g, 0), 4) AS upload_frequency_days, round(coalesce(q.s, 0), 4) AS upload_regularity, round(views / n / greatest(c.s, 1), 4) AS view_to_subscriber_ratio,
 round(coalesce(w, 0), 4) AS description_length_avg, round(coalesce(t, 0), 4) AS tags_per_video_avg, round(coalesce(o, 0), 4) AS comment_disabled_ratio FROM c LEFT JOIN q USING (account_id)""")
def agg31_uploads(spark, sf_dir):
    """Posts as videos, their dates and comment counts from the events of the same ids."""
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).createOrReplaceTempView("events")
    load(spark, sf_dir, "v_posts").createOrReplaceTempView("v_posts")
    channels = load(spark, sf_dir, "v_accounts").select("account_id", "subscribers", F.col("videos").alias("n_videos"), (F.col("avg_views") * F.coalesce("videos", F.lit(0))).alias("views"))
    return content.uploads(spark.sql(_VIDEOS.format(_TAGS.format(", 0"))), channels)


@query(f"WITH {ctes('v_profiles')}, c AS (SELECT account_id, unnest(string_split(username, '')) AS c FROM v_profiles), n AS (SELECT account_id, c, count(*) AS n FROM c GROUP BY ALL), q AS (SELECT account_id, n / sum(n) OVER (PARTITION BY account_id) AS p FROM n) SELECT account_id, round(-sum(p * log2(p)), 4) AS entropy FROM q GROUP BY account_id")
def agg37_username_entropy(spark, sf_dir):
    return content.char_entropy(load(spark, sf_dir, "v_profiles"), "username")


@query(f"WITH {_P} SELECT platform, count(y) AS n, count(DISTINCT y) AS classes, count(y) >= 10 AND count(DISTINCT y) = 2 AS trainable FROM p GROUP BY platform")
def flt2_trainable(spark, sf_dir):
    return reports.trainable(labelled(spark, sf_dir), "platform", 10)


@query(f"WITH {_SCORED} SELECT account_id, CAST(confidence < 85 AND (confidence >= 40 OR trim(username) <> '') AS BOOLEAN) AS escalate FROM scored")
def flt8_escalation(spark, sf_dir):
    return scored(spark, sf_dir).select("account_id", ((F.col("confidence") < 85) & ((F.col("confidence") >= 40) | (F.trim("username") != ""))).alias("escalate"))


@query(f"WITH {ctes('v_profiles')}, k(platform, name) AS (VALUES {', '.join(map(str, KNOWN))}) SELECT account_id, CAST(name IS NOT NULL AS INT) AS known, CASE WHEN name IS NOT NULL THEN 99 END AS confidence FROM v_profiles p LEFT JOIN k ON k.platform = p.platform AND k.name = lower(p.username)")
def jon1_allow_list(spark, sf_dir):
    """The list is short and fixed here, so it is broadcast; a large one would be joined by sort and merge."""
    known = F.broadcast(spark.createDataFrame(KNOWN, "platform string, name string"))
    p = load(spark, sf_dir, "v_profiles").withColumn("name", F.lower("username")).join(known.withColumn("known", F.lit(1)), ["platform", "name"], "left")
    return p.select("account_id", F.coalesce("known", F.lit(0)).alias("known"), F.when(F.col("known") == 1, 99).alias("confidence"))


@query(f"WITH {ctes('v_edges', 'v_profiles')} SELECT src AS account_id, round(avg(coalesce(is_verified, 0)), 4) AS share FROM v_edges LEFT JOIN v_profiles ON account_id = dst GROUP BY src")
def jon7_followed_figures(spark, sf_dir):
    return content.followed_figures(load(spark, sf_dir, "v_edges"), load(spark, sf_dir, "v_profiles"))


@query(f"WITH {ctes('v_edges', 'v_profiles')} SELECT dst AS account_id, round(least(avg(least(account_age_days / 365, 1) * (0.5E0 + 0.25E0 * (account_id % 2) + 0.25E0 * CAST(bio IS NOT NULL AS INT))), 1), 4) AS quality FROM v_edges JOIN v_profiles ON account_id = src GROUP BY dst")
def jon8_follower_quality(spark, sf_dir):
    people = load(spark, sf_dir, "v_profiles").withColumns({"has_avatar": F.col("account_id") % 2, "has_bio": F.col("bio").isNotNull().cast("int")})
    return content.follower_quality(load(spark, sf_dir, "v_edges"), people)


@query(f"WITH {_SCORED}, d(platform) AS (VALUES {', '.join(f'({p!r})' for p in [*PLATFORMS, 'other'])}), f AS (SELECT platform, count(*) AS n FROM scored WHERE confidence < 60 GROUP BY platform) SELECT platform, coalesce(n, 0) AS n FROM d LEFT JOIN f USING (platform)")
def jon20_spine(spark, sf_dir):
    dim = spark.createDataFrame([(p,) for p in [*PLATFORMS, "other"]], "platform string")
    return reports.spine(dim, scored(spark, sf_dir).where("confidence < 60").groupBy("platform").agg(F.count(F.lit(1)).alias("n")), "platform")


@query(f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY prediction ORDER BY account_id) AS r FROM scored), f AS (SELECT * FROM r WHERE r <= 15) SELECT prediction, account_id, lead(account_id) OVER (PARTITION BY prediction ORDER BY account_id) AS \"to\", round(greatest(8, least(40, 8 + 2 * ln(1 + followers))), 4) AS size FROM f")
def jon22_network_sample(spark, sf_dir):
    return reports.chained(scored(spark, sf_dir), "prediction", "account_id", F.col("followers"))


@query(f"WITH {ctes('v_profiles')}, m AS (SELECT median(followers) FILTER (account_id % 3 <> 0) AS m FROM v_profiles) SELECT account_id, CASE WHEN account_id % 3 = 0 THEN m ELSE followers END AS followers FROM v_profiles, m")
def prj12_median_fill(spark, sf_dir):
    df = load(spark, sf_dir, "v_profiles").select("account_id", F.when(F.col("account_id") % 3 != 0, F.col("followers").cast("double")).alias("followers"))
    return scaling.filled(df, ["followers"])


@query(f"WITH {ctes('v_accounts')}, m AS (SELECT *, CASE WHEN platform = 'x' THEN tweets END AS t, CASE WHEN label = 'none' THEN 1 END AS never FROM v_accounts WHERE platform <> 'x'), l AS (SELECT unnest(['followers', 'tweets', 'never', 'posts']) AS feature, unnest([followers, t, never, posts]) AS v FROM m), c AS (SELECT feature FROM l GROUP BY feature HAVING count(v) = 0) SELECT feature, (SELECT count(*) FROM c) > greatest(1, 0.25E0 * 4) AS warn FROM c")
def prj8_absent_features(spark, sf_dir):
    """Trained features that a table has no value of: here those of one platform, and one that no row has."""
    m = load(spark, sf_dir, "v_accounts").where("platform <> 'x'")
    rows = m.select("followers", F.when(F.col("platform") == "x", F.col("tweets")).alias("tweets"), F.when(F.col("label") == "none", 1).alias("never"), "posts")
    return reports.absent_features(rows, ["followers", "tweets", "never", "posts"])



@query(f"WITH {ctes('v_profiles')} SELECT account_id, round(following / greatest(followers, 1), 4) AS ff_ratio, round(100 * posts / greatest(followers, 1), 4) AS posts_per_100, round(posts / greatest(account_age_days, 1), 4) AS posts_per_day, round(ln(1 + followers), 4) AS log_followers FROM v_profiles")
def prj19_ratios(spark, sf_dir):
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return load(spark, sf_dir, "v_profiles").select("account_id", F.round(F.col("following") / one("followers"), 4).alias("ff_ratio"), F.round(100 * F.col("posts") / one("followers"), 4).alias("posts_per_100"), F.round(F.col("posts") / one("account_age_days"), 4).alias("posts_per_day"), F.round(F.log1p("followers"), 4).alias("log_followers"))


@query(f"WITH {ctes('v_activity')}, r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, event_id DESC) AS r FROM v_activity) SELECT account_id, event_id FROM r WHERE r <= 20")
def src18_capped_history(spark, sf_dir):
    return reports.capped_history(load(spark, sf_dir, "v_activity"), "account_id", 20, F.desc("ts"), F.desc("event_id")).select("account_id", "event_id")


@query(f"WITH {ctes('v_activity')}, r AS (SELECT account_id, kind, max(epoch_us(ts)) AS t FROM v_activity GROUP BY ALL) SELECT account_id, kind, t AS checked_at FROM r WHERE t + 86400000000 > epoch_us(TIMESTAMP '2024-01-30 00:00:00')")
def src19_presence_cache(spark, sf_dir):
    t = F.unix_micros("ts")
    df = load(spark, sf_dir, "v_activity").select("account_id", "kind", t.alias("checked_at"), (t + 86_400_000_000).alias("expires_at"))
    now = F.unix_micros(F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return reports.latest_valid(df, ["account_id", "kind"], now).select("account_id", "kind", "checked_at")


_SEEN = """s AS (SELECT list_sum([CASE WHEN embedding[i + 1] > 0 THEN 1 << i ELSE 0 END for i in range(8)])::BIGINT AS phash, CASE WHEN label = 1 THEN 'x' ELSE 'github' END AS platform, CAST(vec_id // 7 AS VARCHAR) AS profile, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(vec_id % 700 AS INT)) AS seen_at, vec_id % 3 AS round FROM embeddings)"""


@query(f"WITH {_SEEN} SELECT phash, platform, profile, count(*) AS seen_count, epoch_us(min(seen_at)) AS first_seen, epoch_us(max(seen_at)) AS last_seen FROM s GROUP BY ALL")
def src20_avatar_registry(spark, sf_dir):
    """Sightings come in three rounds, each merged into the version before."""
    bits = F.transform(F.slice("embedding", 1, 8), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("vec_id") % 700 * 3600)
    seen = e.select("vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a + x).alias("phash"), F.when(F.col("label") == 1, "x").otherwise("github").alias("platform"), F.floor(F.col("vec_id") / 7).cast("string").alias("profile"), at.alias("seen_at"))
    registry = versions.Versions(spark, tables.shared_folder(spark, "avatars"), versions.REGISTRY)
    for k in range(3):
        versions.register_avatars(registry, seen.where(F.col("vec_id") % 3 == k))
    return registry.read().withColumns({c: F.unix_micros(c) for c in ("first_seen", "last_seen")})

