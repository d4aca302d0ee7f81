"""Registered queries and the SQL that gives the same rows on DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.functions import text as T
from authscope.operators import activity, calibration, graph, monitor, profiles, rules, scaling, similarity
from authscope.sources.views import ctes, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# A few brand names and bio templates of the kind the operators take as lists.
BRANDS = ["google", "apple", "microsoft", "amazon", "facebook", "instagram", "twitter", "youtube", "netflix", "paypal"]
TEMPLATES = ["click link below earn money", "free bitcoin airdrop link in bio", "earn passive income daily dm me"]
MARKED = "raw_proba >= 0.45"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.decided(load(spark, sf_dir, "v_profiles").join(load(spark, sf_dir, "v_scores"), "account_id"))


_SCORED = ctes("v_profiles", "v_scores") + ", scored AS (SELECT p.*, s.raw_proba, s.y, CASE WHEN raw_proba >= 0.45E0 THEN 'Fake' ELSE 'Legit' END AS prediction, round(100 * greatest(raw_proba, 1 - raw_proba), 1) AS confidence FROM v_profiles p JOIN v_scores s USING (account_id))"
_LEAST = "CASE platform WHEN 'linkedin' THEN 65 WHEN 'github' THEN 62 WHEN 'reddit' THEN 58 WHEN 'discord' THEN 65 WHEN 'snapchat' THEN 55 ELSE 60 END"
_THRESHOLD = f"SELECT * REPLACE (CASE WHEN prediction = 'Fake' AND confidence < {_LEAST} THEN 'Legit' ELSE prediction END AS prediction), CASE WHEN prediction = 'Fake' AND confidence < {_LEAST} THEN 'below_threshold' ELSE 'model' END AS reason FROM scored"
_FIGURE = """CASE WHEN is_verified = 1 AND followers >= 1000000 THEN 1 WHEN is_verified = 1 AND followers >= 100000 AND account_age_days >= 730 AND prediction = 'Fake' AND confidence > 60 THEN 2
 WHEN followers >= 10000000 AND posts >= 100 THEN 3 WHEN followers / greatest(following, 1) >= 1000 AND account_age_days >= 1825 AND posts >= 50 AND prediction = 'Fake' THEN 4
 WHEN followers >= 1000000 AND following <= 500 AND account_age_days >= 1095 AND prediction = 'Fake' THEN 5 END"""
_BOT = "CASE WHEN account_age_days <= 7 AND following >= 1000 AND followers <= 50 AND posts = 0 THEN 1 WHEN following >= 5000 AND followers <= 100 AND posts = 0 THEN 2 END"


@query(f"""WITH {_SCORED}, t AS ({_THRESHOLD}), f AS (SELECT *, {_FIGURE} AS fr FROM t),
 g AS (SELECT * REPLACE (CASE WHEN fr IS NULL THEN prediction ELSE 'Legit' END AS prediction, CASE fr WHEN 1 THEN 97 WHEN 2 THEN 92 WHEN 3 THEN 95 WHEN 4 THEN 88 WHEN 5 THEN 90 ELSE confidence END AS confidence) FROM f),
 b AS (SELECT *, CASE WHEN fr IS NULL THEN {_BOT} END AS br FROM g)
 SELECT platform, count(*) AS n, count(*) FILTER (br IS NOT NULL OR prediction = 'Fake') AS n_fake, count(*) FILTER (fr IS NOT NULL) AS n_figures, count(*) FILTER (br IS NOT NULL) AS n_bots,
 round(avg(CASE br WHEN 1 THEN 95 WHEN 2 THEN 93 ELSE confidence END), 3) AS mean_confidence FROM b GROUP BY platform""")
def flagship_segment_decisions(spark, sf_dir):
    """Scores, platform thresholds, safeguards in their order, and counts by platform (MDL11, FLT4, RUL1-3, AGG1)."""
    df = rules.safeguarded(rules.platform_threshold(scored(spark, sf_dir)))
    is_bot = F.col("figure_rule").isNull() & F.col("bot_rule").isNotNull()
    confidence = F.when(is_bot, F.col("c2")).otherwise(F.col("c1"))
    fake = F.when(is_bot, True).otherwise(F.col("p1") == "Fake")
    return df.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count_if(fake).alias("n_fake"), F.count("figure_rule").alias("n_figures"), F.count_if(is_bot).alias("n_bots"), F.round(F.avg(confidence), 3).alias("mean_confidence"))


@query(f"WITH {ctes('v_profiles')} SELECT account_id, coalesce(try_cast(bio AS DOUBLE), 0.0) AS bio_number, coalesce(try_cast(followers AS DOUBLE), 0.0) AS followers FROM v_profiles")
def prj1_number(spark, sf_dir):
    return load(spark, sf_dir, "v_profiles").select("account_id", profiles.number(F.col("bio")).alias("bio_number"), profiles.number(F.col("followers")).alias("followers"))


@query(f"WITH {ctes('v_profiles')} SELECT platform, count(*) AS n, count(label) AS n_labelled, count(*) FILTER (lower(label) = 'fake') AS n_fake FROM v_profiles GROUP BY platform")
def prj3_flt1_labels(spark, sf_dir):
    df = load(spark, sf_dir, "v_profiles").withColumn("y", profiles.binary_label(F.col("label")))
    return df.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("n_labelled"), F.count_if(F.col("y") == 1).alias("n_fake"))


@query(f"WITH {ctes('v_profiles')} SELECT account_id, CAST(posts AS DOUBLE) AS posts, CAST(NULL AS DOUBLE) AS absent, CAST(followers AS DOUBLE) AS followers FROM v_profiles")
def prj7_align(spark, sf_dir):
    return profiles.aligned(load(spark, sf_dir, "v_profiles"), ["posts", "absent", "followers"], ["account_id"])


@query(f"WITH {ctes('v_profiles')} SELECT account_id, followers * 1.0E0 AS followers, length(username) * 0.8E0 AS username_len, coalesce(length(bio), 0) * 0.9E0 AS bio_len FROM v_profiles")
def prj9_group_weights(spark, sf_dir):
    df = load(spark, sf_dir, "v_profiles").select("account_id", F.col("followers").cast("double").alias("followers"), F.length("username").alias("username_len"), F.coalesce(F.length("bio"), F.lit(0)).alias("bio_len"))
    return profiles.weighted(df, ["account_id"])


# The columns of the log step under the names that profiles give them, and one that is only scaled.
_POWER = {"total_views": "avg_views", "snap_score": "score", "total_likes": "likes", "total_stars": "star_received_total"} | {c: c for c in ("followers", "following", "posts", "tweets", "subscribers", "post_karma", "comment_karma", "listed_count", "friends", "videos", "likes", "account_age_days")}


@query(f"""WITH {ctes('v_accounts')}, l AS (SELECT account_id, unnest([{', '.join(f"'{n}'" for n in _POWER)}]) AS feature, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in _POWER.values())}]) AS v FROM v_accounts),
 t AS (SELECT account_id, feature, CASE WHEN feature = 'account_age_days' OR v IS NULL THEN v ELSE ln(1 + greatest(v, 0)) END AS v FROM l), q AS (SELECT feature, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, median(v) AS m FROM t GROUP BY feature)
 SELECT account_id, feature, round(v, 6) AS logged, round(v / CASE iqr WHEN 0 THEN 1 ELSE iqr END, 6) AS scaled, round((v - m) / CASE iqr WHEN 0 THEN 1 ELSE iqr END, 6) AS centred FROM t JOIN q USING (feature)""")
def prj10_prj11_scaling(spark, sf_dir):
    df = load(spark, sf_dir, "v_accounts").select("account_id", *[F.col(c).alias(n) for n, c in _POWER.items()])
    out = scaling.scaled(df, list(_POWER), "account_id")
    return out.select("account_id", "feature", *[F.round(c, 6).alias(c) for c in ("logged", "scaled", "centred")])


@query(f"""WITH {ctes('v_profiles')}, s AS (SELECT *, regexp_replace(lower(username), '[^a-z]', '', 'g') AS letters FROM v_profiles)
 SELECT account_id, length(username) AS uname_length, round(len(regexp_extract_all(username, '[0-9]')) / greatest(length(username), 1), 4) AS uname_digit_ratio, length(regexp_extract(username, '[0-9]+$')) AS uname_digit_suffix,
 CAST(len(regexp_extract_all(username, '[_.\\-]')) AS BIGINT) AS uname_special, round(len(regexp_extract_all(letters, '[aeiou]')) / greatest(length(letters), 1), 4) AS uname_vowel_ratio,
 round((SELECT max(length(x)) FROM (SELECT unnest(string_split_regex(letters, '[aeiou]')) AS x)) / greatest(length(letters), 1), 4) AS uname_consonant_run,
 CAST({" + ".join(f"CAST(regexp_matches(username, '{p if '(?i)' not in p else '(?i)' + p.replace('(?i)', '')}') AS INT)" for p in T.BOT_NAMES)} AS INT) AS uname_bot_hits, CAST(len(regexp_extract_all(username, '[^\\x00-\\x7F]')) AS BIGINT) AS uname_homoglyphs FROM s""")
def str3_str7_username(spark, sf_dir):
    return load(spark, sf_dir, "v_profiles").select("account_id", *[v.alias(k) for k, v in T.username_forensics(F.col("username")).items()])


@query(f"WITH {ctes('v_profiles')} SELECT account_id, CAST(regexp_matches(coalesce(bio, ''), '{T.EMAIL}') AS INT) AS has_email, CAST(regexp_matches(coalesce(bio, ''), '{T.PHONE}') AS INT) AS has_phone, CAST(len(regexp_extract_all(coalesce(bio, ''), '#[A-Za-z0-9_]+')) AS BIGINT) AS hashtags FROM v_profiles")
def str10_str11_contacts(spark, sf_dir):
    b = F.coalesce("bio", F.lit(""))
    return load(spark, sf_dir, "v_profiles").select("account_id", T.flag(b, T.EMAIL).alias("has_email"), T.flag(b, T.PHONE).alias("has_phone"), T.count(b, "#[A-Za-z0-9_]+").alias("hashtags"))


_B = ", ".join(f"({i}, '{b}')" for i, b in enumerate(BRANDS))


@query(f"WITH {ctes('v_profiles')}, b(i, brand) AS (VALUES {_B}), d AS (SELECT account_id, brand, levenshtein(lower(username), brand) AS distance, row_number() OVER (PARTITION BY account_id ORDER BY levenshtein(lower(username), brand), i) AS r FROM v_profiles, b) SELECT account_id, brand, CAST(distance AS INT) AS distance FROM d WHERE r = 1")
def jon3_str15_brand(spark, sf_dir):
    return similarity.closest(load(spark, sf_dir, "v_profiles"), BRANDS)


_TRI = lambda c: f"CASE WHEN length({c}) >= 3 THEN list_distinct([substr({c}, CAST(i AS INT), 3) for i in range(1, length({c}) - 1)]) ELSE [] END"


@query(f"WITH {ctes('v_profiles')}, p AS (SELECT account_id, lower(trim(coalesce(bio, ''))) AS s FROM v_profiles), g AS (SELECT account_id, {_TRI('s')} AS t FROM p), b(x) AS (VALUES {', '.join(repr((t,)).replace(',)', ')') for t in TEMPLATES)}), u AS (SELECT {_TRI('x')} AS v FROM b) SELECT account_id, round(max(len(list_intersect(t, v)) / (len(t) + len(v) - len(list_intersect(t, v)))), 4) AS similarity FROM g, u GROUP BY account_id")
def jon2_str14_templates(spark, sf_dir):
    return similarity.template_similarity(load(spark, sf_dir, "v_profiles"), TEMPLATES)


@query(f"WITH {ctes('v_edges')}, m AS (SELECT e.src, count(*) AS n, count(b.src) AS m FROM v_edges e LEFT JOIN v_edges b ON b.src = e.dst AND b.dst = e.src GROUP BY e.src), f AS (SELECT dst, count(*) AS f FROM v_edges GROUP BY dst) SELECT coalesce(src, dst) AS account_id, coalesce(n, 0) AS n_following, coalesce(f, 0) AS n_followers, round(coalesce(m, 0) / greatest(coalesce(n, 0), 1), 4) AS reciprocity, round(coalesce(m, 0) / (coalesce(n, 0) + coalesce(f, 0) - coalesce(m, 0)), 4) AS mutual_ratio FROM m FULL JOIN f ON src = dst")
def jon6_reciprocity(spark, sf_dir):
    return graph.reciprocity(load(spark, sf_dir, "v_edges"))


@query(f"WITH {ctes('v_edges')}, u AS (SELECT src AS a, dst AS b FROM v_edges UNION SELECT dst, src FROM v_edges), d AS (SELECT a, count(*) AS degree FROM u GROUP BY a), t AS (SELECT x.a, count(*) / 2 AS t FROM u x JOIN u y ON x.a = y.a AND x.b <> y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY x.a) SELECT d.a AS account_id, degree, CAST(coalesce(t, 0) AS BIGINT) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 4) AS coefficient FROM d LEFT JOIN t USING (a)")
def jon9_clustering(spark, sf_dir):
    return graph.clustering(load(spark, sf_dir, "v_edges"))


@query(f"WITH {ctes('v_edges', 'v_scores')}, u AS (SELECT src AS a, dst AS b FROM v_edges UNION SELECT dst, src FROM v_edges) SELECT a AS account_id, round(avg(coalesce(CAST(raw_proba >= 0.45E0 AS INT), 0)), 4) AS share FROM u LEFT JOIN v_scores ON account_id = b GROUP BY a")
def jon5_neighbour_risk(spark, sf_dir):
    flags = load(spark, sf_dir, "v_scores").select("account_id", F.expr(f"cast({MARKED} as int)").alias("flag"))
    return graph.neighbour_share(load(spark, sf_dir, "v_edges"), flags)


@query(f"WITH {_SCORED}, b AS (SELECT account_id, CASE WHEN (account_id * 31) % 100 >= 55 THEN 'Fake' ELSE 'Legit' END AS prediction FROM v_profiles) SELECT count(*) AS n, round(100 * avg(CAST(a.prediction = b.prediction AS INT)), 2) AS agreement FROM scored a JOIN b USING (account_id)")
def jon19_ab(spark, sf_dir):
    other = load(spark, sf_dir, "v_profiles").select("account_id", F.when((F.col("account_id") * 31) % 100 >= 55, "Fake").otherwise("Legit").alias("prediction"))
    return monitor.agreement(scored(spark, sf_dir), other, "account_id")


@query(f"WITH {_SCORED}, t AS ({_THRESHOLD}) SELECT account_id, platform, reason, CASE WHEN confidence < 70 THEN 'Uncertain' ELSE prediction END AS prediction, confidence, CASE WHEN confidence >= 90 THEN 'very high' WHEN confidence >= 80 THEN 'high' WHEN confidence >= 65 THEN 'medium' WHEN confidence >= 50 THEN 'low' ELSE 'very low' END AS band FROM t")
def flt3_flt4_rul4_thresholds(spark, sf_dir):
    df = rules.user_threshold(rules.platform_threshold(scored(spark, sf_dir)), 70.0)
    return df.select("account_id", "platform", "reason", "prediction", "confidence", rules.band(F.col("confidence")).alias("band"))


@query(f"WITH {_SCORED} SELECT account_id, {_FIGURE} AS figure_rule, {_BOT} AS bot_rule FROM scored")
def rul1_rul2_safeguards(spark, sf_dir):
    return rules.safeguarded(scored(spark, sf_dir)).select("account_id", "figure_rule", "bot_rule")


@query(f"""WITH {ctes('v_scores')}, s AS (SELECT account_id, 50 + account_id % 50 AS s1, 40 + (account_id * 7) % 60 AS s2, (account_id % 10) / 10 AS c1, ((account_id * 3) % 10) / 10 AS c2 FROM v_scores), m AS (SELECT *, CASE WHEN s1 - s2 > 15 THEN 'stage1_fallback' WHEN c2 < 0.7E0 * c1 THEN 'stage1_preferred' WHEN s2 >= s1 THEN 'stage2_dominant' ELSE 'weighted_merge' END AS source FROM s)
 SELECT account_id, source, CAST(CASE WHEN source LIKE 'stage1%' THEN s1 WHEN source = 'stage2_dominant' THEN s2 ELSE round((s1 * c1 + s2 * c2) / greatest(c1 + c2, 1e-9), 1) END AS DOUBLE) AS confidence FROM m""")
def rul5_stage_merge(spark, sf_dir):
    a = F.col("account_id")
    df = load(spark, sf_dir, "v_scores").select("account_id", (50 + a % 50).alias("s1"), (40 + (a * 7) % 60).alias("s2"), ((a % 10) / 10).alias("c1"), (((a * 3) % 10) / 10).alias("c2"))
    return rules.merged(df).select("account_id", "source", F.col("confidence").cast("double").alias("confidence"))


@query(f"WITH {ctes('v_scores')}, c AS (SELECT CAST(raw_proba >= 0.45E0 AS INT) AS p, y FROM v_scores), n AS (SELECT count(*) FILTER (p = 1 AND y = 1) AS tp, count(*) FILTER (p = 1 AND y = 0) AS fp, count(*) FILTER (p = 0 AND y = 1) AS fn, count(*) FILTER (p = 0 AND y = 0) AS tn FROM c) SELECT *, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM n")
def agg3_accuracy(spark, sf_dir):
    return monitor.confusion(load(spark, sf_dir, "v_scores").select("y", F.expr(f"cast({MARKED} as int)").alias("pred")))


@query(f"WITH {ctes('v_profiles')}, l AS (SELECT unnest(['followers', 'following', 'posts']) AS feature, unnest([followers, following, posts]) AS v FROM v_profiles) SELECT feature, count(v) AS n, round(100 * avg(CAST(v IS NULL AS INT)), 2) AS missing_pct, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, min(v) AS min, max(v) AS max, round(median(v), 3) AS median FROM l GROUP BY feature")
def agg6_agg9_statistics(spark, sf_dir):
    return monitor.statistics(load(spark, sf_dir, "v_profiles").select("followers", "following", "posts"), ["followers", "following", "posts"])


_PSI = f"""WITH {ctes('v_drift')}, l AS (SELECT side, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS feature, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM v_drift), e AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM l GROUP BY feature),
 c AS (SELECT feature, least(CAST(floor((v - lo) / (hi - lo) * 10) AS BIGINT), 9) AS b, count(*) FILTER (side = 'train') AS e, count(*) FILTER (side = 'recent') AS a FROM l JOIN e USING (feature) GROUP BY ALL),
 r AS (SELECT feature, e / sum(e) OVER (PARTITION BY feature) AS e, a / sum(a) OVER (PARTITION BY feature) AS a FROM c), p AS (SELECT feature, greatest(round(sum((a - e) * ln((a + 1e-9) / (e + 1e-9))), 6), 0) AS psi FROM r GROUP BY feature)
 SELECT feature, psi, CASE WHEN psi < 0.1 THEN 'ok' WHEN psi < 0.2 THEN 'warn' ELSE 'alert' END AS level FROM p"""


@query(_PSI)
def agg13_agg15_psi(spark, sf_dir):
    return monitor.drift_level(monitor.psi(load(spark, sf_dir, "v_drift"), "side", ["l_quantity", "l_extendedprice", "l_discount"]))


@query(f"WITH {_SCORED} SELECT platform, count(*) AS n, round(avg(confidence), 4) AS mean, round(median(confidence), 4) AS median, count(*) FILTER (confidence < 60) AS low, round(100 * avg(CAST(confidence < 60 AS INT)), 2) AS low_pct FROM scored GROUP BY platform")
def agg12_confidence(spark, sf_dir):
    return monitor.confidence_spread(scored(spark, sf_dir), "platform")


@query(f"WITH {ctes('v_scores')} SELECT round(avg(pow(raw_proba - y, 2)), 6) AS brier FROM v_scores")
def agg36_brier(spark, sf_dir):
    return calibration.brier(load(spark, sf_dir, "v_scores"))


@query(f"WITH {ctes('v_scores')}, p AS (SELECT least(greatest(raw_proba, 1e-6), 1 - 1e-6) AS p, y FROM v_scores), g AS (SELECT i / 10 AS temperature FROM range(3, 30) t(i)) SELECT temperature, round(avg(pow(1 / (1 + exp(-ln(p / (1 - p)) / temperature)) - y, 2)), 6) AS brier FROM p, g GROUP BY temperature")
def mdl12_temperature(spark, sf_dir):
    return calibration.temperature(load(spark, sf_dir, "v_scores"))


@query(f"WITH {ctes('v_scores')} SELECT account_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY account_id) - 1) % 5 AS INT) AS fold FROM v_scores")
def mdl3_folds(spark, sf_dir):
    return calibration.folds(load(spark, sf_dir, "v_scores"), 5).select("account_id", "y", "fold")


@query(f"WITH {ctes('v_scores')}, c AS (SELECT y, count(*) AS n FROM v_scores GROUP BY y) SELECT y, n, round(sum(n) OVER () / (2 * n), 6) AS weight FROM c")
def mdl9_class_weights(spark, sf_dir):
    return calibration.class_weights(load(spark, sf_dir, "v_scores"))


_GAPS = ctes("v_activity") + ", g AS (SELECT account_id, (epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY account_id ORDER BY ts, event_id)) / 3600 AS gap FROM v_activity)"


@query(f"WITH {_GAPS} SELECT account_id, count(gap) AS n_gaps, round(avg(gap), 4) AS gap_mean, round(coalesce(stddev_samp(gap), 0), 4) AS gap_std, count(*) FILTER (gap * 3600 < 60) AS under_minute, round(1 / (1 + stddev_pop(gap)), 4) AS regularity, round(max(gap) / 24, 4) AS gap_max_days, round(var_pop(gap), 3) AS gap_variance FROM g WHERE gap IS NOT NULL GROUP BY account_id")
def win1_win3_win6_win7_gaps(spark, sf_dir):
    return activity.gap_statistics(load(spark, sf_dir, "v_activity"))


@query(f"WITH {_GAPS}, b AS (SELECT account_id, CASE WHEN gap < 1 / 60 THEN 0 WHEN gap < 5 / 60 THEN 1 WHEN gap < 0.5 THEN 2 WHEN gap < 2 THEN 3 WHEN gap < 6 THEN 4 WHEN gap < 24 THEN 5 WHEN gap < 72 THEN 6 WHEN gap < 168 THEN 7 ELSE 8 END AS b, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL), p AS (SELECT account_id, n / sum(n) OVER (PARTITION BY account_id) AS p FROM b) SELECT account_id, round(-sum(p * log2(p)), 4) AS gap_entropy, round(sum(p * p), 4) AS gap_hhi FROM p GROUP BY account_id")
def win2_agg16_agg17_entropy(spark, sf_dir):
    return activity.gap_entropy(load(spark, sf_dir, "v_activity"))


@query(f"WITH {ctes('v_activity')}, c AS (SELECT account_id, hour(ts) AS h, count(*) AS n, count(*) FILTER (isodow(ts) >= 6) AS w FROM v_activity GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY account_id) AS p FROM c) SELECT account_id, round(-sum(p * ln(p + 1e-9)) / ln(24), 4) AS hour_entropy, count(*) AS active_hours, round(sum(w) / greatest(sum(n) - sum(w), 1), 4) AS weekend_ratio, round(sum(CASE WHEN h <= 5 THEN n ELSE 0 END) / sum(n), 4) AS night_share FROM p GROUP BY account_id")
def agg25_rhythm(spark, sf_dir):
    return activity.daily_rhythm(load(spark, sf_dir, "v_activity"))


@query(f"WITH {ctes('v_activity')}, t AS (SELECT account_id, epoch_us(ts) AS t FROM v_activity), s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY account_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING) >= 5 THEN t END AS st FROM t), i AS (SELECT account_id, max(st) OVER (PARTITION BY account_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) IS NOT NULL AS b FROM s) SELECT account_id, round(avg(CAST(b AS INT)), 4) AS burst_share FROM i GROUP BY account_id")
def win5_bursts(spark, sf_dir):
    return activity.burst_share(load(spark, sf_dir, "v_activity"), 86_400, 5)


@query(f"WITH {ctes('v_guild')}, n AS (SELECT event_id, guild_id, count(*) OVER (PARTITION BY guild_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS n FROM v_guild WHERE kind = 'join') SELECT * FROM n WHERE n >= 5")
def win11_stm1_join_bursts(spark, sf_dir):
    """Batch twin of the join-burst stream."""
    return activity.trailing(load(spark, sf_dir, "v_guild").where("kind = 'join'"), ["guild_id"], 21_600, 5).select("event_id", "guild_id", "n")


@query(f"WITH {ctes('v_guild')}, n AS (SELECT event_id, guild_id, user_id, count(*) OVER (PARTITION BY guild_id, user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM v_guild WHERE kind = 'message') SELECT * FROM n WHERE n >= 3")
def win12_message_bursts(spark, sf_dir):
    return activity.trailing(load(spark, sf_dir, "v_guild").where("kind = 'message'"), ["guild_id", "user_id"], 86_400, 3).select("event_id", "guild_id", "user_id", "n")


@query(f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY confidence DESC, account_id) AS r FROM scored) SELECT account_id, platform, confidence FROM r WHERE r <= 10")
def win10_top_rows(spark, sf_dir):
    return monitor.last(scored(spark, sf_dir), "platform", [F.desc("confidence"), F.col("account_id")], 10).select("account_id", "platform", "confidence")


@query(f"WITH {ctes('v_posts')}, t AS (SELECT account_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM v_posts) SELECT account_id, count(*) AS tokens, count(DISTINCT w) AS types, round(count(DISTINCT w) / count(*), 4) AS ratio FROM t GROUP BY account_id")
def agg18_type_token(spark, sf_dir):
    t = load(spark, sf_dir, "v_posts").select("account_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return t.groupBy("account_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("w").alias("types"), F.round(F.count_distinct("w") / F.count(F.lit(1)), 4).alias("ratio"))


@query(f"WITH {ctes('v_posts')}, k AS (SELECT account_id, lower(trim(text)) AS k, count(*) AS n FROM v_posts GROUP BY ALL) SELECT account_id, count(*) FILTER (n > 1) AS repeated, CAST(sum(n) AS BIGINT) AS posts, round(count(*) FILTER (n > 1) / sum(n), 4) AS duplicate_ratio FROM k GROUP BY account_id")
def set5_agg24_duplicates(spark, sf_dir):
    k = load(spark, sf_dir, "v_posts").groupBy("account_id", F.lower(F.trim("text")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return k.groupBy("account_id").agg(F.count_if(F.col("n") > 1).alias("repeated"), F.sum("n").alias("posts"), F.round(F.count_if(F.col("n") > 1) / F.sum("n"), 4).alias("duplicate_ratio"))

from authscope.plans import builders, files, modelling, network, preparing, remaining, reporting, texts  # noqa: E402, F401  these register their queries here

texts._late()
