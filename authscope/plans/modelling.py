"""Registered queries of the language, rule, source, model and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from authscope.operators import language, rules, training
from authscope.plans.registry import _BOT, _FIGURE, _SCORED, query, scored
from authscope.sources import tables
from authscope.sources.tables import shared_folder
from authscope.sources.views import ctes, load
from authscope.streaming import guild, sessions

_HITS = " + ".join(f"{k} * CAST(contains(lower(b), '{w}') AS INT)" for k, ws in language.SPAM_WORDS.items() for w in ws)
_S = "(SELECT regexp_replace(regexp_replace(regexp_replace(lower(username), '[^a-z]', '', 'g'), '[aeiou]', '1', 'g'), '[a-z]', '0', 'g'))"


@query(f"""WITH {ctes('v_profiles')}, s AS (SELECT account_id, coalesce(bio, '') AS b, {_S} AS v FROM v_profiles)
 SELECT account_id, round(({_HITS}) / greatest(len(regexp_extract_all(b, '\\S+')), 1), 4) AS spam_score, CAST(len(regexp_extract_all(b, '{language.INVISIBLE}')) AS BIGINT) AS invisible,
 round(len(regexp_extract_all(b, '\\p{{Lu}}')) / greatest(len(regexp_extract_all(b, '\\p{{L}}')), 1), 4) AS caps_ratio,
 CASE WHEN length(v) < 2 THEN 0.5E0 ELSE round(len([i for i in range(1, length(v)) if substr(v, CAST(i AS INT), 1) <> substr(v, CAST(i AS INT) + 1, 1)]) / (length(v) - 1), 4) END AS pronounceable FROM s""")
def str4_str8_str9_str12_wording(spark, sf_dir):
    return language.bio_record(load(spark, sf_dir, "v_profiles"))


@query(f"WITH {ctes('v_posts')} SELECT account_id, count(*) AS posts, count(*) FILTER (regexp_matches(lower(trim(text)), '{language.REPOST}')) AS reposts FROM v_posts GROUP BY account_id")
def str20_reposts(spark, sf_dir):
    return language.reposts(load(spark, sf_dir, "v_posts"))


@query(f"WITH {ctes('v_profiles')}, w AS (SELECT DISTINCT lower(c_mktsegment) AS word FROM customer), p AS (SELECT account_id, [x for x in string_split_regex(lower(username), '[0-9_.\\-]+') if length(x) >= 2] AS parts FROM v_profiles), a AS (SELECT list(word) AS ws FROM w) SELECT account_id, round(len([x for x in parts if list_contains(ws, x)]) / greatest(len(parts), 1), 4) AS coverage FROM p, a")
def jon4_dictionary(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lower("c_mktsegment").alias("word"))
    return language.dictionary_coverage(load(spark, sf_dir, "v_profiles"), words)


_T = lambda col, src, side: f"SELECT account_id, t, count(*) AS {side} FROM (SELECT account_id, unnest(regexp_extract_all(lower({col}), '[a-z0-9_]{{2,}}')) AS t FROM {src}) GROUP BY ALL"


@query(f"WITH {ctes('v_profiles', 'v_posts')}, l AS ({_T('bio', 'v_profiles', 'x')}), r AS ({_T('text', 'v_posts', 'y')}), c AS (SELECT account_id, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM l FULL JOIN r USING (account_id, t)), v AS (SELECT account_id, x * i AS x, y * i AS y FROM (SELECT *, ln(3 / (1 + CAST(x > 0 AS INT) + CAST(y > 0 AS INT))) + 1 AS i FROM c)) SELECT account_id, round(CASE WHEN sum(x * x) * sum(y * y) = 0 THEN 0 ELSE sum(x * y) / sqrt(sum(x * x) * sum(y * y)) END, 4) AS similarity FROM v GROUP BY account_id")
def jon14_topic_similarity(spark, sf_dir):
    return language.topic_similarity(load(spark, sf_dir, "v_profiles").select("account_id", F.col("bio").alias("text")), load(spark, sf_dir, "v_posts"))


@query(f"WITH {_SCORED}, f AS (SELECT *, {_FIGURE} AS fr, {_BOT} AS br, account_id % 40 = 0 AS l FROM scored) SELECT account_id, platform, CASE WHEN l OR fr IS NOT NULL THEN 'Legit' WHEN br IS NOT NULL THEN 'Fake' ELSE prediction END AS prediction, CAST(CASE WHEN l THEN 99 WHEN fr IS NOT NULL THEN CASE fr WHEN 1 THEN 97 WHEN 2 THEN 92 WHEN 3 THEN 95 WHEN 4 THEN 88 ELSE 90 END WHEN br IS NOT NULL THEN CASE br WHEN 1 THEN 95 ELSE 93 END ELSE confidence END AS DOUBLE) AS confidence, CASE WHEN l THEN 'allow_list' WHEN fr IS NOT NULL THEN 'public_figure' WHEN br IS NOT NULL THEN 'bot' ELSE 'model' END AS source FROM f")
def rul3_precedence(spark, sf_dir):
    return rules.precedence(scored(spark, sf_dir).withColumn("listed", (F.col("account_id") % 40 == 0).cast("int")))


_OK = ["account_age_days > 365", "is_verified = 1", "followers / greatest(following, 1) > 0.05E0 AND followers / greatest(following, 1) < 20"]
_AGREE = " + ".join(f"CAST(({x}) = (prediction = 'Legit') AS INT)" for x in _OK)


@query(f"WITH {_SCORED}, a AS (SELECT account_id, prediction = 'Legit' AS l, confidence AS c, ({_AGREE}) / 3 AS s FROM scored), p AS (SELECT *, CASE WHEN s >= 0.8 THEN (CASE WHEN l THEN 85 ELSE 88 END - c) * 0.45E0 WHEN s >= 0.65 THEN (CASE WHEN l THEN 75 ELSE 78 END - c) * 0.25E0 ELSE 0 END AS pull FROM a) SELECT account_id, round(round(least(c + greatest(-5, least(pull, 12)), 95), 6), 1) AS shown FROM p")
def rul7_adjusted(spark, sf_dir):
    ff = F.col("followers") / F.greatest("following", F.lit(1))
    signals = {"account_age_days": F.col("account_age_days") > 365, "is_verified": F.col("is_verified") == 1, "followers": (ff > 0.05) & (ff < 20)}
    return rules.adjusted(scored(spark, sf_dir), signals).select("account_id", "shown")


@query(f"WITH {ctes('v_profiles')}, m AS (SELECT followers, following, posts, 2 * posts + following % 2 AS volume FROM v_profiles), r AS (SELECT 'following' AS f, abs(corr(followers, following)) AS r FROM m UNION ALL SELECT 'posts', greatest(abs(corr(followers, posts)), abs(corr(following, posts))) FROM m UNION ALL SELECT 'volume', greatest(abs(corr(followers, volume)), abs(corr(following, volume)), abs(corr(posts, volume))) FROM m) SELECT f AS feature FROM r WHERE r > 0.95")
def mdl5_correlation_filter(spark, sf_dir):
    df = load(spark, sf_dir, "v_profiles").withColumn("volume", 2 * F.col("posts") + F.col("following") % 2)
    return training.redundant(df, ["followers", "following", "posts", "volume"])


FEATURES = ["followers", "following", "posts", "account_age_days", "is_verified"]


def _examples(spark, sf_dir):
    return load(spark, sf_dir, "v_profiles").select("account_id", "platform", *FEATURES).join(load(spark, sf_dir, "v_scores").select("account_id", "y"), "account_id")


@query()
def mdl1_mdl11_vote(spark, sf_dir):
    """Trains on four folds of five by account and scores all rows: (account_id, y, held_out, prediction, confidence)."""
    rows = tables.settled(_examples(spark, sf_dir).withColumn("held_out", F.pmod(F.xxhash64("account_id"), F.lit(5)) == 0))  # read by the fit and by the scores
    model = training.fit(rows.where("not held_out"), FEATURES)
    return rules.decided(training.scored(model, rows, FEATURES)).select("account_id", "y", "held_out", "prediction", "confidence")


@query()
def mdl6_mdl17_importances(spark, sf_dir):
    return training.importances(training.fit(_examples(spark, sf_dir), FEATURES, votes=(0,)), FEATURES, spark)


@query()
def mdl13_mdl14_calibrators(spark, sf_dir):
    return training.calibrators(load(spark, sf_dir, "v_scores"))


@query(f"WITH {ctes('v_profiles')} SELECT account_id, username, CAST(followers AS BIGINT) AS followers, CAST(NULL AS STRING) AS bio FROM v_profiles WHERE platform = 'x' UNION ALL SELECT account_id, username, NULL, bio FROM v_profiles WHERE platform = 'github'")
def src2_src4_union(spark, sf_dir):
    p = load(spark, sf_dir, "v_profiles")
    a = p.where("platform = 'x'").select(F.col("account_id").alias(" Account_ID"), F.col("username").alias("Username "), F.col("followers").cast("long").alias("FOLLOWERS"))
    return tables.union(tables.normal_headers(a), p.where("platform = 'github'").select("account_id", "username", "bio"))


@query(f"WITH {ctes('v_profiles')} SELECT account_id, username, CAST(followers AS BIGINT) AS followers FROM v_profiles")
def src3_json_profiles(spark, sf_dir):
    p = load(spark, sf_dir, "v_profiles")
    sent = p.select(F.to_json(F.struct(F.array(F.struct("account_id", "username", "followers")).alias("profiles"))).alias("body"))
    return tables.profiles_of(sent, "body", "account_id: bigint, username: string, followers: bigint")


# Spans of the streams are wide, as the events are sparse; ids are answered once the watermark, ten minutes behind the newest row, has passed them.
_GUILD = "g AS (SELECT event_id, CAST(floor(user_id / 10) AS BIGINT) AS guild_id, user_id, ts, event_type FROM events)"
_TRAILING = f"{_GUILD}, b AS (SELECT event_id, guild_id, user_id, ts, count(*) OVER (PARTITION BY guild_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS n FROM g WHERE event_type = 'signup')"
_SESSIONS = """m AS (SELECT event_id, guild_id, user_id, ts, count(*) OVER (PARTITION BY guild_id, user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM g WHERE event_type IN ('click', 'view')),
h AS (SELECT m.*, j.event_id AS join_id, row_number() OVER (PARTITION BY j.event_id ORDER BY m.ts, m.event_id) AS r FROM m ASOF JOIN (SELECT * FROM g WHERE event_type = 'signup') j ON m.guild_id = j.guild_id AND m.user_id = j.user_id AND m.ts >= j.ts WHERE m.ts <= j.ts + INTERVAL 2 DAYS AND m.n >= 3),
e AS (SELECT max(ts) - INTERVAL 10 MINUTES AS seen FROM g WHERE event_type IN ('signup', 'click', 'view')), t AS (SELECT event_id, join_id, guild_id, user_id, ts, n FROM h, e WHERE r = 1 AND ts <= seen)"""


def join_burst_stream(spark, sf_dir):
    return sessions.trailing_counts(guild.events(spark, sf_dir).where("event_type = 'signup'"), ["guild_id"], 21_600)


def message_burst_stream(spark, sf_dir):
    rows = guild.events(spark, sf_dir).where("event_type in ('signup', 'click', 'view')")
    return sessions.message_bursts(rows, ["guild_id", "user_id"], 86_400, 3, 172_800, F.col("event_type") != "signup")


@query(f"WITH {_TRAILING} SELECT event_id, guild_id, n FROM b WHERE n >= 5 AND ts <= (SELECT max(ts) FROM b) - INTERVAL 10 MINUTES")
def stm1_stm4_join_bursts(spark, sf_dir):
    """A stream: each join that has five or more of its guild in the six hours up to it; win11 is its batch twin."""
    return guild.drained(join_burst_stream(spark, sf_dir)).where("n >= 5").select("event_id", "guild_id", "n")


@query(f"WITH {_GUILD}, {_SESSIONS} SELECT event_id, join_id, guild_id, user_id, n FROM t")
def stm2_message_bursts(spark, sf_dir):
    """A stream: of each join, the first message within two days of it that is the third or later of its day."""
    return guild.drained(message_burst_stream(spark, sf_dir)).select("event_id", "join_id", "guild_id", "user_id", "n")


_AVATAR = "CAST(coalesce(x.embedding[{}] > -0.1, true) AS INT)"
_ACCOUNTS = "SELECT c_custkey AS user_id, TIMESTAMP '2024-01-30 00:00:00' - {} AS created_at, {} AS has_avatar FROM customer LEFT JOIN embeddings x ON x.vec_id = c_custkey"
_ON = ["(epoch_us(ts) - epoch_us(created_at)) / 86400e6 < 7", "coalesce(has_avatar, 1) = 0", "joins >= 5", "is_message = 1"]
_NAMES = ["new_account<7d", "no_custom_avatar", "join_burst>5/120s", "message_burst>8/60s"]
_SUM = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in zip(_ON, (40, 15, 25, 30)))


def accounts(spark, sf_dir):
    for t in ("customer", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(_ACCOUNTS.format("make_dt_interval(CAST(floor(abs(c_acctbal)) AS INT) % 60)", _AVATAR.format(0)))


@query(f"""WITH {_TRAILING}, {_SESSIONS}, a AS ({_ACCOUNTS.format("to_days(CAST(floor(abs(c_acctbal)) AS INT) % 60)", _AVATAR.format(1))}),
r AS (SELECT event_id, guild_id, user_id, ts, n AS joins, 0 AS is_message FROM b WHERE ts <= (SELECT max(ts) FROM b) - INTERVAL 10 MINUTES
UNION ALL SELECT t.event_id, t.guild_id, t.user_id, t.ts, (SELECT count(*) FROM b WHERE b.guild_id = t.guild_id AND b.ts <= t.ts AND epoch_us(b.ts) >= epoch_us(t.ts) - 21600000000), 1 FROM t WHERE t.ts <= (SELECT max(ts) FROM t) - INTERVAL 10 MINUTES AND t.ts <= (SELECT max(ts) FROM b) - INTERVAL 10 MINUTES)
SELECT event_id, guild_id, r.user_id, CASE is_message WHEN 1 THEN 'message' ELSE 'join' END AS kind, CAST({_SUM} AS INT) AS suspicion, concat_ws('|', {', '.join(f'CASE WHEN {c} THEN {n!r} END' for c, n in zip(_ON, _NAMES))}) AS reasons, CAST(is_message = 0 AND {_SUM} >= 70 AS INT) AS act
FROM r LEFT JOIN a USING (user_id) WHERE is_message = 1 OR ts <= (SELECT max(ts) FROM t) - INTERVAL 10 MINUTES""")
def stm3_rul9_suspicion(spark, sf_dir):
    """A stream of joins and of the message bursts that another stream has found: both are counted against the guild's joins and scored.

    The watermark is the lesser of the two sources'.
    """
    folder = shared_folder(spark, "bursts")
    found = guild.drained(message_burst_stream(spark, sf_dir), folder)
    joins = guild.events(spark, sf_dir).where("event_type = 'signup'").select("event_id", "guild_id", "user_id", "ts", F.lit(0).cast("long").alias("is_message")).withWatermark("ts", guild.DELAY)
    bursts = spark.readStream.schema(found.schema).parquet(f"{folder}/rows").select("event_id", "guild_id", "user_id", "ts", F.lit(1).cast("long").alias("is_message")).withWatermark("ts", guild.DELAY)
    counted = sessions.trailing_counts(joins.unionByName(bursts), ["guild_id"], 21_600, F.col("is_message") == 0, also=("user_id", "is_message"), delay=None)
    flags = counted.withColumns({"join_burst": (F.col("n") >= 5).cast("int"), "message_burst": F.col("is_message").cast("int")})
    return guild.drained(guild.scored(flags, accounts(spark, sf_dir)))


@query("SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES GROUP BY ALL")
def stm5_hourly_counts(spark, sf_dir):
    return guild.drained(guild.counts(guild.events(spark, sf_dir), ["event_type"], "1 hour"))
