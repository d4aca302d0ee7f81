"""Adapters from the base tables to the tables the operators take. The SQL runs alike on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLATFORMS = ["instagram", "facebook", "x", "linkedin", "github", "discord", "youtube", "tiktok", "reddit", "snapchat"]

_platform = "CASE c.c_custkey % 10 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PLATFORMS)) + " END"

VIEWS = {
    "v_profiles": f"""
SELECT c.c_custkey AS account_id, {_platform} AS platform,
 CASE c.c_custkey % 4 WHEN 0 THEN concat('user', CAST(1000000 + c.c_custkey AS STRING))
  WHEN 1 THEN replace(lower(c.c_name), '#', '_') WHEN 2 THEN concat(lower(c.c_mktsegment), '.', CAST(c.c_custkey AS STRING))
  ELSE concat('googIe', CAST(c.c_custkey % 9 AS STRING)) END AS username,
 CASE WHEN c.c_custkey % 9 = 1 THEN CAST(floor(abs(c.c_acctbal)) AS BIGINT) % 60
  ELSE CAST(floor(abs(c.c_acctbal)) AS BIGINT) * (CASE WHEN c.c_custkey % 50 = 0 THEN 5000 WHEN c.c_custkey % 7 = 0 THEN 100 ELSE 1 END) END AS followers,
 (c.c_custkey * 37) % 7500 AS following,
 CASE WHEN c.c_custkey % 18 = 10 THEN 0 ELSE coalesce(o.n_orders, 0) * 10 END AS posts,
 CASE WHEN c.c_custkey % 25 = 0 THEN 1 ELSE 0 END AS is_verified, (c.c_custkey * 13) % 4000 AS account_age_days,
 d.text AS bio, CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 0 THEN 'fake' ELSE 'Legit' END AS label
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
LEFT JOIN documents d ON d.doc_id = c.c_custkey LEFT JOIN labels l ON l.doc_id = c.c_custkey""",
    "v_posts": "SELECT doc_id AS post_id, CAST(floor(doc_id / 4) AS BIGINT) AS account_id, lang, text FROM documents",
    "v_activity": "SELECT event_id, user_id AS account_id, ts, event_type AS kind, CAST(floor(value) AS BIGINT) AS engagement FROM events",
    "v_edges": "SELECT DISTINCT o.o_custkey AS src, l.l_suppkey AS dst FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey <> l.l_suppkey",
    "v_scores": "SELECT c_custkey AS account_id, ((c_custkey * 7919) % 1000) / 1000.0E0 AS raw_proba, CASE WHEN (c_custkey * 7919) % 1000 + (c_custkey % 11) * 40 > 600 THEN 1 ELSE 0 END AS y FROM customer",
    "v_drift": "SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'train' ELSE 'recent' END AS side, l_quantity, l_extendedprice, l_discount FROM lineitem",
    "v_guild": "SELECT event_id, CAST(floor(user_id / 10) AS BIGINT) AS guild_id, user_id, ts, CASE WHEN event_type = 'signup' THEN 'join' ELSE 'message' END AS kind FROM events WHERE event_type IN ('signup', 'click', 'view')",
}
VIEWS["v_accounts"] = f"""
SELECT p.*, CASE p.account_id % 4 WHEN 0 THEN upper(p.username) WHEN 1 THEN concat(p.username, ' ', p.platform) WHEN 2 THEN 'Jan  de Vries 42' END AS name, p.username AS channel_name, p.bio AS about,
 CASE p.account_id % 3 WHEN 0 THEN concat('Engineer | ', p.username, ' @ Corp') WHEN 1 THEN 'earn money daily, airdrop expert' END AS headline,
 (p.account_id * 53) % 5000 AS friends, CASE WHEN p.account_id % 8 = 3 THEN NULL ELSE p.posts * 3 END AS tweets, p.posts * 2 AS statuses_count, (p.account_id * 17) % 900 AS listed_count,
 CASE WHEN p.account_id % 6 = 0 THEN 1 ELSE 0 END AS default_profile_image, CASE WHEN p.account_id % 7 = 0 THEN NULL WHEN p.account_id % 5 = 0 THEN 0 ELSE 1 END AS profile_pic,
 (p.account_id * 29) % 800 AS connections, (p.account_id * 3) % 200 AS endorsements, CASE WHEN p.account_id % 9 = 2 THEN NULL ELSE (p.account_id * 11) % 60 END AS public_repos, (p.account_id * 11) % 50 AS repos,
 (p.account_id * 5) % 7 AS public_gists, (p.account_id * 31) % 1000 AS star_received_total, (p.account_id % 10) / 10.0E0 AS fork_ratio, (p.account_id % 4) / 4.0E0 AS readme_presence_ratio,
 p.account_id % 9 AS unique_languages, (p.account_id % 8) / 8.0E0 AS repo_diversity_score, CASE WHEN p.account_id % 13 = 0 THEN NULL ELSE (p.account_id * 7) % 700 END AS activity_recency, (p.account_id % 23) / 4.0E0 AS commit_regularity,
 d.created AS created_at_utc, d.joined AS joined_at_utc, CASE WHEN p.account_id % 4 = 1 THEN 0 ELSE 1 END AS has_avatar, (p.account_id % 111) / 100.0E0 AS suspicion_score,
 p.followers AS subscribers, CASE WHEN p.account_id % 5 = 1 THEN NULL ELSE p.posts * 2 + p.account_id % 3 END AS videos, (p.account_id * 97) % 100000 AS avg_views, (p.account_id * 89) % 1000000 AS likes,
 (p.account_id * 19) % 3000 AS comment_karma, (p.account_id * 23) % 2000 AS post_karma, (p.account_id * 41) % 4000 AS karma, (p.account_id * 101) % 200000 AS score, (p.account_id * 7) % 500 AS friends_count, p.account_id % 6 AS streaks
FROM ({VIEWS["v_profiles"]}) p LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created, max(o_orderdate) AS joined FROM orders GROUP BY o_custkey) d ON d.o_custkey = p.account_id"""
#: Base tables of each view.
NEEDS = {"v_profiles": ("customer", "orders", "documents", "labels"), "v_accounts": ("customer", "orders", "documents", "labels"), "v_posts": ("documents",), "v_activity": ("events",), "v_edges": ("orders", "lineitem"), "v_scores": ("customer",), "v_drift": ("lineitem",), "v_guild": ("events",)}


#: Rows of a part of the orders' lines.
PART = 500_000


def edges(spark: SparkSession) -> DataFrame:
    """v_edges with its join and its copies dealt to parts of about ``PART`` lines, so what a task sorts and holds doesn't grow with the tables."""
    orders, lines = spark.table("orders").select("o_orderkey", "o_custkey"), spark.table("lineitem").select("l_orderkey", "l_suppkey")
    parts = 1 + lines.count() // PART  # as the files tell
    met = orders.repartition(parts, "o_orderkey").join(lines.repartition(parts, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return met.where("o_custkey <> l_suppkey").select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).repartition(parts, "src").distinct()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the base tables; only the columns and rows that a query needs are read."""
    for t in NEEDS[name]:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        df = df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"})
        df.createOrReplaceTempView(t)
    return edges(spark) if name == "v_edges" else spark.sql(VIEWS[name])


def ctes(*names: str) -> str:
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
