"""Feature builders of ten platforms: one projection each, from raw account columns to numeric features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.functions import text as T
from authscope.operators.profiles import number, over, scale_features

# The features of each platform and how they are made.
#   ("num", name, column, default)  a number; several columns: the first that is there and not NULL
#   ("ratio", name, a, b)  a / b, 0 as divisor counts as 1;  ("log", name, a)  ln(1 + a)
#   ("tier", name, a, tops)  0, 1, ... by inclusive upper ends; NULL up to -1
#   ("star", name, a, least)  verified and a > least;  ("is", name, a, operator, value)  0 or 1
#   ("text", name, column, kind)  of a text, NULL as empty
FOLLOWER_TOPS = (999, 99_999, 999_999)


def texts(column: str, prefix: str, *kinds: str) -> list[tuple]:
    return [("text", f"{prefix}_{k}", column, k) for k in kinds]


NAME_KINDS = ("len", "digit_count", "underscore", "pure_numeric")
ABOUT_KINDS = ("len", "word_count", "has_url", "has_crypto", "has_spam", "is_empty")
FULL_BIO_KINDS = ("len", "word_count", "has_url", "has_crypto", "has_at", "emoji_count", "caps_ratio", "has_spam", "is_empty")
BUILDERS: dict[str, list[tuple]] = {
    "instagram": [
        ("num", "followers", ["followers"], 0), ("num", "following", ["following"], 0), ("num", "posts", ["posts"], 0), ("ratio", "ff_ratio", "followers", "following"),
        ("ratio100", "posts_per_100_followers", "posts", "followers"), ("num", "is_verified", ["is_verified"], 0), ("num", "has_profile_pic", ["has_profile_pic", "profile_pic"], 1),
        ("star", "is_celebrity", "followers", 100_000), ("log", "log_followers", "followers"), ("log", "log_following", "following"), ("log", "log_posts", "posts"),
        ("tier", "followers_tier", "followers", FOLLOWER_TOPS), *texts("username", "uname", *NAME_KINDS), *texts("bio", "bio", *FULL_BIO_KINDS),
    ],
    "instagram_precomputed": [
        ("num", "followers", ["#followers"], 0), ("num", "following", ["#follows"], 0), ("num", "posts", ["#posts"], 0), ("ratio", "ff_ratio", "followers", "following"),
        ("ratio100", "posts_per_100_followers", "posts", "followers"), ("log", "log_followers", "followers"), ("log", "log_following", "following"), ("log", "log_posts", "posts"),
        ("tier", "followers_tier", "followers", FOLLOWER_TOPS), ("num", "uname_digit_ratio", ["nums/length username"], 0), ("num", "fullname_word_count", ["fullname words"], 0),
        ("num", "fullname_digit_ratio", ["nums/length fullname"], 0), ("num", "name_eq_username", ["name==username"], 0), ("num", "bio_len", ["description length"], 0),
        ("num", "bio_has_url", ["external url"], 0), ("is", "bio_is_empty", "bio_len", "=", 0), ("num", "has_profile_pic", ["profile pic"], 1), ("num", "is_private", ["private"], 0),
        ("num", "is_verified", ["is_verified"], 0), ("star", "is_celebrity", "followers", 100_000),
    ],
    "facebook": [
        ("num", "friends", ["friends"], 0), ("num", "followers", ["followers"], 0), ("num", "posts", ["posts"], 0), ("ratio", "friends_followers_ratio", "friends", "followers"),
        ("ratio", "posts_per_friend", "posts", "friends"), ("num", "is_verified", ["is_verified"], 0), ("num", "has_profile_pic", ["has_profile_pic", "profile_pic"], 1),
        ("star", "is_celebrity", "followers", 10_000), ("log", "log_friends", "friends"), ("log", "log_followers", "followers"), ("log", "log_posts", "posts"),
        *texts("name", "name", "len", "digit_count", "has_url", "word_count", "all_caps"), *texts("bio", "bio", *ABOUT_KINDS),
    ],
    "x": [
        ("num", "followers", ["followers"], 0), ("num", "following", ["following"], 0), ("num", "tweets", ["tweets", "statuses_count"], 0), ("num", "listed_count", ["listed_count"], 0),
        ("ratio", "ff_ratio", "followers", "following"), ("ratio", "listed_per_follower", "listed_count", "followers"), ("ratio", "tweet_to_follower", "tweets", "followers"),
        ("num", "is_verified", ["is_verified"], 0), ("own_pic", "has_profile_pic", "has_profile_pic", "default_profile_image"), ("star", "is_celebrity", "followers", 100_000),
        ("log", "log_followers", "followers"), ("log", "log_tweets", "tweets"), ("tier", "followers_tier", "followers", FOLLOWER_TOPS),
        *texts("username", "uname", *NAME_KINDS), *texts("bio", "bio", *FULL_BIO_KINDS),
    ],
    "linkedin": [
        ("num", "connections", ["connections"], 0), ("num", "followers", ["followers"], 0), ("num", "endorsements", ["endorsements"], 0), ("ratio", "conn_follow_ratio", "connections", "followers"),
        ("ratio", "endorse_per_conn", "endorsements", "connections"), ("num", "has_photo", ["has_photo", "profile_pic"], 1), ("log", "log_connections", "connections"),
        ("log", "log_endorsements", "endorsements"), ("tier", "conn_tier", "connections", (49, 499)), *texts("name", "name", "len", "digit_count", "word_count"),
        *texts("headline", "headline", "len", "has_url", "has_crypto", "word_count", "has_pipe", "has_at", "has_spam"), *texts("about", "about", *ABOUT_KINDS),
    ],
    "github": [
        ("num", "followers", ["followers"], 0), ("num", "following", ["following"], 0), ("num", "public_repos", ["public_repos", "repos"], 0), ("num", "public_gists", ["public_gists"], 0),
        ("ratio", "ff_ratio", "followers", "following"), ("ratio", "repos_per_follower", "public_repos", "followers"), ("ratio", "gists_per_repo", "public_gists", "public_repos"),
        ("log", "log_followers", "followers"), ("log", "log_repos", "public_repos"), ("log", "log_following", "following"), ("num", "account_age_days", ["account_age_days"], 0),
        ("log", "log_account_age", "account_age_days"), ("sum", "total_public_work", "public_repos", "public_gists"), ("text", "has_bio", "bio", "is_filled"),
        ("is", "is_new_account", "account_age_days", "<", 30), ("is", "is_young_account", "account_age_days", "<", 90), ("ratio_most", "repos_per_day", "public_repos", "account_age_days", 10),
        ("num", "star_received_total", ["star_received_total"], 0), ("ratio", "stars_per_repo", "star_received_total", "public_repos"), ("num", "fork_ratio", ["fork_ratio"], 0),
        ("num", "readme_presence_ratio", ["readme_presence_ratio"], 0), ("num", "unique_languages", ["unique_languages"], 0), ("num", "repo_diversity_score", ["repo_diversity_score"], 0),
        ("num_most", "activity_recency_capped", ["activity_recency"], 9999, 365), ("num", "commit_regularity", ["commit_regularity"], 0),
        ("is", "_has_repos", "public_repos", ">", 0), ("is", "_has_gists", "public_gists", ">", 0), ("is", "_is_active", "activity_recency_capped", "<", 365),
        ("sum", "profile_completeness", "has_bio", "_has_repos", "_has_gists", "_is_active"),
        *texts("username", "uname", "len", "digit_count", "hyphen", "underscore", "pure_numeric"), *texts("bio", "bio", *ABOUT_KINDS),
    ],
    "discord": [
        ("num", "account_age_days", ["account_age_days"], 0), ("log", "log_account_age", "account_age_days"), ("num", "has_avatar", ["has_avatar"], 0), ("num", "suspicion_score", ["suspicion_score"], 0),
        ("seconds", "join_gap_seconds", "created_at_utc", "joined_at_utc"), ("log", "log_join_gap", "join_gap_seconds"), ("is", "very_new_account", "account_age_days", "<", 7),
        ("is", "instant_join", "join_gap_seconds", "<", 60), *texts("username", "uname", *NAME_KINDS),
    ],
    "youtube": [
        ("num", "subscribers", ["subscribers"], 0), ("num", "videos", ["videos"], 0), ("num", "avg_views", ["avg_views"], 0), ("ratio", "subs_per_video", "subscribers", "videos"),
        ("ratio", "views_per_sub", "avg_views", "subscribers"), ("num", "is_verified", ["is_verified"], 0), ("star", "is_celebrity", "subscribers", 100_000), ("log", "log_subscribers", "subscribers"),
        ("log", "log_videos", "videos"), ("tier", "subs_tier", "subscribers", FOLLOWER_TOPS), *texts("channel_name", "cname", "len", "digit_count"), *texts("about", "about", *ABOUT_KINDS),
    ],
    "tiktok": [
        ("num", "followers", ["followers"], 0), ("num", "following", ["following"], 0), ("num", "videos", ["videos", "posts"], 0), ("num", "likes", ["likes"], 0), ("ratio", "ff_ratio", "followers", "following"),
        ("ratio", "likes_per_video", "likes", "videos"), ("ratio", "likes_per_follower", "likes", "followers"), ("num", "is_verified", ["is_verified"], 0), ("star", "is_celebrity", "followers", 100_000),
        ("log", "log_followers", "followers"), ("log", "log_likes", "likes"), ("tier", "followers_tier", "followers", FOLLOWER_TOPS), *texts("username", "uname", *NAME_KINDS),
        *texts("bio", "bio", "len", "word_count", "has_url", "has_crypto", "has_spam", "emoji_count", "is_empty"),
    ],
    "reddit": [
        ("num", "total_karma", ["total_karma"], 0), ("num", "comment_karma", ["comment_karma"], 0), ("num", "post_karma", ["post_karma"], 0), ("ratio", "karma_ratio", "comment_karma", "total_karma"),
        ("num", "account_age_days", ["account_age_days"], 0), ("ratio", "karma_per_day", "total_karma", "account_age_days"), ("log", "log_karma", "total_karma"),
        ("log", "log_account_age", "account_age_days"), *texts("username", "uname", *NAME_KINDS), *texts("about", "about", *ABOUT_KINDS),
    ],
    "snapchat": [
        ("num", "score", ["score"], 0), ("num", "friends_count", ["friends_count"], 0), ("num", "streaks", ["streaks"], 0), ("ratio", "score_per_friend", "score", "friends_count"),
        ("log", "log_score", "score"), ("log", "log_friends", "friends_count"), ("tier", "score_tier", "score", (999, 99_999)), ("is", "has_streaks", "streaks", ">", 0),
        *texts("username", "uname", *NAME_KINDS), *texts("bio", "bio", *ABOUT_KINDS),
    ],
}
#: Platforms whose features go on with those of public-figure scale, and the column that counts as followers there.
WITH_SCALE = {"instagram": "followers", "facebook": "followers", "x": "followers", "youtube": "subscribers", "tiktok": "followers"}
#: Columns by which a file of ready-made features is told; four do.
PRECOMPUTED = ["profile pic", "nums/length username", "fullname words", "nums/length fullname", "name==username", "description length", "external url", "#posts", "#followers", "#follows"]


def of_text(c: Column, kind: str) -> Column:
    if kind in ("underscore", "hyphen"):
        return T.count(c, "_" if kind == "underscore" else "-")
    if kind == "pure_numeric":
        return T.flag(c, r"^\p{Nd}+$")
    if kind == "all_caps":
        return (c == F.upper(c)).cast("int")
    if kind == "has_pipe":
        return F.contains(c, F.lit("|")).cast("int")
    if kind == "is_filled":
        return (F.trim(c) != "").cast("int")
    return T.text_features(c, "t")[f"t_{kind}"]


def made(df: DataFrame, spec: tuple, by_name: dict[str, Column]) -> Column:
    kind, _, *args = spec
    if kind in ("num", "num_most"):
        there = [F.col(f"`{c}`").cast("string").try_cast("double") for c in args[0] if c in df.columns]
        value = F.coalesce(*there, F.lit(float(args[1])))
        return value if kind == "num" else F.least(value, F.lit(float(args[2])))
    if kind == "own_pic":
        own = F.col(args[0]) if args[0] in df.columns else 1 - F.col(args[1]) if args[1] in df.columns else F.lit(1)
        return F.coalesce(own.cast("double"), F.lit(1.0))
    if kind in ("ratio", "ratio100", "ratio_most"):
        r = over(by_name[args[0]], by_name[args[1]]) * (100 if kind == "ratio100" else 1)
        return F.round(F.least(r, F.lit(float(args[2]))) if kind == "ratio_most" else r, 4)
    if kind == "log":
        return F.round(F.log1p(F.greatest(by_name[args[0]], F.lit(0.0))), 4)
    if kind == "tier":
        a, out = by_name[args[0]], F.lit(len(args[1]))
        for k, top in list(enumerate(args[1]))[::-1]:
            out = F.when(a <= top, k).otherwise(out)
        return F.when(a > -1, out).cast("double")
    if kind == "star":
        return ((by_name["is_verified"] == 1) & (by_name[args[0]] > args[1])).cast("int")
    if kind == "is":
        a, v = by_name[args[0]], F.lit(args[2])
        return {"<": a < v, ">": a > v, "=": a == v}[args[1]].cast("int")
    if kind == "sum":
        return reduce(lambda x, y: x + y, [by_name[a] for a in args])
    if kind == "seconds":
        return F.coalesce((F.unix_micros(args[1]) - F.unix_micros(args[0])) / 1e6, F.lit(0.0))
    return of_text(F.coalesce(F.col(args[0]).cast("string"), F.lit("")) if args[0] in df.columns else F.lit(""), args[1])


def build(df: DataFrame, platform: str, key: str = "account_id") -> DataFrame:
    """(key, features...) of one platform. Files with ready-made columns take the ``instagram_precomputed`` list; absent columns take defaults.

    Reddit's karma is the sum of both kinds where any row of the table has one, else ``karma``: one row of totals decides for all.
    """
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    if platform == "instagram" and len(set(PRECOMPUTED) & set(df.columns)) >= 4:
        platform = "instagram_precomputed"
    if platform == "reddit":
        part = lambda c: number(F.col(c)) if c in df.columns else F.lit(0.0)
        split = df.agg((F.coalesce(F.greatest(F.sum(part("comment_karma")), F.sum(part("post_karma"))), F.lit(0.0)) > 0).alias("_split"))
        df = df.crossJoin(F.broadcast(split)).withColumn("total_karma", F.when(F.col("_split"), part("comment_karma") + part("post_karma")).otherwise(part("karma")))
    by_name: dict[str, Column] = {}
    for spec in BUILDERS[platform]:
        by_name[spec[1]] = made(df, spec, by_name)
    out = {n: c for n, c in by_name.items() if n[0] != "_"}
    if platform in WITH_SCALE:
        there = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("double"), F.lit(0.0)) for n in names if n in df.columns], F.lit(0.0))
        base = {c: there(c) for c in ("following", "account_age_days", "is_verified")} | {"followers": there("followers" if "followers" in df.columns else WITH_SCALE[platform]), "posts": there("posts", "tweets", "videos")}
        out |= scale_features(base, "celeb_")
    return df.select(key, *[c.alias(n) for n, c in out.items()])
