"""Adapters from published layouts of labelled accounts to the library's, and what is known about a file before it is read whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.operators.profiles import adapter_label
from authscope.sources.tables import normal_headers

# Column names of the layouts, by the adapter's name.
RENAMES = {
    "instagram_kaggle": {"#followers": "followers", "#follows": "following", "#posts": "posts", "profile pic": "has_profile_pic", "description length": "bio_len_raw", "external url": "bio_has_url", "private": "is_private", "name==username": "name_eq_username", "fullname words": "fullname_words", "nums/length username": "uname_digit_ratio", "nums/length fullname": "fullname_digit_ratio"},
    "twibot20": {"followers_count": "followers", "friends_count": "following", "statuses_count": "tweets", "screen_name": "username", "verified": "is_verified", "description": "bio"},
    "cresci17": {"followers_count": "followers", "friends_count": "following", "statuses_count": "tweets", "screen_name": "username", "verified": "is_verified", "description": "bio", "listed_count": "listed_count"},
}
LABELS = ["label", "fake", "is_fake", "is_bot", "bot", "target"]
ALIASES = {"followers": ["followers", "followers_count", "#followers", "follower_count"], "following": ["following", "friends_count", "#follows", "friends"], "tweets": ["tweets", "statuses_count", "tweet_count", "posts", "videos"]}
CATALOGUE_LABELS = ["fake", "label", "is_fake", "is_bot", "bot", "target"]
PLATFORM_WORDS = ["instagram", "twitter", "facebook", "github", "reddit", "youtube", "tiktok", "linkedin", "discord", "snapchat"]
READY_MARKS = ["#followers", "#follows", "description length"]
BOT_MARKS = ["followers_count", "friends_count", "statuses_count"]


def instagram_ready(df: DataFrame) -> DataFrame:
    return adapter_label(normal_headers(df).withColumnsRenamed(RENAMES["instagram_kaggle"]), "fake")


def bot_survey(df: DataFrame) -> DataFrame:
    return adapter_label(normal_headers(df).withColumnsRenamed(RENAMES["twibot20"]), "label")


def bot_study(df: DataFrame, is_bot: int = 0) -> DataFrame:
    """All rows of a file have one label, which the caller knows."""
    return normal_headers(df).withColumnsRenamed(RENAMES["cresci17"]).withColumn("label", F.lit(is_bot))


def generic(df: DataFrame) -> DataFrame:
    """The first known label column, and the first alias of followers, following and tweets where the plain name is absent."""
    df = normal_headers(df)
    label = next((c for c in LABELS if c in df.columns), None)
    if label is None:
        raise ValueError(f"no label column; expected one of {LABELS}")
    renames = {a: name for name, aliases in ALIASES.items() if name not in df.columns for a in [next((a for a in aliases if a in df.columns), None)] if a}
    return adapter_label(df.withColumnsRenamed(renames), label)


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"instagram_kaggle": instagram_ready, "twibot20": bot_survey, "cresci17": bot_study, "generic": generic}


def adapted(df: DataFrame, name: str) -> DataFrame:
    """By the named adapter; where the columns do not suit it, or it is unknown, by the generic one."""
    wanted = {"instagram_kaggle": "fake", "twibot20": "label"}.get(name)
    columns = normal_headers(df).columns
    return ADAPTERS[name](df) if name in ADAPTERS and (wanted is None or wanted in columns or "label" in columns) else generic(df)


def summary(df: DataFrame) -> DataFrame:
    """(rows, fakes, legit) of an adapted table."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("label"), F.lit(0)).alias("fakes")).withColumn("legit", F.col("rows") - F.col("fakes"))


def first_of(names: list[str], columns: Column) -> Column:
    """The first of ``names`` that the array holds."""
    return F.get(F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains(columns, n)), F.lit(0))


def catalogue(files: DataFrame) -> DataFrame:
    """(path, filename, platform, adapter, label_col) of ``files(path, columns)``; files without a label column go."""
    cols = F.transform("columns", lambda c: F.lower(F.trim(c)))
    low = F.lower("path")
    platform = F.coalesce(*[F.when(F.contains(low, F.lit(p)), p) for p in PLATFORM_WORDS], F.lit("unknown"))
    platform = F.when(F.contains(low, F.lit("x_train")) | F.contains(low, F.lit("twitter")), "x").otherwise(platform)
    has = lambda marks: F.arrays_overlap(cols, F.array(*map(F.lit, marks)))
    rows = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), first_of(CATALOGUE_LABELS, cols).alias("label_col"), platform.alias("platform"), has(READY_MARKS).alias("_ready"), has(BOT_MARKS).alias("_bots"), F.array_contains(cols, "label").alias("_label"))
    adapter = F.when(F.col("_ready"), "instagram_kaggle").when(F.col("_bots") & F.col("_label"), "twibot20").when(F.col("_bots"), "cresci17").otherwise("generic")
    platform = F.when(F.col("_ready"), "instagram").when(F.col("_bots"), "x").otherwise(F.col("platform"))
    return rows.where("label_col is not null").select("path", "filename", platform.alias("platform"), adapter.alias("adapter"), "label_col")


def described(df: DataFrame) -> DataFrame:
    """(value, n): how often each value of the label stands, with the table's shape: (rows, columns, features, label_col)."""
    label = next((c for c in LABELS if c in df.columns), None)
    features = len([c for c in df.columns if c not in LABELS])
    shape = [F.lit(len(df.columns)).alias("columns"), F.lit(features).alias("features"), F.lit(label).alias("label_col")]
    if label is None:
        return df.agg(F.lit(None).cast("string").alias("value"), F.count(F.lit(1)).alias("n")).select("value", "n", *shape)
    return df.groupBy(F.col(label).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select("value", "n", *shape)


def listed(lines: DataFrame, column: str = "value") -> DataFrame:
    """(entry): non-empty lines of a reference list, without comments, in lower case."""
    entry = F.lower(F.trim(F.col(column)))
    return lines.select(entry.alias("entry")).where((F.col("entry") != "") & ~F.col("entry").startswith("#"))


def listed_by_platform(texts: DataFrame, column: str = "body") -> DataFrame:
    """(platform, entry) of JSON texts {platform: [names]}."""
    pairs = texts.select(F.explode(F.from_json(column, "map<string, array<string>>")).alias("platform", "names"))
    return pairs.select(F.lower("platform").alias("platform"), F.explode("names").alias("entry")).withColumn("entry", F.lower(F.trim("entry")))
