"""What accounts write and how often they act: grouped aggregates over posts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authscope.operators import language

URL = r"https?://|www\."


def post_shape(df: DataFrame, key: str = "account_id", reply: Column | None = None) -> DataFrame:
    """Means and spreads of words and characters a post, shares of posts with an address, of their own and, by ``reply``, of replies to oneself."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    again = F.rlike(F.lower(F.trim("text")), F.lit(language.REPOST))
    flags = {"w": words, "u": F.rlike("text", F.lit(URL)).cast("int"), "c": F.length("text"), "o": F.coalesce(again, F.lit(False)).cast("int"), "s": F.coalesce(F.lit(False) if reply is None else reply, F.lit(False)).cast("int")}
    return df.withColumns(flags).groupBy(key).agg(
        F.round(F.avg("w"), 4).alias("mean_words"), F.round(F.coalesce(F.var_samp("w"), F.lit(0.0)), 3).alias("var_words"), F.round(F.avg("u"), 4).alias("url_ratio"),
        F.round(F.avg("c"), 4).alias("mean_chars"), F.round(F.var_pop("c"), 4).alias("var_chars"), F.round(1 - F.avg("o"), 4).alias("original_ratio"), F.round(F.avg("s"), 4).alias("self_reply_ratio"),
    )


def char_entropy(df: DataFrame, col: str, key: str = "account_id") -> DataFrame:
    """Base-2 entropy of a value's characters, inside the row: no shuffle."""
    chars = F.filter(F.split(F.col(col), ""), lambda c: c != "")
    n = F.size(chars)
    p = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    h = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - p(c) * F.log2(p(c)))
    return df.select(key, F.round(F.coalesce(h, F.lit(0.0)), 4).alias("entropy"))


# Columns that count likes and comments, the first that is there and not 0.
LIKES, COMMENTS = ("like_count", "ups", "score", "likes"), ("reply_count", "num_comments", "comments")


def engagement(df: DataFrame, key: str = "account_id") -> DataFrame:
    """Mean, spread and share of zeros of likes and comments a post; columns that ``df`` lacks are left out."""
    first = lambda names: F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in names if c in df.columns], F.lit(0)).cast("double")
    e = first(LIKES) + first(COMMENTS)
    return df.groupBy(key).agg(F.round(F.avg(e), 4).alias("mean"), F.round(F.coalesce(F.var_samp(e), F.lit(0.0)), 3).alias("variance"), F.round(F.avg((e == 0).cast("int")), 4).alias("zero_share"))


def day_regularity(df: DataFrame, as_of: str, key: str = "account_id") -> DataFrame:
    """Spread of events a day (0 with fewer than three days), and days since the last one."""
    days = df.groupBy(key, F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy(key).agg(F.round(F.when(F.count(F.lit(1)) >= 3, F.stddev_samp("n")).otherwise(0.0), 4).alias("regularity"), F.datediff(F.lit(as_of).cast("date"), F.max("d")).alias("recency"))


def day_gaps(df: DataFrame, key: str = "account_id") -> DataFrame:
    """Mean and spread of whole-day gaps between events."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.floor((F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 86_400_000_000)
    return df.withColumn("g", gap).groupBy(key).agg(F.round(F.coalesce(F.avg("g"), F.lit(0.0)), 4).alias("gap_mean"), F.round(F.coalesce(F.stddev_samp("g"), F.lit(0.0)), 4).alias("gap_std"))


def uploads(videos: DataFrame, channels: DataFrame, key: str = "account_id") -> DataFrame:
    """Rhythm and reach of a channel's uploads.

    ``videos``: (key, video_id, ts, description, tags, comment_count), a NULL count where comments are off. ``channels``: (key,
    subscribers, n_videos, views). Gaps are whole days; without two dated videos they are 0.
    """
    w = Window.partitionBy(key).orderBy("ts", "video_id")
    gap = F.floor((F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 86_400_000_000)
    words = F.size(F.filter(F.split(F.coalesce("description", F.lit("")), r"\s+"), lambda x: x != ""))
    off = F.col("comment_count").isNull().cast("int")
    per = videos.withColumns({"_g": gap, "_w": words, "_t": F.coalesce(F.size("tags"), F.lit(0)), "_o": off}).groupBy(key).agg(*[F.avg(c).alias(c) for c in ("_g", "_w", "_t", "_o")], F.stddev_samp("_g").alias("_s"))
    both = channels.join(per, key, "left")
    n, subs = F.greatest(F.coalesce("n_videos", F.lit(0)), F.lit(1)), F.coalesce("subscribers", F.lit(0))
    or_0 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return both.select(
        key, F.round(subs / n, 4).alias("subscriber_to_video_ratio"), F.round(F.col("views") / n, 4).alias("avg_views_per_video"), or_0("_g").alias("upload_frequency_days"), or_0("_s").alias("upload_regularity"),
        F.round(F.col("views") / n / F.greatest(subs, F.lit(1)), 4).alias("view_to_subscriber_ratio"), or_0("_w").alias("description_length_avg"), or_0("_t").alias("tags_per_video_avg"), or_0("_o").alias("comment_disabled_ratio"),
    )


def followed_figures(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Share of the accounts one follows that are verified; unknown ones are not."""
    met = edges.join(people.select(F.col("account_id").alias("dst"), "is_verified"), "dst", "left")
    return met.groupBy(F.col("src").alias("account_id")).agg(F.round(F.avg(F.coalesce("is_verified", F.lit(0))), 4).alias("share"))


def follower_quality(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Mean over followers of min(age in years, 1) x (0.5 + 0.25 avatar + 0.25 bio), at most 1."""
    f = people.select(F.col("account_id").alias("src"), (F.least(F.col("account_age_days") / 365, F.lit(1.0)) * (0.5 + 0.25 * F.col("has_avatar") + 0.25 * F.col("has_bio"))).alias("q"))
    return edges.join(f, "src").groupBy(F.col("dst").alias("account_id")).agg(F.round(F.least(F.avg("q"), F.lit(1.0)), 4).alias("quality"))
