"""Aggregates of child tables by account: rates, repositories, comments, tweets, careers, and bundles of feature groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authscope.functions import text as T

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value: milliseconds from which 64-bit ids count their creation.
EPOCH = 1420070400000


def share(a: Column, b: Column) -> Column:
    return F.round(a / F.greatest(b, F.lit(1)), 4)


def rates(df: DataFrame, key: str = "account_id") -> DataFrame:
    """Five rates of (follows, unfollows, given, received, replies, posts, age); each says what a divisor of 0 gives."""
    follows, unfollows, given, received, replies, posts, age = (F.col(c) for c in ("follows", "unfollows", "given", "received", "replies", "posts", "age"))
    a_day = lambda x: F.when(age <= 0, x.cast("double")).otherwise(F.round(F.try_divide(x, age), 4))
    cols = {
        "follow_velocity": a_day(follows), "unfollow_rate": F.when(follows <= 0, 0.0).otherwise(F.round(F.least(F.try_divide(unfollows, follows), F.lit(1.0)), 4)),
        "engagement_received_vs_given": F.when(given <= 0, F.when(received > 0, received.cast("double")).otherwise(1.0)).otherwise(F.round(F.try_divide(received, given), 4)),
        "reply_to_original_ratio": share(replies, posts - replies), "account_age_vs_activity": a_day(posts),
    }
    return df.select(key, *[c.alias(n) for n, c in cols.items()])


def repositories(df: DataFrame, key: str = "account_id") -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(
        F.sum("stars").alias("star_received_total"), share(F.count_if("fork"), n).alias("fork_ratio"), share(F.count_if("described"), n).alias("readme_presence_ratio"), F.count_distinct("language").alias("unique_languages"),
        share(F.count_distinct("language"), n).alias("repo_diversity_score"), n.alias("repos"),
    )


def comments(df: DataFrame, people: DataFrame, key: str = "account_id") -> DataFrame:
    """Of (is_comment, community, fought, text, ts) and of ``people(karma, account_age_days)``; the entropy is that of the hours, base 2."""
    c = F.col("is_comment")
    words = F.regexp_count("text", F.lit(WORD))
    per = df.groupBy(key).agg(F.count_if(c).alias("c"), F.count_if(~c).alias("p"), F.count_distinct("community").alias("n"), F.count_if(c & F.col("fought")).alias("f"), F.avg(F.when(c, words)).alias("w"), *[F.count_if(F.hour("ts") == h).alias(f"h{h}") for h in range(24)])
    both = per.join(people, key)
    hours = F.filter(F.array(*[F.col(f"h{h}").cast("double") for h in range(24)]), lambda n: n > 0)
    total = F.aggregate(hours, F.lit(0.0), lambda s, n: s + n)
    entropy = F.aggregate(hours, F.lit(0.0), lambda s, n: s - n / total * F.log2(n / total))
    active = F.greatest("c", F.lit(1)) + F.greatest("p", F.lit(1))
    return both.select(
        key, share(F.col("karma"), F.col("account_age_days")).alias("karma_per_day"), share(F.col("c"), F.col("p")).alias("comment_to_post_ratio"), F.round(F.col("n") / active, 4).alias("subreddit_diversity"), F.round(F.coalesce("w", F.lit(0.0)), 4).alias("avg_comment_length"),
        share(F.col("f"), F.col("c")).alias("controversial_ratio"), F.round(F.abs(entropy), 4).alias("posting_time_entropy"), F.round(F.col("karma") / active, 4).alias("karma_to_activity_ratio"),
    )


def refers(kind: str) -> Column:
    """Whether any referenced post is of a type."""
    return F.exists("referenced", lambda r: r["type"] == kind)


def tweets(df: DataFrame, people: DataFrame, key: str = "account_id") -> DataFrame:
    """Of (text, referenced array of types) and of ``people(followers, listed_count, tweets, account_age_days, default_profile_image)``."""
    mean = lambda x: F.round(F.avg(x), 4)
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    per = df.groupBy(key).agg(
        mean(yes(refers("retweeted"))).alias("retweet_ratio"), mean(yes(refers("replied_to"))).alias("reply_ratio"), mean(F.length("text")).alias("avg_tweet_length"), mean(T.count(F.col("text"), r"#[\p{L}\p{N}_]+")).alias("hashtag_density"),
        mean(T.count(F.col("text"), r"@[\p{L}\p{N}_]+")).alias("mention_density"), mean(T.flag(F.col("text"), T.URL)).alias("url_in_tweet_ratio"),
    )
    own = people.select(key, share(F.col("listed_count"), F.col("followers")).alias("listed_ratio"), share(F.coalesce("tweets", F.lit(0)), F.col("account_age_days")).alias("tweet_frequency"), F.col("default_profile_image").alias("default_avatar"))
    return per.join(own, key)


def careers(people: DataFrame, positions: DataFrame, key: str = "account_id") -> DataFrame:
    """Of ``people(connections, endorsements, skills, headline, about, education, has_photo)`` and ``positions(place, tie, start_year, end_year)``.

    A position that ended more than a year before the next one began breaks the career; open ones never do.
    """
    w = Window.partitionBy(key).orderBy("place", "tie")
    gone = positions.withColumn("_next", F.lead("start_year").over(w)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce("end_year", F.lit(9999)) < F.col("_next") - 1).alias("_bad"))
    c, n = F.col("connections"), F.coalesce("_n", F.lit(0))
    some = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")) != ""
    parts = [some("headline"), some("about"), n > 0, F.col("education") > 0, F.col("skills") > 0, F.col("has_photo") == 1]
    bucket = F.when(c >= 500, 3).when(c >= 150, 2).when(c >= 50, 1).otherwise(0)
    return people.join(gone, key, "left").select(
        key, bucket.alias("connection_bucket"), share(F.col("endorsements"), F.col("skills")).alias("endorsement_to_skill_ratio"), F.round(sum(p.cast("int") for p in parts) / 6, 4).alias("section_completeness"),
        F.round(F.when(n < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("_bad"), F.col("_n") - 1))), 4).alias("career_consistency"),
    )


def profile_ratios(df: DataFrame, key: str = "account_id") -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    there = (F.coalesce("bio", F.lit("")) != "").cast("int") + zero("profile_pic") + F.col("has_url") + F.col("is_verified")
    return df.select(key, share(F.col("followers"), F.col("following")).alias("follower_following_ratio"), share(F.col("likes"), F.col("followers")).alias("likes_to_follower_ratio"), share(F.col("likes"), zero("videos")).alias("avg_likes_per_video"), share(F.col("posts"), F.col("followers")).alias("media_per_follower"), F.round(there / 4, 4).alias("profile_completeness"))


def created_ms(user_id: Column) -> Column:
    return F.shiftright(user_id, 22) + EPOCH


def members(df: DataFrame, as_of: str, key: str = "account_id") -> DataFrame:
    """Creation time, age and messages a day of (user_id, posts)."""
    at = created_ms(F.col("user_id"))
    age = F.datediff(F.lit(as_of).cast("date"), F.timestamp_millis(at)).cast("long")
    return df.select(key, at.alias("created_ms"), age.alias("age_days"), share(F.col("posts"), age).alias("message_frequency"))


def parts_there(columns: list[str]) -> Column:
    return F.round(F.least(sum(F.col(c).isNotNull().cast("int") for c in columns) / len(columns), F.lit(1.0)), 4)


def hour_skew(df: DataFrame, key: str = "account_id") -> DataFrame:
    """Mean cubed deviation of the hour by the cube of its sample deviation; NULL with fewer than three events. Sums of powers, so one pass does."""
    h = F.hour("ts").cast("double")
    s = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(h).alias("m"), F.avg(h * h).alias("m2"), F.avg(h * h * h).alias("m3"), F.stddev_samp(h).alias("s"))
    third = F.col("m3") - 3 * F.col("m") * F.col("m2") + 2 * F.pow("m", F.lit(3))
    return s.select(key, F.when(F.col("n") >= 3, F.round(third / F.greatest(F.pow("s", F.lit(3)), F.lit(1e-9)), 4)).alias("hour_skew"))


def seconds_of(raw: Column) -> Column:
    """Seconds from a number or an ISO time; NULL for anything else."""
    return F.coalesce(raw.try_cast("double"), F.unix_micros(raw.try_cast("timestamp")) / 1e6)


def bundled(tables: list[DataFrame], key: str = "account_id") -> DataFrame:
    """All columns of tables of one row a key; what a table lacks is NULL."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables)
