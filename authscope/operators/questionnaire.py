"""Answers of a questionnaire about an account, as numeric signals. Single projections: answer tables are literal maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (signals, answers with their values) by question.
_LENGTHS = {"Very Short (1-2 words)": (12, 8), "Very short (1-2 words)": (12, 8), "Short (sentence)": (50, 18), "Short": (50, 18), "Medium (paragraph)": (150, 50), "Medium": (150, 50), "Long": (350, 90), "Long (near 280)": (250, 30), "Mixed": (150, 130)}
ANSWERS: dict[str, tuple[tuple[str, ...], dict[str, tuple[float | None, ...]]]] = {
    "posting_pattern": (("behav_posting_interval_entropy", "behav_posting_interval_std", "behav_burst_score"), {
        "Regular/Scheduled": (0.30, 0.20, 0.05), "Regular": (0.30, 0.20, 0.05), "Irregular/Random": (0.75, 0.65, 0.25), "Irregular": (0.75, 0.65, 0.25), "Burst (many then silence)": (0.95, 0.95, 0.90),
        "Burst": (0.95, 0.95, 0.90), "Very Infrequent": (0.50, 0.85, 0.40), "Infrequent": (0.50, 0.85, 0.40), "Bursts then silence": (0.95, 0.95, 0.90), "Burst joins then silent": (0.95, 0.95, 0.90)}),
    "engagement_level": (("behav_avg_engagement", "behav_zero_engagement_ratio"), {
        "High": (0.08, 0.05), "High (lots of likes/comments)": (0.08, 0.05), "High upvotes": (0.08, 0.05), "Medium": (0.04, 0.20), "Low": (0.01, 0.55), "Mostly downvoted": (0.005, 0.20), "Zero": (0.0, 0.95), "Zero (no engagement)": (0.0, 0.95)}),
    "caption_length": (("behav_avg_post_length", "behav_post_length_variance"), _LENGTHS),
    "follower_quality": (("follower_quality_score",), {
        "Mostly real-looking accounts": (0.85,), "Mostly real": (0.85,), "Mostly real professionals": (0.85,), "Active developers": (0.85,), "Appears organic growth": (0.85,), "Mix of real and suspicious": (0.50,), "Mixed": (0.50,),
        "Mostly bots/empty profiles": (0.10,), "Mostly bots": (0.10,), "Mostly empty profiles": (0.10,), "Suspicious growth pattern": (0.15,)}),
    "mutual_follow_rate": (("mutual_follow_rate_score",), {"High (most follow back)": (0.80,), "High": (0.80,), "Medium": (0.45,), "Low (one-directional)": (0.10,), "Low": (0.10,)}),
    "cross_platform_consistency": (("cross_platform_consistency_score",), {
        "Same name/bio/photo everywhere": (0.95,), "Same everywhere": (0.95,), "Similar but not identical": (0.65,), "Similar": (0.65,), "Very different profiles": (0.20,), "Very different": (0.20,), "Only exists on this platform": (0.0,), "Single platform": (0.0,), "Single platform only": (0.0,)}),
    "cross_platform_ages": (("cross_platform_ages_score",), {"Yes, similar age across platforms": (0.90,), "No, created at very different times": (0.30,), "Some platforms much newer": (0.50,)}),
    "follower_growth": (("follower_growth_score", "follower_spike_score"), {
        "Gradual organic growth": (0.85, 0.05), "Gradual": (0.85, 0.05), "Sudden spike": (0.30, 0.95), "Steady decline": (0.40, 0.10), "Decline": (0.40, 0.10), "Stagnant/dead": (0.20, 0.05), "No change": (0.50, 0.05), "Gradual natural growth": (0.85, 0.05), "Sudden suspicious spike": (0.20, 0.95)}),
    "upload_frequency": (("uploads_per_day",), {
        "Multiple daily": (5.0,), "Daily": (1.0,), "Weekly": (0.15,), "Monthly": (0.04,), "Sporadic": (0.02,), "Rarely": (0.01,), "Never": (0.0,), "Inactive": (0.0,), "Today": (1.0,), "This week": (0.5,), "This month": (0.1,), "Months ago": (0.01,), "Years ago": (0.0,)}),
    "video_length": (("video_length_s",), {"< 1 min (Shorts)": (30,), "< 15 sec": (10,), "15-60 sec": (30,), "1-3 min": (120,), "1-5 min": (180,), "3-10 min": (360,), "5-15 min": (600,), "15-60 min": (1800,), "60+ min": (3900,), "Mixed": (600,)}),
    "karma_activity_ratio": (("karma_activity",), {"High karma, low posts (quality)": (0.85,), "Balanced": (0.55,), "Low karma, high posts (spam-like)": (0.10,)}),
    "likes_follower_ratio": (("likes_follower_score",), {"High (organic)": (0.10,), "Balanced": (0.05,), "Suspiciously low": (0.005,)}),
    "controversial_ratio": (("controversial_share",), {"None": (0.0,), "Few": (0.10,), "Many": (0.40,), "Mostly controversial": (0.75,)}),
    "connections": (("connections_value",), {"< 50": (30,), "50-150": (100,), "150-500": (300,), "500+": (500,)}),
    "subscriber_quality": (("subscriber_quality_score",), {"Appears organic growth": (0.85,), "Suspicious growth pattern": (0.15,)}),
}
TOPIC_RISK = {
    "Crypto/Finance": 0.85, "Crypto": 0.85, "Crypto promo": 0.95, "Adult content": 0.85, "NSFW": 0.85, "Spam": 0.95, "Promotions/Ads": 0.70, "Promo": 0.70, "Politics": 0.40, "Random content": 0.50,
    "Personal/Mixed": 0.10, "Personal": 0.10, "Lifestyle": 0.10, "Food": 0.10, "Travel": 0.10, "Tech": 0.10, "Music": 0.10, "Sports": 0.10, "Education": 0.05, "Gaming": 0.10, "Vlogs": 0.10, "Beauty": 0.10,
    "Comedy": 0.10, "Dance": 0.10, "News": 0.10, "Memes": 0.20, "Advice": 0.10, "Other": 0.30, "Community chat": 0.05, "Support": 0.05, "Bot commands": 0.30,
}
OTHER_RISK, MOST_PLATFORMS = 0.30, 9
DATES = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy"]
DATE_FIELDS = ["creation_date", "cake_day", "joined_at_utc", "created_at_utc", "created_at"]
TRUE = ["1", "true", "yes", "on", "y", "t"]
#: Fields of each platform's form: (feature, field, kind).
FORMS: dict[str, list[tuple[str, str, str]]] = {
    "instagram": [("username", "username", "name"), ("followers", "followers", "int"), ("following", "following", "int"), ("posts", "posts", "int"), ("bio", "bio", "text"), ("is_verified", "verified", "bool"), ("is_private", "is_private", "bool"), ("is_business", "is_business", "bool"), ("has_highlights", "has_highlights", "bool"), ("bio_has_url", "website_url", "filled")],
    "facebook": [("name", "name", "name"), ("friends", "friends", "int"), ("followers", "followers", "int"), ("posts", "posts", "int"), ("bio", "bio", "text"), ("is_verified", "verified", "bool"), ("relationship_listed", "relationship_listed", "bool"), ("has_cover_photo", "has_cover_photo", "bool"), ("mutual_friends", "mutual_friends", "int"), ("group_count", "group_count", "int")],
    "x": [("username", "username", "name"), ("followers", "followers", "int"), ("following", "following", "int"), ("tweets", "tweets", "int"), ("bio", "bio", "text"), ("is_verified", "verified", "bool"), ("listed_count", "listed_count", "int"), ("default_header", "default_header", "bool"), ("is_protected", "is_protected", "bool"), ("bot_client", "tweet_source", "client")],
    "linkedin": [("name", "name", "name"), ("connections", "connections", "bucket"), ("followers", "followers", "int"), ("headline", "headline", "text"), ("about", "about", "text"), ("skills_count", "skills_count", "int"), ("endorsement_count", "endorsement_count", "int"), ("has_banner", "has_banner", "bool"), ("career_logical", "job_dates_sequential", "yes_no")],
    "github": [("username", "username", "name"), ("followers", "followers", "int"), ("following", "following", "int"), ("public_repos", "public_repos", "int"), ("bio", "bio", "text"), ("public_gists", "public_gists", "int"), ("is_hireable", "is_hireable", "bool"), ("total_stars", "total_stars", "int"), ("unique_languages", "unique_languages", "int"), ("org_count", "org_count", "int")],
    "discord": [("username", "username", "name"), ("bio", "bio", "text"), ("has_avatar", "has_custom_avatar", "bool"), ("has_nitro", "has_nitro", "bool"), ("server_count", "server_count", "int"), ("role_count", "role_count", "int"), ("sends_unsolicited_dms", "sends_unsolicited_dms", "bool"), ("mentions_everyone", "mentions_everyone", "bool"), ("suspicion_score", "suspicion_score", "int")],
    "youtube": [("channel_name", "channel_name", "name"), ("subscribers", "subscribers", "int"), ("videos", "total_videos", "int"), ("about", "about", "text"), ("total_views", "total_views", "int"), ("is_verified", "is_verified", "bool"), ("comments_enabled", "comments_enabled", "bool"), ("avg_views", "avg_views", "int"), ("avg_video_length_s", "video_length", "video")],
    "tiktok": [("username", "username", "name"), ("followers", "followers", "int"), ("following", "following", "int"), ("videos", "total_videos", "int"), ("bio", "bio", "text"), ("is_verified", "verified", "bool"), ("total_likes", "total_likes", "int"), ("is_private", "is_private", "bool"), ("video_length_s", "video_length", "video")],
    "reddit": [("username", "username", "name"), ("post_karma", "post_karma", "int"), ("comment_karma", "comment_karma", "int"), ("karma", "post_karma", "karma"), ("about", "about", "text"), ("trophy_count", "trophy_count", "int"), ("has_premium", "has_premium", "bool"), ("controversial_ratio", "controversial_ratio", "controversial")],
    "snapchat": [("username", "username", "name"), ("score", "snap_score", "int"), ("bio", "bio", "text"), ("has_bitmoji", "has_bitmoji", "bool"), ("is_public", "is_public", "bool"), ("has_public_story", "has_public_story", "bool"), ("sends_unsolicited", "sends_unsolicited", "bool")],
}


def answer(question: str, given: Column, k: int = 0) -> Column:
    """Signal ``k`` of an answer; NULL for answers that are not known."""
    known = [x for a, v in ANSWERS[question][1].items() for x in (F.lit(a), F.lit(float(v[k])))]
    return F.try_element_at(F.create_map(*known), given)


def signals(df: DataFrame, questions: list[str], key: str = "account_id") -> DataFrame:
    """(key, signals...) of the answers in columns named as the questions."""
    return df.select(key, *[answer(q, F.col(q), k).alias(s) for q in questions for k, s in enumerate(ANSWERS[q][0])])


def topic_features(topics: Column) -> dict[str, Column]:
    """Number, concentration (1 / n) and mean risk of an array of topics; NULL for none."""
    n = F.nullif(F.size(topics), F.lit(0))
    risk = F.create_map(*[x for t, r in TOPIC_RISK.items() for x in (F.lit(t), F.lit(r))])
    total = F.aggregate(F.transform(topics, lambda t: F.coalesce(F.try_element_at(risk, t), F.lit(OTHER_RISK))), F.lit(0.0), lambda a, x: a + x)
    return {"behav_topic_count": n, "behav_topic_hhi": F.round(1 / n, 3), "behav_topic_risk": F.round(total / n, 3)}


def content_features(kinds: Column) -> dict[str, Column]:
    """Shares of original, repeated and linking posts that an array of content types stands for; NULL for none."""
    has = lambda *words: F.exists(kinds, lambda c: F.rlike(F.lower(c), F.lit("|".join(words))))
    original, repost, some = has("original"), has("repost", "share", "retweet"), F.size(kinds) > 0
    return {
        "behav_original_ratio": F.when(some, F.when(original & ~repost, 1.0).when(original, 0.5).otherwise(0.1)), "behav_repost_ratio": F.when(some, F.when(repost & ~original, 0.7).when(repost, 0.3).otherwise(0.0)),
        "behav_url_post_ratio": F.when(some, F.when(has("link", "url"), 0.4).otherwise(0.0)),
    }


def presence(platforms: Column) -> dict[str, Column]:
    n = F.coalesce(F.nullif(F.size(platforms), F.lit(-1)), F.lit(0))
    return {"cross_platform_count": n, "cross_platform_presence_ratio": F.round(n / MOST_PLATFORMS, 3)}


def parsed_date(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATES]).cast("date")


def account_age(df: DataFrame, as_of: str) -> Column:
    """Days: as told, else from the first date field that parses."""
    told = F.round(F.col("account_age_days").cast("string").try_cast("double")).cast("int") if "account_age_days" in df.columns else F.lit(None).cast("int")
    dates = [F.datediff(F.lit(as_of).cast("date"), parsed_date(F.col(c))) for c in DATE_FIELDS if c in df.columns]
    return F.coalesce(F.when(told >= 0, told), *dates) if dates else F.when(told >= 0, told)


def form_value(df: DataFrame, field: str, kind: str) -> Column:
    c = F.col(field).cast("string") if field in df.columns else F.lit(None).cast("string")
    whole = F.round(c.try_cast("double")).cast("long")
    match kind:
        case "int":
            return whole
        case "bool":
            return F.coalesce(F.lower(F.trim(c)).isin(TRUE), F.lit(False)).cast("int")
        case "name":
            return F.trim(F.coalesce(c, F.lit("")))
        case "filled":
            return (F.trim(F.coalesce(c, F.lit(""))) != "").cast("int")
        case "client":
            return F.coalesce(F.rlike(F.lower(c), F.lit("third-party|bot")), F.lit(False)).cast("int")
        case "bucket":
            return F.coalesce(answer("connections", c).cast("long"), whole)
        case "yes_no":
            return F.when(c.startswith("Yes"), 1.0).when(c.startswith("No"), 0.0)
        case "video":
            return answer("video_length", c)
        case "controversial":
            return answer("controversial_ratio", c)
        case "karma":
            other = form_value(df, "comment_karma", "int")
            return F.when(whole.isNotNull() | other.isNotNull(), F.coalesce(whole, F.lit(0)) + F.coalesce(other, F.lit(0)))
    return F.coalesce(c, F.lit(""))


def mapped(df: DataFrame, platform: str, key: str = "account_id") -> DataFrame:
    """(key, features...) of a platform's form table, with ``coverage``: the share of features that are there, not empty and not 0."""
    cols = {name: form_value(df, field, kind) for name, field, kind in FORMS[platform]}
    there = sum((F.coalesce(~c.cast("string").isin("", "0", "0.0"), F.lit(False)).cast("int") for c in cols.values()), F.lit(0))
    return df.select(key, *[c.alias(n) for n, c in cols.items()], F.round(there / len(cols), 4).alias("coverage"))


def derived(df: DataFrame) -> dict[str, Column]:
    """Ratios, scale and completeness from followers, following, posts (or tweets or videos), account_age_days and nine fields."""
    col = lambda c: F.col(c) if c in df.columns else F.lit(None)
    f, g, age = col("followers"), col("following"), col("account_age_days")
    posts = F.coalesce(*[F.nullif(col(c).cast("double"), F.lit(0.0)) for c in ("posts", "tweets", "videos")])
    over = lambda x: F.when(x > 0, x).otherwise(1)
    asked = ["bio", "username", "name", "display_name", "location", "website_url", "creation_date", "has_profile_pic", "is_verified"]
    there = sum((F.coalesce(~col(c).cast("string").isin("", "0"), F.lit(False)).cast("int") for c in asked), F.lit(0))
    return {
        "ff_ratio": F.round(f / over(g), 4), "posts_per_100_followers": F.round(posts / over(f) * 100, 4), "posts_per_day": F.when(age > 0, F.round(posts / age, 4)), "log_followers": F.round(F.log1p(F.greatest(f, F.lit(0))), 4),
        "followers_tier": F.when(f < 1000, 0).when(f < 100_000, 1).when(f < 1_000_000, 2).when(f.isNotNull(), 3), "profile_completeness": F.round(there / len(asked), 3),
    }
