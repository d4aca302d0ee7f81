"""Why a score is as it is: votes of signals on the prediction, shown confidence, and the two-stage cascade."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.operators import profiles, rules

# Fixed values: (feature, conditions of a legit account, label).
SIGNALS = [
    ("account_age_days", "> 365", "Account age"), ("account_age_days", "> 90", "Account age (90d)"), ("has_avatar", "= 1", "Profile photo"), ("is_verified", "= 1", "Verification"), ("photo_is_default_avatar", "= 0", "Avatar (non-default)"),
    ("photo_stock_score", "< 0.2", "Avatar uniqueness"), ("photo_ai_generated_score", "< 0.4", "Avatar authenticity"), ("uname_bot_pattern_count", "= 0", "Username pattern"), ("uname_dict_coverage", "> 0.3", "Username readability"), ("uname_digit_ratio", "< 0.4", "Username digits"),
    ("bio_has_spam", "= 0", "Bio content"), ("bio_has_crypto", "= 0", "Bio (crypto)"), ("ff_ratio", "> 0.05 AND < 20", "Follower ratio"), ("behav_posting_interval_entropy", "> 1.5", "Posting pattern"), ("behav_burst_post_count", "= 0", "Burst posting"),
    ("behav_lexical_diversity", "> 0.3", "Content diversity"), ("xp_overall_consistency_score", "> 0.4", "Cross-platform"), ("karma", "> 500", "Reddit karma"), ("public_repos", ">= 3", "GitHub repos"), ("suspicion_score", "< 0.3", "Suspicion score"),
]
ADJUSTING = {"account_age_days": "> 365", "has_avatar": "= 1", "photo_is_default_avatar": "= 0", "is_verified": "= 1", "uname_bot_pattern_count": "= 0", "behav_posting_interval_entropy": "> 1.5", "ff_ratio": "> 0.05 AND < 20", "bio_has_spam": "= 0", "karma": "> 200", "public_repos": ">= 2"}
#: What is said of a signal that holds, and of one that does not.
SAID = ("as with real accounts", "unlike real accounts")
TIPS = {
    "photo_available": "The photo was not looked at: live data has it", "platforms_found": "Look the name up on more platforms", "behavioral_posts": "Posting habits are unknown: fetch the posts",
    "coverage": "Fill in more of the profile", "live_completeness": "No live source answered: set up their keys",
}
MOST = {"strong": 6, "weak": 4, "missing": 5, "tips": 3}


def condition(name: str, holds: str) -> Column:
    """All of the comparisons in ``holds`` are true of the number ``name``."""
    return F.expr(" AND ".join(f"cast({name} as double) {part}" for part in holds.split(" AND ")))


def explained(df: DataFrame, key: str = "account_id") -> DataFrame:
    """(key, checked, agreeing, strong, weak, missing, coverage_pct, tips): lists are capped as reports show them.

    A signal whose column the table lacks, or is NULL, is missing. Strong are those that agree with the prediction.
    """
    has = lambda c: c in df.columns
    legit = F.col("prediction") == "Legit"
    votes = []
    for name, holds, label in SIGNALS:
        ok = condition(name, holds) if has(name) else F.lit(None).cast("boolean")
        votes.append(F.struct(F.lit(label).alias("label"), (ok == legit).alias("agrees"), F.when(ok, SAID[0]).when(~ok, SAID[1]).alias("text")))
    df = df.withColumn("_votes", F.array(*votes))
    some = lambda keep, n: F.slice(F.array_distinct(F.transform(F.filter("_votes", keep), lambda v: F.concat_ws(": ", v["label"], v["text"]))), 1, n)
    agree, against, none = (lambda v: v["agrees"]), (lambda v: ~v["agrees"]), (lambda v: v["agrees"].isNull())
    labels = len({s[2] for s in SIGNALS})
    coverage = F.floor(100 * (labels - F.size(F.array_distinct(F.transform(F.filter("_votes", none), lambda v: v["label"])))) / labels).cast("int")
    given = lambda c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if has(c) else F.lit(0.0))
    wanted = {"photo_available": given("photo_available") == 0, "platforms_found": given("platforms_found") < 3, "behavioral_posts": given("behavioral_posts") == 0, "coverage": coverage < 60, "live_completeness": given("live_completeness") == 0}
    tips = F.slice(F.filter(F.array(*[F.when(wanted[k], t) for k, t in TIPS.items()]), lambda t: t.isNotNull()), 1, MOST["tips"])
    count = lambda keep: F.size(F.filter("_votes", keep))
    return df.select(
        key, (count(agree) + count(against)).alias("checked"), count(agree).alias("agreeing"), some(agree, MOST["strong"]).alias("strong"), some(against, MOST["weak"]).alias("weak"),
        F.slice(F.array_distinct(F.transform(F.filter("_votes", none), lambda v: v["label"])), 1, MOST["missing"]).alias("missing"), coverage.alias("coverage_pct"), tips.alias("tips"),
    )


def shown_confidence(df: DataFrame) -> DataFrame:
    """Adds ``shown``: the confidence after ten votes, of those whose columns the table has."""
    return rules.adjusted(df, {c: condition(c, holds) for c, holds in ADJUSTING.items() if c in df.columns})


def escalates(deep: bool = True, name: str = "username") -> Column:
    """Whether a second, deeper look is worth it: confidence from 40 to below 85, or below 40 with a name to look up."""
    c = F.col("confidence")
    return F.lit(deep) & (c < 85) & ((c >= 40) | F.coalesce(F.trim(name) != "", F.lit(False)))


def cascade(df: DataFrame, live: DataFrame, score: Callable[[DataFrame], DataFrame], features: list[str], key: str = "account_id") -> DataFrame:
    """Scores all rows; those worth it are enriched by ``live(key, ...)`` and scored again, and both results are merged.

    ``score`` adds prediction and confidence. The label changes only where the second stage dominates. Rows that stay have source ``quick``.
    """
    first = profiles.nonzero_share(score(df), features, "c1").withColumn("_up", escalates())
    stay = first.where(~F.col("_up")).select(key, "prediction", "confidence", F.lit("quick").alias("source"))
    up = first.where("_up")
    second = score(profiles.enriched(up.select(*df.columns), live, key))
    second = profiles.nonzero_share(second, features, "c2").select(key, F.col("prediction").alias("p2"), F.col("confidence").alias("s2"), "c2")
    both = up.select(key, F.col("prediction").alias("p1"), F.col("confidence").alias("s1"), "c1").join(second, key)
    merged = rules.merged(both)
    label = F.when(F.col("source") == "stage2_dominant", F.col("p2")).otherwise(F.col("p1"))
    return stay.unionByName(merged.select(key, label.alias("prediction"), F.col("confidence").cast("double").alias("confidence"), "source"))
