"""Row-wise profile operators: coercion, missing values, feature builders. Single projections without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label spellings, platform medians, group weights.
FAKE = ["true", "1", "yes", "y", "fake", "bot", "spam"]
REAL = ["false", "0", "no", "n", "legit", "real", "human", "genuine"]
MEDIANS = {
    "instagram": {"followers": 150, "following": 300, "posts": 15, "is_verified": 0, "bio_length": 20, "ff_ratio": 0.5, "posts_per_100_followers": 10.0, "uname_len": 10, "uname_digit_count": 1, "bio_len": 20, "bio_has_url": 0, "bio_has_crypto": 0, "bio_has_at": 0, "bio_digit_count": 0},
    "facebook": {"friends": 350, "followers": 200, "posts": 40, "is_verified": 0, "ff_ratio": 1.0},
    "x": {"followers": 200, "following": 350, "tweets": 300, "is_verified": 0, "ff_ratio": 0.6},
    "linkedin": {"connections": 180, "followers": 200, "headline_len": 50, "about_len": 80},
    "github": {"followers": 15, "following": 30, "public_repos": 10, "public_gists": 1, "account_age_days": 730, "bio_len": 30, "ff_ratio": 0.5},
    "discord": {"account_age_days": 400, "has_avatar": 1, "suspicion_score": 0.1},
    "youtube": {"subscribers": 1500, "videos": 30, "about_len": 60},
    "tiktok": {"followers": 500, "following": 300, "videos": 20, "bio_len": 20},
    "reddit": {"karma": 2500, "account_age_days": 800, "about_len": 30},
    "snapchat": {"score": 15000, "bio_len": 15},
}
IMPORTANT = ["followers", "following", "posts", "tweets", "videos", "karma", "account_age_days", "public_repos", "public_gists", "connections", "subscribers", "score", "friends", "bio", "about", "headline", "has_avatar", "is_verified"]
LABEL_NAMES = ["label", "is_fake", "fake", "target", "is_bot", "bot", "fake_profile", "fake_account", "class"]
GROUP_WEIGHTS = {"username": 0.8, "bio": 0.9, "photo": 1.2, "behavioral": 1.5, "cross_platform": 1.3, "temporal": 1.1}


def number(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(float(default)))


def binary_label(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(FAKE), 1).when(s.isin(REAL), 0)


def over(a: Column, b: Column) -> Column:
    """a / b with a divisor of 0 taken as 1."""
    return a / F.when(b == 0, 1).otherwise(b)


def group_weight(name: str) -> float:
    return next((w for p, w in GROUP_WEIGHTS.items() if name.startswith(p + "_")), 1.0)


def weighted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[(F.col(c) * F.lit(group_weight(c))).alias(c) for c in df.columns if c not in keys])


def aligned(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Absent features as NULL, unknown ones dropped, in the trained order."""
    return df.select(*keys, *[(F.col(n) if n in df.columns else F.lit(None)).cast("double").alias(n) for n in names])


def default_of(platform: Column, feature: str) -> Column:
    """The platform's median of a feature; NULL where it has none."""
    known = [x for p, m in MEDIANS.items() if feature in m for x in (F.lit(p), F.lit(float(m[feature])))]
    return F.try_element_at(F.create_map(*known), F.lower(platform)) if known else F.lit(None).cast("double")


def missing(c: Column) -> Column:
    """NULL, not a number, or an empty text."""
    s = c.cast("string")
    return F.coalesce((s == "") | (s == "NaN"), F.lit(True))


def filled(df: DataFrame, platform_col: str, features: list[str], flags: bool = True) -> DataFrame:
    """Numeric ``features`` with platform medians (else 0) where missing, and a flag for each important one.

    Features that the table lacks come in for the platforms that have a median of them, else NULL.
    """
    p, out = F.col(platform_col), {}
    absent = sorted({f for m in MEDIANS.values() for f in m} - set(df.columns))
    for f in features:
        gone = missing(F.col(f))
        out[f] = F.when(gone, F.coalesce(default_of(p, f), F.lit(0.0))).otherwise(F.col(f).cast("double"))
        if flags and f in IMPORTANT:
            out[f"{f}_missing"] = gone.cast("int")
    for f in absent:
        out[f] = default_of(p, f)
        if flags and f in IMPORTANT:
            out[f"{f}_missing"] = F.when(default_of(p, f).isNotNull(), 1)
    return df.withColumns(out)


def completeness(df: DataFrame, platform_col: str, features: list[str], out: str = "completeness") -> DataFrame:
    """Share of a platform's important features that are there; where it has none, share of all ``features``."""
    there = {f: (~missing(F.col(f))).cast("int") for f in features}
    share = sum(there.values(), F.lit(0)) / len(features)
    for p, m in MEDIANS.items():
        asked = [f for f in IMPORTANT if f in m]
        if asked:
            share = F.when(F.lower(platform_col) == p, sum((there.get(f, F.lit(0)) for f in asked), F.lit(0)) / len(asked)).otherwise(share)
    return df.withColumn(out, F.round(share, 4))


def nonzero_share(df: DataFrame, features: list[str], out: str = "nonzero_share") -> DataFrame:
    """Share of features that are there and not 0."""
    return df.withColumn(out, F.round(sum(((~missing(F.col(f))) & F.coalesce(F.col(f).cast("double") != 0, F.lit(True))).cast("int") for f in features) / len(features), 4))


#: Fields of live data that replace what was there before, unless they are 0.
LIVE_FIRST = ["account_age_days", "public_gists", "star_received_total", "fork_ratio", "readme_presence_ratio", "unique_languages", "repo_diversity_score", "activity_recency", "commit_regularity", "repos_per_day", "followers", "following", "public_repos"]


def enriched(df: DataFrame, live: DataFrame, key: str = "account_id") -> DataFrame:
    """Rows of ``df`` with the numeric columns of ``live(key, ...)``: new ones come in, others where ``df`` has 0; NULL never replaces."""
    names = [c for c in live.columns if c != key]
    both = df.alias("d").join(live.alias("l"), key, "left")
    out = {}
    for c in names:
        new = F.col(f"l.{c}").cast("double")
        if c in df.columns:
            old = F.col(f"d.{c}").cast("double")
            takes = (F.lit(True) if c in LIVE_FIRST else old == 0) & ((new != 0) if c in LIVE_FIRST else F.lit(True))
            out[c] = F.when(new.isNotNull() & F.coalesce(takes, F.lit(False)), new).otherwise(old)
        else:
            out[c] = F.when(new != 0, new) if c in LIVE_FIRST else new
    return both.select(key, *[out.get(c, F.col(f"d.{c}")).alias(c) for c in df.columns if c != key], *[out[c].alias(c) for c in names if c not in df.columns])


def finite(df: DataFrame, features: list[str]) -> DataFrame:
    """NULL, NaN and infinite values as 0."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({f: F.coalesce(F.when(~bad(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(0.0)) for f in features})


def label_column(columns: list[str]) -> str | None:
    """The first known name of a label among ``columns``."""
    return next((n for n in LABEL_NAMES if n in columns), None)


def strict_label(df: DataFrame, column: str) -> Column:
    """0 or 1: spellings of a text, or a number cut to an integer; raises on anything else, NULL and NaN included."""
    c = F.col(column)
    y = binary_label(c)
    if df.schema[column].dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal"):
        n = c.cast("double").cast("int")
        y = F.when(c.isNotNull() & ~F.isnan(c.cast("double")) & n.isin(0, 1), n)
    return F.when(y.isNotNull(), y).otherwise(F.raise_error(F.concat(F.lit("not a label: "), F.coalesce(c.cast("string"), F.lit("NULL")))).cast("int"))


def adapter_label(df: DataFrame, column: str) -> DataFrame:
    """``column`` as integer ``label``, also from 1.0 and 0.0; rows of other values go."""
    s = F.lower(F.trim(F.col(f"`{column}`").cast("string")))
    y = F.when(s.isin([*FAKE, "1.0"]) & (s != "y"), 1).when(s.isin([*REAL, "0.0"]) & (s != "n"), 0)
    out = df.withColumn("label", y)
    return (out if column == "label" else out.drop(column)).where("label is not null")


def without_labels(df: DataFrame) -> tuple[list[str], list[str]]:
    """(feature names, label names): labels never are features, and stay on the row for what comes after the score."""
    labels = [c for c in df.columns if c in LABEL_NAMES]
    return [c for c in df.columns if c not in labels], labels


def scale_features(base: dict[str, Column], prefix: str = "") -> dict[str, Column]:
    """Features that tell public figures from bots of the same ratios, from followers, following, posts, account_age_days and is_verified."""
    f, g, p, d = (number(base[c]) for c in ("followers", "following", "posts", "account_age_days"))
    verified = base["is_verified"] == 1
    log = F.log10(F.greatest(f, F.lit(1.0)))
    step = F.when(f < 100, 0)
    for k, top in enumerate((1e3, 1e4, 1e5, 1e6, 1e7), 1):
        step = step.when(f < top, k)
    aged = lambda x: F.when(d > 0, x).otherwise(0.0)
    maturity = F.when((d >= 1825) & (f >= 100_000), 1.0).when((d >= 730) & (f >= 10_000), 0.7).when((d >= 365) & (f >= 1_000), 0.4).otherwise(0.1)
    cols = {"log_followers": F.round(log, 4), "followers_tier": step.otherwise(6), "is_celebrity_scale": (f >= 500_000).cast("int"), "posts_per_follower": F.round(p / F.greatest(f, F.lit(1.0)), 4),
            "follower_per_day": F.round(aged(f / d), 4), "posts_per_year": F.round(aged(p / d * 365), 4), "following_capped_1000": (g <= 1000).cast("int"), "following_capped_5000": (g <= 5000).cast("int"),
            "normalized_ratio": F.round(f / F.greatest(g, F.lit(1.0)) / F.greatest(log, F.lit(1.0)), 4), "verified_celebrity": (verified & (f >= 100_000)).cast("int"),
            "verified_micro": (verified & (f < 100_000)).cast("int"), "account_maturity_score": maturity}
    return {prefix + k: v for k, v in cols.items()}
