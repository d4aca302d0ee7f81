"""Filling and scaling of numeric features by exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.operators.quantiles import medians, quantiles

# Columns whose values follow power laws.
POWER_LAW = ["followers", "following", "posts", "tweets", "subscribers", "total_views", "snap_score", "post_karma", "comment_karma", "total_likes", "total_stars", "listed_count", "friends", "videos", "likes"]


def is_power_law(name: str) -> bool:
    return name.lower() in POWER_LAW


def logged(name: str) -> Column:
    """log(1 + x) of a column of power-law values, negative ones as 0; other columns as they are."""
    c = F.col(name).cast("double")
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0)))) if is_power_law(name) else c


def scaled(df: DataFrame, features: list[str], key: str) -> DataFrame:
    """(key, feature, logged, scaled, centred): values after the log step, over their interquartile range, and so less their median.

    A range of 0 counts as 1. NULL stays NULL; a feature without values has no rows.
    """
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), logged(f).alias("logged")) for f in features])).alias("_f")).select(key, "_f.*")
    q = quantiles(long, "logged", [0.25, 0.5, 0.75], ["feature"]).select("feature", F.col("q")[1].alias("_m"), (F.col("q")[2] - F.col("q")[0]).alias("_r"))
    r = F.when(F.col("_r") == 0, 1.0).otherwise(F.col("_r"))
    return long.join(q, "feature").select(key, "feature", "logged", (F.col("logged") / r).alias("scaled"), ((F.col("logged") - F.col("_m")) / r).alias("centred"))


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with the medians of ``features`` where they are NULL; a feature without values stays NULL."""
    found = {r["feature"]: r["median"] for r in medians(df, features).collect()}  # a number a feature
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(found.get(f)).cast("double")) for f in features})
