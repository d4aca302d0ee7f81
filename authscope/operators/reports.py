"""Report tables: rates, histograms, correlations, histories, registries; each is one or two grouped aggregations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authscope.operators.quantiles import medians


def fake_rate(df: DataFrame, by: str, flag: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(flag.cast("int")), 1).alias("fake_rate"))


def net_errors(df: DataFrame, truth: str = "y", pred: str = "pred") -> DataFrame:
    """How far the predicted class totals are from the true ones, and as shares of the true ones."""
    fake, called = F.sum(truth), F.sum(pred)
    n = F.count(F.lit(1))
    sums = df.agg(n.alias("n"), fake.alias("fake"), called.alias("called"))
    missed, wrong = F.greatest(F.col("fake") - F.col("called"), F.lit(0)), F.greatest(F.col("called") - F.col("fake"), F.lit(0))
    rate = lambda a, b: F.round(F.when(b > 0, 100 * a / b).otherwise(0.0), 2)
    return sums.select("n", missed.alias("net_missed"), wrong.alias("net_wrong"), rate(missed, F.col("fake")).alias("missed_rate"), rate(wrong, F.col("n") - F.col("fake")).alias("wrong_rate"))


def long_form(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(keys, features, "feature", "v")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r) for each two features: one aggregation over the table, whatever its size."""
    pairs = list(combinations(features, 2))
    row = df.agg(*[F.round(F.corr(a, b), 6).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("p")).select("p.*")


def histograms(df: DataFrame, cls: str, features: list[str], bins: int = 20) -> DataFrame:
    """(feature, class, bin, n, density) over ``bins`` equal widths between a feature's ends; constant features have none."""
    rows = long_form(df.where(F.col(cls).isNotNull()), [cls], features).where("v is not null")
    ends = rows.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("hi > lo")
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    # one row a feature: the list of features bounds the broadcast
    counts = rows.join(F.broadcast(ends), "feature").groupBy("feature", cls, at.alias("bin"), ((F.col("hi") - F.col("lo")) / bins).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature", cls))
    return counts.select("feature", cls, "bin", "n", F.round(F.col("n") / (total * F.col("width")), 9).alias("density"))


def platform_defaults(df: DataFrame, features: list[str], fixed: dict[str, float], by: str = "platform") -> DataFrame:
    """Medians over the legit rows of each platform, over fixed defaults where there are none."""
    legit = medians(df.where("y = 0"), features, [by]).groupBy(by).agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in features])
    mine = df.select(F.col(by).alias("_by")).distinct().join(legit, F.col(by).eqNullSafe(F.col("_by")), "left")
    return mine.select(F.col("_by").alias(by), *[F.coalesce(c, F.lit(fixed.get(c, 0.0))).alias(c) for c in features])


def totals(df: DataFrame, by: str, corrected: Column, pending: Column) -> DataFrame:
    """Feedback by platform, and all of it under 'all': one rollup."""
    name = F.when(F.grouping(by) == 1, "all").otherwise(F.col(by))
    return df.rollup(by).agg(name.alias("segment"), F.count(F.lit(1)).alias("n"), F.count_if(pending).alias("pending"), F.round(F.avg(corrected.cast("int")), 3).alias("correction_rate")).drop(by)


def spine(dim: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Every member of the dimension; numbers it lacks are 0."""
    return dim.join(facts, key, "left").fillna(0)


def capped_history(df: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """The last ``most`` entries of a log for each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def latest_valid(df: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """A cache's entries that hold: the newest of each key, if it has not expired."""
    newest = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("checked_at"), F.desc("expires_at"))))
    return newest.where((F.col("_r") == 1) & (F.col("expires_at") > now)).drop("_r")


def chained(df: DataFrame, cls: str, order: str, size: Column, most: int = 15) -> DataFrame:
    """Up to ``most`` nodes of a class, each linked to the next, with a drawing size between 8 and 40."""
    w = Window.partitionBy(cls).orderBy(order)
    few = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return few.select(cls, order, F.lead(order).over(w).alias("to"), F.round(F.greatest(F.lit(8.0), F.least(F.lit(40.0), 8 + 2 * F.log1p(size))), 4).alias("size"))


def trainable(df: DataFrame, by: str, least: int) -> DataFrame:
    """Enough labelled rows, and both classes."""
    return df.groupBy(by).agg(F.count("y").alias("n"), F.count_distinct("y").alias("classes")).select(by, "n", "classes", ((F.col("n") >= least) & (F.col("classes") == 2)).alias("trainable"))


def absent_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Features without any value, and whether they are too many (over a quarter, one at least)."""
    n = df.agg(*[F.count(c).alias(c) for c in features]).unpivot([], features, "feature", "n").where("n = 0")
    return n.select("feature").withColumn("warn", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > max(1, 0.25 * len(features)))
