"""Monitoring: accuracy, agreement, dataset statistics and drift, in single passes of partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authscope.operators.quantiles import medians, quantiles


def confusion(df: DataFrame, pred: str = "pred", label: str = "y") -> DataFrame:
    """One row of counts and metrics; division by zero gives 0."""
    p, y = F.col(pred) == 1, F.col(label) == 1
    c = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", F.round(ratio(tp + tn, tp + fp + fn + tn), 4).alias("accuracy"), F.round(ratio(tp, tp + fp), 4).alias("precision"), F.round(ratio(tp, tp + fn), 4).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"))


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, missing_pct, mean, std, min, max, median) of each column."""
    long = df.unpivot([], columns, "feature", "value")
    v = F.col("value")
    rows = long.groupBy("feature").agg(F.count(v).alias("n"), F.round(100 * F.avg(v.isNull().cast("int")), 2).alias("missing_pct"), F.round(F.avg(v), 3).alias("mean"), F.round(F.stddev_samp(v), 3).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return rows.join(medians(df, columns).select("feature", F.round("median", 3).alias("median")), "feature", "left")


def confidence_spread(df: DataFrame, by: str, confidence: str = "confidence", low: float = 60) -> DataFrame:
    """(by, n, mean, median, low, low_pct) of the confidence; low is below 60."""
    c = F.col(confidence)
    rows = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.count_if(c < low).alias("low"), F.round(100 * F.avg((c < low).cast("int")), 2).alias("low_pct"))
    middle = quantiles(df, confidence, [0.5], [by]).select(F.col(by).alias("_by"), F.round(F.col("q")[0], 4).alias("median"))
    return rows.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "mean", "median", "low", "low_pct")


def psi(df: DataFrame, side: str, columns: list[str], bins: int = 10) -> DataFrame:
    """(feature, psi) between the rows of side 'train' and 'recent', on joint equal-width bins."""
    long = df.unpivot([side], columns, "feature", "v").where("v is not null")
    ends = long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # a row a feature is sent to all tasks: joined by a shuffle, all values of a feature would be one task's
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    counts = long.join(F.broadcast(ends), "feature").groupBy("feature", at.alias("bin")).agg(F.count_if(F.col(side) == "train").alias("e"), F.count_if(F.col(side) == "recent").alias("a"))
    w = Window.partitionBy("feature")
    e, a = F.col("e") / F.sum("e").over(w), F.col("a") / F.sum("a").over(w)
    counts = counts.select("feature", e.alias("e"), a.alias("a"))
    return counts.groupBy("feature").agg(F.greatest(F.round(F.sum((F.col("a") - F.col("e")) * F.log((F.col("a") + 1e-9) / (F.col("e") + 1e-9))), 6), F.lit(0.0)).alias("psi"))


def drift_level(df: DataFrame) -> DataFrame:
    return df.withColumn("level", F.when(F.col("psi") < 0.1, "ok").when(F.col("psi") < 0.2, "warn").otherwise("alert"))


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: rows in both tables and the per cent on which their predictions agree."""
    both = a.select(key, F.col("prediction").alias("x")).join(b.select(key, F.col("prediction").alias("y")), key)
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.col("x") == F.col("y")).cast("int")), 2).alias("agreement"))


def last(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


#: Columns that are results, not features.
NOT_FEATURES = ["label", "prediction", "confidence", "anomaly", "anomaly_score", "is_fake", "fake", "target", "is_bot", "bot"]


def feature_drift(train: DataFrame, recent: DataFrame) -> DataFrame:
    """(feature, psi, level) of the numeric columns both tables have, with ten values in the one and five in the other at least."""
    numeric = lambda df: {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")} - set(NOT_FEATURES)
    shared = sorted(numeric(train) & numeric(recent))
    pick = lambda df, side: df.select(F.lit(side).alias("side"), *[F.col(c).cast("double").alias(c) for c in shared])
    both = pick(train, "train").unionByName(pick(recent, "recent"))
    there = both.unpivot(["side"], shared, "feature", "v").where("v is not null").groupBy("feature").agg(F.count_if(F.col("side") == "train").alias("n"), F.count_if(F.col("side") == "recent").alias("m"))
    return drift_level(psi(both, "side", shared).join(there.where("n >= 10 and m >= 5").select("feature"), "feature"))


def drift_summary(drift: DataFrame) -> DataFrame:
    """One row: the largest psi, its level, the features beyond 0.1, and whether to train again."""
    one = drift.agg(F.max("psi").alias("psi"), F.array_sort(F.collect_list(F.when(F.col("psi") >= 0.1, F.col("feature")))).alias("drifted"))  # a row a feature
    return drift_level(one).select(F.col("psi").alias("max_psi"), "level", "drifted", (F.col("psi") >= 0.2).alias("retrain"))
