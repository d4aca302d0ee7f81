"""Calibration and validation folds in single distributed passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authscope.sources import tables

#: Temperatures tried: 0.3 to 2.9 by 0.1.
GRID = [i / 10 for i in range(3, 30)]


def brier(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.avg(F.pow(F.col("raw_proba") - F.col("y"), 2)), 6).alias("brier"))


def temperature(df: DataFrame) -> DataFrame:
    """(temperature, brier) of every grid value; the grid is a literal array, so no row meets another."""
    p = F.least(F.greatest("raw_proba", F.lit(1e-6)), F.lit(1 - 1e-6))
    tried = df.select("y", p.alias("p"), F.explode(F.array(*map(F.lit, GRID))).alias("temperature"))
    q = 1 / (1 + F.exp(-F.log(F.col("p") / (1 - F.col("p"))) / F.col("temperature")))
    return tried.groupBy("temperature").agg(F.round(F.avg(F.pow(q - F.col("y"), 2)), 6).alias("brier"))


def folds(df: DataFrame, k: int, key: str = "account_id") -> DataFrame:
    """Stratified folds: numbered within the label by key."""
    return tables.numbered(df, ["y"], [key], "_r").withColumn("fold", (F.col("_r") % k).cast("int")).drop("_r", "_r_of")


def expanding_folds(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """Temporal folds: ``bucket`` 1 to k + 1 by ``order``, as even as can be, larger ones first. Split i trains on buckets up to i and tests on i + 1."""
    rows, n = tables.numbered(df, [], order, "_r"), k + 1
    size, more = F.floor(F.col("_r_of") / n), F.col("_r_of") % n
    first = more * (size + 1)
    bucket = F.when(F.col("_r") < first, F.floor(F.col("_r") / (size + 1))).otherwise(more + F.floor((F.col("_r") - first) / F.greatest(size, F.lit(1))))
    return rows.withColumn("bucket", (bucket + 1).cast("int")).drop("_r", "_r_of")


def class_weights(df: DataFrame) -> DataFrame:
    counts = df.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("y", "n", F.round(F.sum("n").over(Window.partitionBy()) / (2 * F.col("n")), 6).alias("weight"))
