"""Posting rhythm: window functions over (account, time), one shuffle by account shared by all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper ends of the gap bins, in hours.
GAP_BINS = [1 / 60, 5 / 60, 0.5, 2, 6, 24, 72, 168]


def seconds() -> Column:
    return F.unix_micros("ts") / 1e6


def gaps(df: DataFrame, key: str = "account_id") -> DataFrame:
    """Hours since the account's event before; first events have none."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return df.withColumn("gap", (seconds() - F.lag(seconds()).over(w)) / 3600).where("gap is not null")


def gap_statistics(df: DataFrame, key: str = "account_id") -> DataFrame:
    g = F.col("gap")
    return gaps(df, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_gaps"), F.round(F.avg(g), 4).alias("gap_mean"), F.round(F.coalesce(F.stddev_samp(g), F.lit(0.0)), 4).alias("gap_std"), F.count_if(g * 3600 < 60).alias("under_minute"),
        F.round(1 / (1 + F.stddev_pop(g)), 4).alias("regularity"), F.round(F.max(g) / 24, 4).alias("gap_max_days"), F.round(F.var_pop(g), 3).alias("gap_variance"),
    )


def gap_entropy(df: DataFrame, key: str = "account_id") -> DataFrame:
    """Base-2 entropy of the gap bins."""
    b = F.lit(len(GAP_BINS))
    for i, top in list(enumerate(GAP_BINS))[::-1]:
        b = F.when(F.col("gap") < top, i).otherwise(b)
    counts = gaps(df, key).groupBy(key, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    return counts.withColumn("p", p).groupBy(key).agg(F.round(-F.sum(F.col("p") * F.log2("p")), 4).alias("gap_entropy"), F.round(F.sum(F.col("p") * F.col("p")), 4).alias("gap_hhi"))


def daily_rhythm(df: DataFrame, key: str = "account_id") -> DataFrame:
    counts = df.groupBy(key, F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.weekday("ts") >= 5).alias("weekend"))
    counts = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    return counts.groupBy(key).agg(
        F.round(-F.sum(F.col("p") * F.log(F.col("p") + 1e-9)) / F.log(F.lit(24.0)), 4).alias("hour_entropy"), F.count(F.lit(1)).alias("active_hours"),
        F.round(F.sum("weekend") / F.greatest(F.sum("n") - F.sum("weekend"), F.lit(1)), 4).alias("weekend_ratio"), F.round(F.sum(F.when(F.col("h") <= 5, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("night_share"),
    )


def burst_share(df: DataFrame, span: int, least: int, key: str = "account_id") -> DataFrame:
    """Share of events inside any window of ``span`` seconds that starts at an event and holds ``least`` or more."""
    t = F.unix_micros("ts")
    w = Window.partitionBy(key).orderBy("t")
    m = span * 1_000_000
    starts = df.withColumn("t", t).withColumn("start", F.when(F.count(F.lit(1)).over(w.rangeBetween(0, m)) >= least, F.col("t")))
    inside = starts.withColumn("in", F.max("start").over(w.rangeBetween(-m, 0)).isNotNull())
    return inside.groupBy(key).agg(F.round(F.avg(F.col("in").cast("int")), 4).alias("burst_share"))


def trailing(df: DataFrame, keys: list[str], span: int, least: int) -> DataFrame:
    """Events that have ``least`` or more of their keys in the trailing ``span`` seconds, themselves included."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros("ts")).rangeBetween(-span * 1_000_000, 0)
    return df.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= least)
