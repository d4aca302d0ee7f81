"""Reviews of predictions, what they correct, and logs by key: newest rows, latest record, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, most: int = 500) -> DataFrame:
    return df.orderBy(F.desc("told_at"), "id").limit(most)


def pending(df: DataFrame, most: int = 100) -> DataFrame:
    """Reviews that nobody has looked at, newest first."""
    return newest(df.where(~F.col("is_reviewed")), most)


def corrected(df: DataFrame, platform: str) -> DataFrame:
    return df.where((F.col("platform") == platform) & F.col("corrected_label").isNotNull())


def marked(df: DataFrame, ids: DataFrame) -> DataFrame:
    """All rows, those of ``ids(id)`` as reviewed."""
    seen = ids.select("id", F.lit(True).alias("_seen")).distinct()
    return df.join(seen, "id", "left").withColumn("is_reviewed", F.col("is_reviewed") | F.coalesce("_seen", F.lit(False))).drop("_seen")


def statistics(df: DataFrame) -> DataFrame:
    """(platform, total, pending, correction_rate), and a row for all platforms."""
    changed = F.col("corrected_label").isNotNull() & (F.col("corrected_label") != F.col("predicted_label"))
    out = df.rollup("platform").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_reviewed")).alias("pending"), F.round(F.avg(F.coalesce(changed, F.lit(False)).cast("int")), 3).alias("correction_rate"))
    return out.withColumn("platform", F.coalesce("platform", F.lit("all")))


def binary(c: Column) -> Column:
    return (F.lower(c) == "fake").cast("int")


def unpacked(reviewed: DataFrame, features: str) -> DataFrame:
    """(account_id, features, label) of corrected reviews, their features out of JSON."""
    return reviewed.select("account_id", F.from_json("profile_data_json", features).alias("f"), binary(F.col("corrected_label")).alias("label")).select("account_id", "f.*", "label")


def retraining(reviewed: DataFrame, first: DataFrame, features: str) -> DataFrame:
    """Corrected reviews and the rows of the first training; what a side lacks is NULL."""
    return unpacked(reviewed, features).unionByName(first.withColumn("label", binary(F.col("label"))), allowMissingColumns=True)


def calibration_rows(df: DataFrame) -> DataFrame:
    """(raw_proba, y) of corrected reviews: the confidence in per cent as a probability of Fake."""
    c = F.col("confidence") / 100
    return df.where("corrected_label is not null").select(F.when(F.col("predicted_label") == "Fake", c).otherwise(1 - c).alias("raw_proba"), binary(F.col("corrected_label")).alias("y"))


def latest(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """(key, last, trend): a key's last record, and its last ``most`` in order of time. Rows beyond are dropped before they are gathered."""
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= most)
    record = F.struct(*order, *[c for c in df.columns if c not in (*order, key)])
    return rows.groupBy(key).agg(F.max(record).alias("last"), F.sort_array(F.collect_list(record)).alias("trend"))


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``place`` in a small table, one row a platform."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key)
