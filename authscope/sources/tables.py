"""Readers and writers of account tables: headers, unions of files, JSON envelopes, expected columns, results, logs, reports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def normal_headers(df: DataFrame) -> DataFrame:
    """Column names without outer white space, in lower case."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return normal_headers(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path))


def union(*tables: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def profiles_of(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A row for each profile of a JSON text ``{"profiles": [...]}``; texts that don't parse have none."""
    return df.select(F.explode(F.from_json(column, f"struct<profiles: array<struct<{schema}>>>").profiles).alias("p")).select("p.*")


def missing_columns(catalogue: DataFrame, expected: dict[str, list[str]]) -> DataFrame:
    """(path, missing): expected columns that a file of ``catalogue(path, platform, columns)`` lacks."""
    known = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wanted = F.coalesce(F.try_element_at(known, F.col("platform")), F.array().cast("array<string>"))
    return catalogue.select("path", F.array_except(wanted, F.transform("columns", lambda c: F.lower(F.trim(c)))).alias("missing"))


def write_results(df: DataFrame, path: str, by: str = "platform") -> None:
    """All columns as Parquet, a folder for each ``by``."""
    df.write.mode("append").partitionBy(by).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under that of spark.checkpoint.dir; under a local one only where the session names none and runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_training_set(df: DataFrame, path: str, keep: str | None = None) -> None:
    """A table that training reads again: whole, in place of what was there."""
    (df if keep is None else df.where(keep)).write.mode("overwrite").parquet(path)


def audit_rows(df: DataFrame, features: list[str], as_of: str) -> DataFrame:
    """Rows of the prediction log: who, what was decided, how deep, and the features as JSON."""
    packed = F.to_json(F.struct(*features))
    return df.select("username", "platform", "prediction", "confidence", F.lit("quick").alias("analysis_depth"), packed.alias("features_json"), F.lit(as_of).cast("timestamp").alias("created_at"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def report(df: DataFrame, features: list[str]) -> dict[str, DataFrame]:
    """The three tables of a report: summary, predictions, feature statistics."""
    total = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == "Fake").alias("n_fake"), F.round(100 * F.avg((F.col("prediction") == "Fake").cast("int")), 1).alias("fake_rate"), F.round(F.avg("confidence"), 2).alias("mean_confidence"))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])).alias("f")).select("f.*")
    stats = long.groupBy("feature").agg(F.round(F.avg("v"), 3).alias("mean"), F.round(F.stddev_samp("v"), 3).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.round(100 * F.avg(F.col("v").isNull().cast("int")), 2).alias("missing_pct"))
    return {"summary": total, "predictions": df, "statistics": stats}


def settled(df: DataFrame) -> DataFrame:
    """Cuts lineage: written once in the shared folder and read back, so lost executors lose nothing and random choices stay."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within ``keys`` by ``order``, and ``{out}_of``, the key's number of rows.

    Rows are dealt by ranges of (keys, order), so no task gets more than a range; only the ranges' counts, a row each, are added up.
    """
    rows = settled(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    counts = counts.select(*keys, "_range", F.sum("_n").over(w).alias(f"{out}_of"), (F.sum("_n").over(w.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(counts, [*keys, "_range"]).withColumn(out, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
