"""Exact quantiles against numpy: ties, wide ranges, few values; brackets small enough that several rounds are needed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from authscope.operators import quantiles

SHARES = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]


def groups():
    r = np.random.default_rng(8)
    return {
        "wide": 2.0 ** r.uniform(-300, 300, 3001), "ties": np.where(r.random(3000) < 0.7, 5.0, r.normal(size=3000)), "one": np.array([3.25]), "two": np.array([-1.0, 2.0]), "same": np.full(2000, -7.5),
        "signs": r.integers(-50, 50, 2500).astype(float), None: r.normal(size=1001),
    }


@pytest.mark.parametrize("small", [3, 40, 10_000])
def test_quantiles_match_sorting(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL", small)
    values = groups()
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("two", None), ("none", None), ("two", float("nan"))]
    df = spark.createDataFrame(rows, "name string, v double").repartition(4)
    got = {r.name: (r.n, r.q) for r in quantiles.quantiles(df, "v", SHARES, ["name"]).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert got[k][0] == len(v) and np.allclose(got[k][1], np.quantile(v, SHARES), rtol=1e-12, atol=0 if k == "wide" else 1e-15), k


def test_quantiles_of_all_rows(spark):
    one = quantiles.quantiles(spark.range(1, 102), "id", [0.25, 0.5]).first()
    assert (one.n, one.q) == (101, [26.0, 51.0])
    nothing = quantiles.quantiles(spark.range(0), "id", [0.5]).collect()
    assert [(r.n, r.q) for r in nothing] == [(0, None)]


def test_medians_of_columns(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("g"), F.col("id").alias("a"), F.when(F.col("id") > 6, F.col("id")).alias("b"), F.lit(None).cast("int").alias("c"))
    got = {(r.g, r.feature): (r.n, r.median) for r in quantiles.medians(df, ["a", "b", "c"], ["g"]).collect()}
    assert got == {(0, "a"): (5, 4.0), (1, "a"): (5, 5.0), (0, "b"): (1, 8.0), (1, "b"): (2, 8.0)}


def test_no_task_takes_a_group(spark, monkeypatch):
    """A group of a million values: what any step groups by rows is a few thousand; only the ranks' brackets are sorted."""
    sorted_rows = []
    inside = quantiles._inside
    monkeypatch.setattr(quantiles, "_inside", lambda v, o, by: (sorted_rows.append((inside(v, o, by).count(), o.first().n)) if not o.isEmpty() and o.first().n <= quantiles.SMALL else None) or inside(v, o, by))
    df = spark.range(1_000_000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("v"))
    one = quantiles.quantiles(df, "v", [0.5]).first()
    assert one.q[0] == df.agg(F.median("v")).first()[0]
    assert sorted_rows and max(n for n, _ in sorted_rows) <= 2 * quantiles.SMALL
