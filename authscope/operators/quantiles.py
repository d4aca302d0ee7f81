"""Exact quantiles in which no task reads a whole group: histograms narrow each rank to a few values, only those are sorted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authscope.sources.tables import settled

#: Values of a bracket that one task may sort.
SMALL = 10_000
#: Intervals that a bracket is divided into; their borders are approximate quantiles of it, so each round leaves about one in so many.
BINS = 64


def _same(a: str, b: str, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def _inside(values: DataFrame, open_: DataFrame, by: list[str]) -> DataFrame:
    """Values that lie in a bracket some rank is looked for in, with the bracket."""
    brackets = open_.select(*by, "lo", "hi", "first").distinct()
    met = values.alias("v").join(brackets.alias("b"), _same("v", "b", by) & F.col("_v").between(F.col("lo"), F.col("hi")))
    return met.select("b.*", "_v")


def _narrowed(values: DataFrame, open_: DataFrame, by: list[str]) -> DataFrame:
    """Each rank with the interval of its bracket that it falls into; an interval's ends are values."""
    inside, bracket = _inside(values, open_, by), [*by, "lo", "hi", "first"]
    borders = settled(inside.groupBy(*bracket).agg(F.percentile_approx("_v", F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), 1000).alias("_borders")))  # a row a bracket
    # a border is a value of the bracket and an interval of its own, so that each round divides every bracket
    place = F.size(F.filter("_borders", lambda x: x < F.col("_v"))) + F.size(F.filter("_borders", lambda x: x <= F.col("_v")))
    met = inside.alias("v").join(borders.alias("b"), _same("v", "b", bracket)).select("v.*", place.alias("at"))
    counts = met.groupBy(*bracket, "at").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    before = Window.partitionBy(*bracket).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # 2 BINS rows at most
    counts = counts.withColumn("_first", F.col("first") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    hit = _same("o", "c", bracket) & (F.col("o.rank") >= F.col("c._first")) & (F.col("o.rank") < F.col("c._first") + F.col("c.n"))
    return settled(open_.alias("o").join(counts.alias("c"), hit).select(*[F.col(f"o.{n}") for n in by], "o.rank", F.col("c._lo").alias("lo"), F.col("c._hi").alias("hi"), F.col("c._first").alias("first"), F.col("c.n").alias("n")))


def at_ranks(values: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """(by, rank, value): of ``values(by, _v)``, the value at each of ``ranks(by, rank, lo, hi, first, n)``, counted from 0.

    A bracket of a single value is done, however often it stands. Others are divided until they hold ``SMALL`` values at most, which
    are then sorted. A round sums counts in each task, so what is shuffled does not grow with the values.
    """
    done, open_ = [], settled(ranks)
    while True:
        done.append(open_.where("lo = hi").select(*by, "rank", F.col("lo").alias("value")))
        few = open_.where(f"lo < hi and n <= {SMALL}")
        lists = _inside(values, few, by).groupBy(*by, "lo", "hi", "first").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        met = few.alias("o").join(lists.alias("l"), _same("o", "l", [*by, "lo", "hi", "first"]))
        done.append(met.select(*[F.col(f"o.{n}") for n in by], "o.rank", F.get("_all", (F.col("o.rank") - F.col("o.first")).cast("int")).alias("value")))
        many = open_.where(f"lo < hi and n > {SMALL}")
        if many.isEmpty():
            return reduce(DataFrame.unionByName, done)
        open_ = _narrowed(values, many, by)


def quantiles(df: DataFrame, value: Column | str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, n, q): the number of values and their quantiles at ``shares``, linear between neighbours, one row a group that has values.

    NULL and NaN are no values. Groups may be NULL. ``by`` may be empty: then there is one row, of no values if there are none.
    """
    names = by or ["_all_rows"]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*(by or [F.lit(1).alias("_all_rows")]), v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = settled(rows)
    ends = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    wanted = F.array(*[f(place(p)).cast("long") for p in shares for f in (F.floor, F.ceil)])
    ranks = ends.select(*names, F.explode(F.array_distinct(wanted)).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("first"), "n")
    found = at_ranks(rows, ranks, names).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))  # two entries a share
    low, high = (lambda p, f=f: F.element_at("_m", f(place(p)).cast("long")) for f in (F.floor, F.ceil))
    q = F.array(*[low(p) + (high(p) - low(p)) * (place(p) - F.floor(place(p))) for p in shares])
    out = ends.alias("e").join(found.alias("f"), _same("e", "f", names)).select(*[F.col(f"e.{n}") for n in names], "e.n", q.alias("q"))
    if by:
        return out
    nothing = df.sparkSession.createDataFrame([(1,)], "_one int")
    return nothing.join(out, F.lit(True), "left").select(F.coalesce("n", F.lit(0)).alias("n"), "q")  # one row each


def medians(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, feature, n, median) of each of ``columns`` that has values in a group."""
    long = df.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_x")) for c in columns])).alias("_f")).select(*(by or []), "_f.feature", "_f._x")
    return quantiles(long, "_x", [0.5], [*(by or []), "feature"]).select(*(by or []), "feature", "n", F.col("q")[0].alias("median"))
