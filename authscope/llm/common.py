"""Pieces that several corpus operators share: checkpoints, ordered prefix sums, components, batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the session names none and runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jsc.get() if jsc.isDefined() else None
        if found is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = found or tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go as soon as its result is written: nothing reads them again, as lineage is cut there."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Cuts lineage: writes a table in the shared folder once and reads it, so a lost executor loses nothing.

    checkpoint() would run the last stage twice and keep a task for each partition; small tables are read by few tasks.
    The folders stay until the one named in spark.checkpoint.dir is cleared, but for those that ``forget`` drops.
    """
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.options(**options).parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def forget(df: DataFrame | None) -> None:
    """Deletes the files of a table that ``cut`` wrote and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
        if folder.rsplit("/", 1)[-1].startswith("cut-"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ordered_prefix(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows of the same ``keys`` that come before by ``order``, then ``value``.

    Rows are dealt by ranges of (keys, order, value), so no task gets more than a range, whatever the ids are like; a key's
    ranges are summed and their totals, one number a range, are added up. NULLs come first. The result has ``df``'s rows.
    """
    by = [*keys, *order, value]
    rows = cut(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    before = (Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(*before)), F.lit(0)))
    inner = Window.partitionBy(*keys, "_range").orderBy(*order, value).rowsBetween(*before)
    rows = rows.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    same = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in [*keys, "_range"]]
    return rows.alias("a").join(totals.alias("b"), same).select("a.*", (F.col("b._before") + F.col("a._inner")).cast("long").alias(out)).drop("_range", "_inner")


#: Members of a bucket that one task orders in a linear round.
PART = 4096


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, component), component the smallest node reachable.

    Each round takes the least label among the neighbours and then jumps to the label of that label; both are
    equi-joins with a one-row-a-node side, so a hub splits as any skewed join does. The rounds stop when no label
    changes; their number grows with the logarithm of a chain's length. Joins are by sort and merge: the driver holds no
    broadcast table, however many rounds there are. Raises after ``most`` rounds.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(most):
        near = both.join(labels.hint("merge"), both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near.hint("merge"), labels.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        to = labels.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        step = step.join(to.hint("merge"), step.component == to.n2, "left").select("node", "old", F.least("component", "c2").alias("component"))
        step = cut(step)
        changed = not step.where("old <> component").isEmpty()
        forget(labels)
        labels = step.select("node", "component")
        if not changed:
            forget(both)
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")


def joined_labels(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """(node, component) of the graph of ``labels``' components and the edges ``new(a, b)``; only components move, not the edges before."""
    if labels is None:
        return components(new)
    name = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")).hint("merge")
    both = new.join(name("a"), "a", "left").join(name("b"), "b", "left")
    met = components(both.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    fresh = new.select(F.col("a").alias("node")).union(new.select("b")).distinct().join(labels.hint("merge"), "node", "left_anti")
    every = labels.union(fresh.select("node", F.col("node").alias("component")))
    to = met.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    out = cut(every.join(to.hint("merge"), "component", "left").select("node", F.coalesce("_to", "component").alias("component")))
    forget(met)
    return out


def linked(
    buckets: DataFrame, attrs: DataFrame, near: Callable[[str, str], Column], load: Callable[[DataFrame], DataFrame], agreed: Callable[[DataFrame], DataFrame], rounds: int = 2,
    narrow: Callable[[DataFrame, DataFrame], DataFrame] | None = None, last: Callable[[str, str, str], Column] | None = None,
) -> DataFrame:
    """Components (node, component) of the graph whose edges are the pairs of ``buckets(k, node)`` that share a k and agree.

    A bucket never gives all its pairs. In each of ``rounds`` a bucket's members, in another order each time, meet the first
    member and the one before them, if they are of other components so far; links that agree make components. A bucket of
    over ``PART`` members is dealt to several tasks for that, anew in each round. Then only members outside
    their bucket's main component meet the bucket's members of other components. A pair left out lies within one component
    already, so no component is lost. ``near(x, y)`` is a cheap necessary condition on two structs of node and
    ``attrs(node, ...)``. ``load`` brings (node, item) of the nodes that share a bucket, once; ``agreed`` keeps the true pairs of (a, b, x, y), x and y
    being their items.
    Before the last meeting ``narrow(placed, items)`` may drop rows of (k, node, n, x, comp) that provably link with nothing in their
    bucket, and add fields to ``x`` for ``near``. ``last(k, x, y)`` is a sharper condition for that meeting: for a true pair it
    holds in one at least of the buckets both share.
    """
    sizes = buckets.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    one = F.struct("node", *[c for c in attrs.columns if c != "node"])
    shared = buckets.join(sizes.hint("merge"), "k")
    shared = cut(shared.join(attrs.select("node", one.alias("x")).hint("merge"), "node").select("k", "node", "n", "x"))
    items = cut(load(shared.select("node").distinct()))
    ends = lambda df: df.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    side = lambda c, v: items.select(F.col("node").alias(c), F.col("item").alias(v)).hint("merge")
    spread = lambda df: df.groupBy("k").agg(F.min("comp").alias("main"), F.max("comp").alias("other")).where("main < other").hint("merge")
    placed, tried, labels = shared.withColumn("comp", F.col("node")), None, None
    for r in range(rounds + 1):
        member = F.struct("x", "comp")
        if r < rounds:
            turn = F.xxhash64("node", F.lit(r))
            by = Window.partitionBy("k", F.pmod(F.shiftright(turn, 7), F.lit(1) + F.floor(F.col("n") / PART))).orderBy(turn, "node")
            met = placed.select("x", "comp", F.first(member).over(by).alias("_y"), F.lag(member).over(by).alias("_z"))
            met = met.select("x", "comp", F.explode(F.array("_y", "_z")).alias("m")).where("m is not null and m.comp <> comp").select("x", F.col("m.x").alias("y"))
        else:
            whole = placed if narrow is None else cut(narrow(placed, items))
            mine = whole.join(spread(whole).drop("other"), "k")
            others = mine.where("comp <> main").select("k", "x", F.col("comp").alias("cx"), "main")
            # two members outside the main component meet once, from the lesser of their components
            met = others.join(whole.select("k", F.col("x").alias("y"), F.col("comp").alias("cy")).hint("merge"), "k").where("cx < cy or cy = main").where(near("x", "y"))
            met = (met if last is None else met.where(last("k", "x", "y"))).select("x", "y")
        pairs = ends(met.where(near("x", "y")))
        pairs = cut(pairs if tried is None else pairs.join(tried.hint("merge"), ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        new = cut(agreed(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")).select("a", "b"))
        if r == rounds and narrow is not None:
            forget(whole)
        if new.isEmpty():
            continue  # the whole meeting comes after the linear rounds, also if the last of them found nothing
        before, labels = labels, joined_labels(labels, new)
        forget(before)
        if r < rounds:
            gone = placed
            placed = shared.join(labels.hint("merge"), "node", "left").select("k", "node", "n", "x", F.coalesce("component", "node").alias("comp"))
            placed = cut(placed.join(spread(placed).select("k"), "k").select("k", "node", "n", "x", "comp"))
            if r:
                forget(gone)
    forget(items)
    if labels is None:
        return shared.select("node", F.col("node").alias("component")).where("false")
    forget(shared)
    forget(tried)
    return labels


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that ``column`` holds about ``most`` bytes in each; a longer single row stays whole."""
    for batch in batches:
        at, size = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for k, n in enumerate(sizes):
            if size and size + n > most:
                yield batch.slice(at, k - at)
                at, size = k, 0
            size += n
        if at < batch.num_rows:
            yield batch.slice(at)


def hex_of(c: Column) -> Column:
    return F.lower(F.hex(c))
