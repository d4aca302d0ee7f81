"""Follow-graph operators over edges(src, dst): equi-joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.sources import tables

#: Rows of a part of the edges: what a task sorts or holds, however many edges there are.
PART = 500_000
#: Bits of the ids that one list of neighbours spans, so it has no more of them, whatever a node's degree.
SPAN = 20


def reciprocity(edges: DataFrame) -> DataFrame:
    """(account_id, n_following, n_followers, reciprocity, mutual_ratio)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    both = edges.join(back, ["src", "dst"], "left").groupBy("src").agg(F.count(F.lit(1)).alias("n_following"), F.count("back").alias("mutual"))
    followers = edges.groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("n_followers"))
    n, m, f = F.coalesce("n_following", F.lit(0)), F.coalesce("mutual", F.lit(0)), F.coalesce("n_followers", F.lit(0))
    return both.join(followers, "src", "full").select(F.col("src").alias("account_id"), n.alias("n_following"), f.alias("n_followers"), F.round(m / F.greatest(n, F.lit(1)), 4).alias("reciprocity"), F.round(m / (n + f - m), 4).alias("mutual_ratio"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()


def clustering(edges: DataFrame) -> DataFrame:
    """(account_id, degree, triangles, coefficient). Each edge points from the lesser degree, so lists of neighbours stay short at hubs.

    A node's list is ordered by degree and goes to each node of it as far as it comes after that one, whose own list tells which of
    them close a triangle: an edge is a row, wedges are never rows. A list has the square root of twice the edges as members at most.
    All joins are by sort and merge: files of lists are small, but what is sent of them isn't, and Spark would broadcast it by the files' size.
    """
    e = undirected(edges)
    ends = e.select(F.col("a").alias("n"), F.col("b").alias("m")).union(e.select("b", "a"))
    degree = tables.settled(ends.groupBy("n").agg(F.count(F.lit(1)).alias("degree")))
    d = e.join(degree.select(F.col("n").alias("a"), F.col("degree").alias("da")).hint("merge"), "a").join(degree.select(F.col("n").alias("b"), F.col("degree").alias("db")).hint("merge"), "b")
    swap = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") > F.col("b")))
    one, two = F.struct(F.col("da").alias("d"), F.col("a").alias("n")), F.struct(F.col("db").alias("d"), F.col("b").alias("n"))
    lists = d.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(swap, one).otherwise(two).alias("v")).groupBy("u").agg(F.transform(F.sort_array(F.collect_list("v")), lambda x: x["n"]).alias("vs"))
    lists = tables.settled(lists)
    sent = lists.select("u", "vs", F.posexplode("vs").alias("i", "v")).where(F.col("i") + 1 < F.size("vs")).select("u", "v", F.slice("vs", F.col("i") + 2, F.size("vs")).alias("later"))
    met = sent.join(lists.select(F.col("u").alias("v"), F.col("vs").alias("own")).hint("merge"), "v").select("u", "v", F.array_intersect("later", "own").alias("w")).where(F.size("w") > 0)
    closed = met.select(F.explode(F.concat(F.array(F.struct(F.col("u").alias("n"), F.size("w").alias("k")), F.struct(F.col("v").alias("n"), F.size("w").alias("k"))), F.transform("w", lambda x: F.struct(x.alias("n"), F.lit(1).alias("k"))))).alias("c"))
    closed = closed.groupBy("c.n").agg(F.sum("c.k").alias("t"))
    t = F.coalesce("t", F.lit(0))
    return degree.join(closed.hint("merge"), "n", "left").select(F.col("n").alias("account_id"), "degree", t.alias("triangles"), F.round(F.when(F.col("degree") > 1, 2 * t / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0), 4).alias("coefficient"))


def both_ways(edges: DataFrame) -> tuple[DataFrame, int]:
    """(src, dst) of every edge in both directions, dealt by dst to parts of about ``PART`` rows, and how many parts; copies stay. The edges are written once."""
    edges = tables.settled(edges.select("src", "dst"))
    parts = 1 + 2 * edges.count() // PART
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).repartition(parts, "dst"), parts


def neighbour_share(edges: DataFrame, flags: DataFrame) -> DataFrame:
    """(account_id, share) of distinct neighbours whose ``flags(account_id, flag)`` is 1; absent counts as 0."""
    both, _ = both_ways(edges)
    known = flags.select(F.col("account_id").alias("dst"), "flag").hint("shuffle_hash")
    return both.distinct().join(known, "dst", "left").groupBy(F.col("src").alias("account_id")).agg(F.round(F.avg(F.coalesce("flag", F.lit(0))), 4).alias("share"))


def neighbour_lists(edges: DataFrame) -> tuple[DataFrame, int]:
    """((dst, srcs), parts): each node's distinct neighbours but itself, those of 2 ** ``SPAN`` neighbouring ids a row, and the parts in which rows of single neighbours are dealt."""
    both, parts = both_ways(edges.where("src <> dst"))
    lists = both.groupBy("dst", F.shiftright("src", SPAN).alias("_list")).agg(F.array_distinct(F.collect_list("src")).alias("srcs"))
    return tables.settled(lists.select("dst", "srcs")), parts


def heard(lists: DataFrame, parts: int, labels: DataFrame) -> DataFrame:
    """(src, community): a row for each neighbour of src, with its label; dealt by src. One shuffle of single neighbours."""
    told = labels.select(F.col("account_id").alias("dst"), "community").hint("shuffle_hash")
    return lists.join(told, "dst").select(F.explode("srcs").alias("src"), "community").repartition(parts, "src")


def communities(lists: DataFrame, parts: int, most: int = 10) -> tuple[DataFrame, int, int]:
    """((account_id, community), rounds, changed) by label propagation over ``neighbour_lists``: all nodes at once take the most frequent label among their neighbours, the least of equals.

    Labels are first the nodes' own ids, all different, so the first round takes the least neighbour. Rounds end when no label changes, or after
    ``most``, as labels may swing for ever between two sides of a graph; ``changed`` is how many the last round changed, 0 if they have settled.
    """
    if most < 1:
        return lists.select(F.col("dst").alias("account_id"), F.col("dst").alias("community")).distinct(), 0, 1
    labels = tables.settled(lists.groupBy(F.col("dst").alias("account_id")).agg(F.min(F.array_min("srcs")).alias("community")))
    rounds, changed = 1, labels.count()  # no node is its own neighbour
    while changed and rounds < most:
        counts = heard(lists, parts, labels).sortWithinPartitions("src", "community").groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        new = counts.groupBy(F.col("src").alias("account_id")).agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("community"))
        step = tables.settled(new.join(labels.withColumnRenamed("community", "_old").hint("shuffle_hash"), "account_id"))
        changed = step.where("community <> _old").count()
        labels, rounds = step.select("account_id", "community"), rounds + 1
    return labels, rounds, changed


def same_community(lists: DataFrame, parts: int, groups: DataFrame) -> DataFrame:
    """(account_id, share) of the neighbours of ``neighbour_lists`` that are in the account's own community."""
    own = groups.select(F.col("account_id").alias("src"), F.col("community").alias("x")).hint("shuffle_hash")
    return heard(lists, parts, groups).join(own, "src").groupBy(F.col("src").alias("account_id")).agg(F.round(F.avg((F.col("x") == F.col("community")).cast("int")), 4).alias("share"))
