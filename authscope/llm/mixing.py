"""Mixing sources to target weights (operator 3), DataFrame functions only.

The words of a source, in order of doc_id, are one stream, cut into blocks of about ``BLOCK`` words (all blocks of a
source differ by one word at most). Output slots come in shards; hashed draws give each shard its multinomial counts of
blocks by source. Running counts over the shards number a source's draws 0, 1, 2, ...; draws past the source's quota are
void and a last shard holds those that chance left out, so that each source ends at its target. A draw's number maps
to a block by a keyed permutation of the source's blocks, anew for each pass over it, so no block is taken twice before
all are taken once. Blocks join documents by (source, block).

Only sizes move, never texts. NULL source is a source of its own, last; NULL and empty texts have size 0 and are never
taken; NULL ids come first in a stream; repeated rows are documents of their own; an empty table gives an empty mix.
Other columns are left out. Hash seeds are fixed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authscope.llm.common import WORD, cut, ordered_prefix, unused

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK = 64
SLOTS = 4096
CELLS = 1024
ROUNDS = 8
SEED = 20_240_601


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_PASSES) -> DataFrame:
    """(source, source_size, target, n_blocks, quota): one row for each source.

    Water filling in closed form: by ascending cap over weight, the first k sources stop at their caps and the rest share
    what is left by weight, for the least k at which none of the rest is above its cap. The windows are over sources.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("w", F.get(turn, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")))
    s = s.withColumns({"cap": F.col("source_size") * float(most), "ratio": F.col("source_size") * float(most) / F.col("w")})
    up = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", left / rest)  # if all before this one are capped and this one is not
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(Window.partitionBy())
    s = s.withColumn("first", first).withColumn("share", F.min(F.when((F.col("level") <= F.col("ratio")) & (F.col("ratio") == F.col("first")), F.col("level"))).over(Window.partitionBy()))
    target = F.least("cap", F.coalesce(F.col("share"), level) * F.col("w"))
    s = s.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0))
    s = s.withColumn("n_blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    quota = F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")), F.col("n_blocks") * most).cast("long")
    return s.select("source", "source_size", "target", "n_blocks", F.when(F.col("source_size") > 0, quota).otherwise(F.lit(0)).cast("long").alias("quota"))


def drawn(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, shard, draws): multinomial counts of each output shard of ``SLOTS`` slots; a slot's uniform hash meets the sources' shares through ``CELLS`` cells."""
    by_name = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("quota").over(Window.partitionBy())
    share = plan.where("quota > 0").withColumns({"hi": F.sum("quota").over(by_name), "total": total}).withColumn("lo", F.col("hi") - F.col("quota"))
    cell = lambda c: F.floor(F.col(c) * CELLS / F.col("total"))
    share = share.select("source", "lo", "hi", F.explode(F.sequence(cell("lo"), F.least(cell("hi"), F.lit(CELLS - 1)))).alias("cell"))
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = plan.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("total")).where("total > 0")
    shards = slots.select("total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / SLOTS))).alias("shard")).repartition(parts, "shard")
    slots = shards.select("total", "shard", F.explode(F.sequence(F.col("shard") * SLOTS, F.least((F.col("shard") + 1) * SLOTS, "total") - 1)).alias("slot"))
    u = F.pmod(F.xxhash64(F.lit(seed), "slot"), F.col("total"))
    slots = slots.select("shard", u.alias("u"), F.least(F.floor(u * CELLS / F.col("total")), F.lit(CELLS - 1)).alias("cell"))
    hit = slots.hint("merge").join(share, "cell").where("u >= lo and u < hi")
    return hit.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("draws"))


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Swap-or-not permutation of 0..n-1 by ``key``: each round may swap x with (k - x) mod n, as a hash of the larger says."""

    def turn(acc: Column, r: Column) -> Column:
        other = F.pmod(r - acc, n)
        return F.when(F.xxhash64(r, F.greatest(acc, other)) > 0, other).otherwise(acc)

    return F.aggregate(F.array(*[F.pmod(F.xxhash64(key, F.lit(r)), n) for r in range(ROUNDS)]), x, turn)


def scheduled(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, source, draw, block): every block taken by the mix; shard -1 holds what the draws left out of the quotas."""
    counts = drawn(plan, seed)
    over = Window.partitionBy("source").orderBy("shard")
    runs = counts.withColumn("hi", F.sum("draws").over(over)).withColumn("lo", F.col("hi") - F.col("draws"))
    totals = counts.groupBy("source").agg(F.sum("draws").alias("lo"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    p = plan.where("quota > 0")
    ruled = runs.alias("r").join(p.alias("p"), same("r", "p")).select("p.*", "r.shard", "r.lo", F.least("r.hi", "p.quota").alias("hi"))
    short = p.alias("p").join(totals.alias("t"), same("p", "t"), "left").select("p.*", F.lit(-1).cast("long").alias("shard"), F.coalesce("t.lo", F.lit(0)).alias("lo"), F.col("p.quota").alias("hi"))
    # a wide range of missing draws is dealt in pieces, so that no task makes them all
    both = ruled.unionByName(short).where("lo < hi")
    pieces = both.withColumn("lo", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(SLOTS)))).withColumn("hi", F.least(F.col("lo") + SLOTS, "hi"))
    draws = pieces.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "lo").withColumn("draw", F.explode(F.sequence("lo", F.col("hi") - 1)))
    turn = F.floor(F.col("draw") / F.col("n_blocks"))
    key = F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull(), turn)
    return draws.select("shard", "source", "draw", permuted(F.pmod("draw", "n_blocks"), F.col("n_blocks"), key).alias("block"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, taken): words of each document in the mix, repeats counted."""
    sizes = cut(sized(df, id_col, text_col, source_col))  # three numbers a row; the texts are read once
    plan = cut(targets(sizes))
    times = scheduled(plan, seed).groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    placed = ordered_prefix(sizes, ["source"], ["id"], "size", "begin")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    placed = placed.alias("d").join(plan.alias("p"), same("d", "p")).select("d.id", "d.source", "d.size", "d.begin", "p.source_size", "p.target", "p.n_blocks")
    # of a source's n blocks, the first size mod n hold a word more than the others
    placed = placed.withColumns({"base": F.expr("source_size div greatest(n_blocks, 1)"), "more": F.expr("source_size % greatest(n_blocks, 1)")})
    edge = lambda k: F.expr(f"({k}) * base + least({k}, more)")
    owner = lambda w: F.expr(f"if({w} < more * (base + 1), ({w}) div (base + 1), more + ({w} - more * (base + 1)) div base)")
    docs = placed.where("size > 0").withColumns({"b0": owner("begin"), "b1": owner("begin + size - 1")})
    docs = docs.withColumn("block", F.explode(F.sequence("b0", "b1")))
    docs = docs.withColumn("part", F.least(edge("block + 1"), F.col("begin") + F.col("size")) - F.greatest(edge("block"), F.col("begin")))
    took = docs.alias("d").join(times.hint("merge").alias("t"), same("d", "t") & (F.col("d.block") == F.col("t.block")), "left")
    keys = ["id", "source", "size", "begin", "source_size", "target"]
    took = took.groupBy(*[f"d.{k}" for k in keys]).agg(F.sum(F.col("part") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    none = placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return took.unionByName(none).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken")


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The documents as whole texts in the mix: a row stays floor(taken / size) times, and once more with the rest's probability by a hash of its id.

    Rows of no words are in no mix. Columns are those of ``df``. Ids should be distinct; rows of equal id share their draws.
    """
    key, rate, times, copy = unused(df, "_id", "_rate", "_times", "_copy")
    taken = mix(df, id_col, text_col, source_col, seed).where("size > 0").groupBy(F.col(id_col).alias(key)).agg((F.sum("taken") / F.sum("size")).alias(rate))
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    often = taken.select(key, (F.floor(rate) + (chance < F.col(rate) - F.floor(rate)).cast("long")).cast("int").alias(times)).where(F.col(times) > 0)
    rows = df.join(often, F.col(id_col).cast("long").eqNullSafe(F.col(key)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).where(F.regexp_count(F.col(text_col), F.lit(WORD)) > 0).select(*df.columns)
