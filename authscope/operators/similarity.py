"""Similarity joins by inverted index, small dimension tables and Hamming bands."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of a part of the tables of hashes.
PART = 1_000_000


def closest(df: DataFrame, names: list[str], col: str = "username") -> DataFrame:
    """(account_id, brand, distance): nearest of a fixed list by edit distance, the first of equals. The list is part of the expression."""
    options = F.array(*[F.struct(F.levenshtein(F.lower(col), F.lit(n)).alias("distance"), F.lit(i).alias("at"), F.lit(n).alias("brand")) for i, n in enumerate(names)])
    return df.withColumn("_m", F.array_min(options)).select("account_id", F.col("_m.brand").alias("brand"), F.col("_m.distance").alias("distance"))


def codes(text: str) -> np.ndarray:
    """The distinct runs of three code points of ``text`` as sorted numbers."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def template_similarity(df: DataFrame, templates: list[str], col: str = "bio") -> DataFrame:
    """(account_id, similarity): the greatest likeness of a text's lower-case trigrams to those of a fixed list of texts, within the row."""
    known = [codes(t.strip(" ").lower()) for t in templates]

    @F.pandas_udf("double")
    def best(texts: pd.Series) -> pd.Series:
        def one(text: str) -> float:
            own = codes(text)
            met = [len(np.intersect1d(own, k, assume_unique=True)) for k in known]
            return max((m / (len(own) + len(k) - m) if len(own) + len(k) else 0.0 for m, k in zip(met, known)), default=0.0)

        return texts.map(one).astype(float)

    return df.select("account_id", F.round(best(F.lower(F.trim(F.coalesce(col, F.lit(""))))), 4).alias("similarity"))


def sign_hashes(embeddings: DataFrame) -> DataFrame:
    """(vec_id, phash): the signs of 64 values as a 64-bit number."""
    bits = F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    return embeddings.select("vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).alias("phash"))


def block_count(n: int, radius: int, most: int = 14) -> int:
    """The least number of blocks whose tables have keys of log2(n) bits or more, so that a bucket holds about one of ``n`` random hashes."""
    return next((b for b in range(radius + 2, most) if 64 * (b - radius) // b >= math.log2(max(2, n))), most)


def hamming_tried(df: DataFrame, radius: int, blocks: int | None, by: tuple[str, ...]) -> DataFrame:
    """(a, b, distance) of the pairs of distinct hashes, of the same ``by``, that are compared; ``hamming_links`` are those within ``radius``.

    Every choice of so many blocks is a table, keyed by all of them; the number of blocks, and with it the width of the keys,
    grows with the number of hashes, so the pairs tried grow in proportion to them. Equal hashes stand as their smallest id.
    Hashes within ``radius`` bits have at least ``blocks - radius`` blocks in common, so they are compared.
    """
    rep = df.groupBy(*by, "phash").agg(F.min("vec_id").alias("id"))
    n = rep.count()
    blocks = blocks or block_count(n, radius)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in kept)) for kept in combinations(range(blocks), blocks - radius)]
    keys = F.array(*[F.struct(F.lit(k).alias("table"), F.col("phash").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(masks)])
    parts = 1 + n * len(masks) // PART
    rep = rep.repartition(parts, "id")  # by number: small as they are, the hashes would else be one task, and all their tables
    keyed = rep.select("id", "phash", *by, F.explode(keys).alias("k")).select("id", "phash", *by, "k.table", "k.key").repartition(parts, *by, "table", "key")  # as many parts as the tables' rows need: a task sorts one
    a, b, apart = keyed.alias("a"), keyed.alias("b"), F.col("a.phash").bitwiseXOR(F.col("b.phash"))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*by, "table", "key")])
    # merge: the rows stand so many times as there are tables, which the size of ``rep`` doesn't show: a broadcast would take them all through the driver
    return a.join(b.hint("merge"), same & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.bit_count(apart).alias("distance"))


def hamming_links(df: DataFrame, radius: int = 7, blocks: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, distance) of distinct hashes within ``radius`` bits, of the same ``by``."""
    return hamming_tried(df, radius, blocks, by).where(F.col("distance") <= radius).distinct()


def stock_photos(df: DataFrame, radius: int = 7) -> DataFrame:
    """(vec_id, seen, stock_score, is_stock): on how many profiles an avatar or one within ``radius`` bits stands."""
    same = df.groupBy("phash").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    links = hamming_links(df, radius)
    both = links.select("a", "b").union(links.select("b", "a"))
    near = both.join(same.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    seen = (F.col("n") + F.coalesce("others", F.lit(0))).alias("seen")
    counted = same.join(near, "id", "left").select("phash", seen)
    return df.join(counted, "phash").select("vec_id", "seen", F.round(F.least((F.col("seen") - 1) / 5, F.lit(1.0)), 4).alias("stock_score"), (F.col("seen") > 3).cast("int").alias("is_stock"))


def default_avatars(df: DataFrame, defaults: list[int], radius: int = 10) -> DataFrame:
    """(vec_id, is_default): within less than ``radius`` bits of one of a fixed list of hashes. The list is part of the expression."""
    near = [F.bit_count(F.col("phash").bitwiseXOR(F.lit(d).cast("long"))) < radius for d in defaults]
    return df.select("vec_id", reduce(lambda x, y: x | y, near, F.lit(False)).cast("int").alias("is_default"))
