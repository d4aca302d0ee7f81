"""Wording of names, bios and posts: spam words, invisible characters, capitals, reposts, dictionary and topic overlap."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.functions import text as T
from authscope.sources import tables

# Spam words by weight, invisible code points, openings of a repost.
SPAM_WORDS = {
    3: ["airdrop", "whitelist", "giveaway", "dm for", "send dm", "forex", "binary options", "passive income", "financial freedom", "click link", "limited spots", "act now", "earn daily", "free bitcoin", "free btc", "free eth", "free crypto", "get rich", "make money fast", "easy money", "100% profit", "99% win rate", "investment advisor", "earn while you sleep", "make $", "earn $", "official giveaway"],
    2: ["crypto", "nft", "bitcoin", "btc", "ethereum", "eth", "defi", "web3", "trading", "invest", "profit", "roi", "hodl", "pump", "moon", "tokens", "altcoin", "binance", "coinbase"],
    1: ["follow back", "f4f", "l4l", "collab", "promo", "link in bio", "dm me", "inbox me"],
}
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}\x{2060}-\x{2063}]"
REPOST = r"^(rt |retweet|shared |via @|(rt|repost|share)\b)"


def spam_score(c: Column) -> Column:
    """Weighted spam words found anywhere, by the number of words."""
    low = F.lower(c)
    hits = sum((F.contains(low, F.lit(w)).cast("int") * k for k, words in SPAM_WORDS.items() for w in words), F.lit(0))
    return F.round(hits / F.greatest(F.size(T.words(c)), F.lit(1)), 4)


def caps_ratio(c: Column) -> Column:
    return T.share(T.count(c, r"\p{Lu}"), T.count(c, r"\p{L}"))


def pronounceable(c: Column) -> Column:
    """Changes between vowel and consonant by neighbouring letters; 0.5 below two letters."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z]", ""), "[aeiou]", "1"), "[a-z]", "0")
    n = F.length(s)
    turns = F.length(F.regexp_replace(s, "0+", "0")), F.length(F.regexp_replace(s, "1+", "1"))
    return F.when(n < 2, 0.5).otherwise(F.round((turns[0] + turns[1] - n - 1) / (n - 1), 4))


def bio_record(df: DataFrame) -> DataFrame:
    b = F.coalesce("bio", F.lit(""))
    return df.select("account_id", spam_score(b).alias("spam_score"), T.count(b, INVISIBLE).alias("invisible"), caps_ratio(b).alias("caps_ratio"), pronounceable(F.col("username")).alias("pronounceable"))


def reposts(df: DataFrame) -> DataFrame:
    return df.groupBy("account_id").agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.rlike(F.lower(F.trim("text")), F.lit(REPOST))).alias("reposts"))


def dictionary_coverage(df: DataFrame, words: DataFrame) -> DataFrame:
    """(account_id, coverage): share of a name's parts of two characters or more that stand in ``words(word)``; 0 without any."""
    parts = F.filter(F.split(F.lower("username"), r"[\d_.\-]+"), lambda x: F.length(x) >= 2)
    found = df.select("account_id", F.explode_outer(parts).alias("word")).join(words.select("word", F.lit(1).alias("hit")).distinct(), "word", "left")
    return found.groupBy("account_id").agg(F.round(F.count("hit") / F.greatest(F.count("word"), F.lit(1)), 4).alias("coverage"))


#: Texts of a key up to which they meet in one place.
FEW = 16


def likeness(texts: list[dict]) -> float | None:
    """Cosine of the tf-idf vectors of two texts, the left and the right of the given lists of words, 0 if one has none; None without any word."""
    sides = Counter(), Counter()
    for t in texts:
        if t["words"]:
            sides[t["side"]].update(t["words"].split(" "))
    if not any(sides):
        return None
    rare = math.log(1.5) + 1  # of a word in one of the two texts; in both it is 1
    x, y = (sum(n * n * (1 if w in other else rare * rare) for w, n in own.items()) for own, other in (sides, sides[::-1]))
    return sum(n * sides[1][w] for w, n in sides[0].items() if w in sides[1]) / math.sqrt(x * y) if x and y else 0.0


def topic_similarity(left: DataFrame, right: DataFrame, key: str = "account_id") -> DataFrame:
    """(key, similarity): cosine of the tf-idf vectors of two texts a key has, ``left(key, text)`` and ``right(key, text)``.

    A key's many right texts count as one. Up to ``FEW`` texts of a key meet in one place, words never being rows; of the others the words of both sides
    are counted together.
    """
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    both = left.select(key, "text", F.lit(0).alias("side")).unionByName(right.select(key, "text", F.lit(1).alias("side"))).where(F.col("text").isNotNull())
    large = tables.settled(both.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select(key))
    many = not large.isEmpty()
    some = both.join(large, key, "left_anti") if many else both

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([likeness(x.as_py()) for x in b.column("_t")], pa.float64())], [key, "_c"])

    some = some.select(key, F.struct("side", F.array_join(found, " ").alias("words")).alias("_t")).groupBy(key).agg(F.collect_list("_t").alias("_t"))
    out = some.mapInArrow(run, f"{key} {both.schema[key].dataType.simpleString()}, _c double").where("_c is not null").select(key, F.round("_c", 4).alias("similarity"))
    if not many:
        return out
    words = both.join(large, key, "left_semi")
    words = words.select(key, F.explode(found).alias("t"), (F.col("side") == 0).cast("long").alias("x"), (F.col("side") == 1).cast("long").alias("y")).groupBy(key, "t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    x, y = F.col("x"), F.col("y")
    idf = F.log(F.lit(3.0) / (1 + (x > 0).cast("int") + (y > 0).cast("int"))) + 1
    words = words.select(key, (x * idf).alias("x"), (y * idf).alias("y"))
    sums = words.groupBy(key).agg(F.sum(x * y).alias("d"), F.sum(x * x).alias("a"), F.sum(y * y).alias("b"))
    return out.unionByName(sums.select(key, F.round(F.coalesce(F.try_divide(F.col("d"), F.sqrt(F.col("a") * F.col("b"))), F.lit(0.0)), 4).alias("similarity")))
