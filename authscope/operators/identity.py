"""One person's accounts on several platforms: how well they fit together."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authscope.operators.writing import name_likeness


def likeness(bios: list[dict]) -> float:
    """The sum of the cosines of the word counts of each two platforms; words are separated by spaces."""
    counts: dict[str, Counter] = {}
    for b in bios:
        if b["platform"] is not None and b["words"]:
            counts.setdefault(b["platform"], Counter()).update(b["words"].split(" "))
    size = {p: math.sqrt(sum(n * n for n in c.values())) for p, c in counts.items()}
    return sum(sum(n * counts[q][t] for t, n in counts[p].items() if t in counts[q]) / (size[p] * size[q]) for p, q in combinations(sorted(counts), 2))


def pair_likeness(accounts: DataFrame, key: str = "identity") -> DataFrame:
    """(key, bio_similarity): mean cosine of word counts over all pairs of an identity's bios; accounts without a bio take no part.

    The bios of an identity, one a platform, meet in one place; their words are never rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([likeness(x.as_py()) for x in b.column("_b")], pa.float64()), b.column("n")], [key, "total", "n"])

    words = F.array_join(F.regexp_extract_all(F.lower("bio"), F.lit("[a-z0-9_]+"), F.lit(0)), " ")
    bios = accounts.where("coalesce(bio, '') <> ''").select(key, F.struct("platform", words.alias("words")).alias("_b")).groupBy(key).agg(F.collect_list("_b").alias("_b"), F.count(F.lit(1)).alias("n"))
    met = bios.mapInArrow(run, f"{key} {accounts.schema[key].dataType.simpleString()}, total double, n long")
    return met.select(key, F.coalesce(F.try_divide(F.col("total"), F.col("n") * (F.col("n") - 1) / 2), F.lit(1.0)).alias("bio_similarity"))


def consistency(accounts: DataFrame, asked: DataFrame, checked: int, key: str = "identity") -> DataFrame:
    """Scores of ``accounts(identity, platform, username, bio, followers, account_age_days)`` beside the account ``asked(identity, username)`` was found by.

    Followers: 1 less a fifth of the range of their decimal logarithms; ages: the least difference in years, at most 1; names: mean likeness to the
    asked one. A part with too little to tell is 1; an identity found nowhere comes to 0.5.
    """
    logs = F.when(F.col("followers") > 0, F.log10(F.col("followers") + 1.0))
    age = F.when(F.col("account_age_days") > 0, F.col("account_age_days"))
    gap = age - F.lag(age).over(Window.partitionBy(key).orderBy(age.asc_nulls_first(), "platform"))
    rows = accounts.withColumns({"_log": logs, "_gap": gap}).join(asked.select(key, F.col("username").alias("_asked")), key)
    per = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("found"), F.when(F.count("_log") >= 2, F.greatest(F.lit(0.0), 1 - (F.max("_log") - F.min("_log")) / 5)).otherwise(1.0).alias("followers"), F.coalesce(F.least(F.min("_gap") / 365, F.lit(1.0)), F.lit(1.0)).alias("ages"),
        F.avg(name_likeness(F.lower("_asked"), F.lower("username"))).alias("names"),
    )
    out = asked.select(key).join(per, key, "left").join(pair_likeness(accounts, key), key, "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    found = F.coalesce("found", F.lit(0))
    overall = 0.30 * one("bio_similarity") + 0.25 * one("followers") + 0.25 * one("ages") + 0.20 * one("names")
    return out.select(
        key, found.alias("platforms_found"), F.round(found / checked, 4).alias("presence_ratio"), F.round(one("bio_similarity"), 4).alias("bio_similarity"), F.round(one("followers"), 4).alias("follower_consistency"), F.round(one("ages"), 4).alias("age_consistency"),
        F.round(one("names"), 4).alias("name_similarity"), F.round(F.when(found > 0, overall).otherwise(0.5), 4).alias("overall"),
    )
