"""The language of a text by the ranks of its character n-grams against profiles learned from labelled texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authscope.sources.tables import settled

#: Ranks of a profile; a gram that a profile lacks counts as so far out of place.
RANKS = 300
LENGTHS = (1, 2, 3)
#: Words below which a language is not told.
LEAST_WORDS = 3


def held_out(key: Column) -> Column:
    """Three rows of sixteen, by the first digit of the key's MD5."""
    return F.substring(F.md5(key.cast("string").cast("binary")), 1, 1).isin("0", "1", "2")


def gram_counts(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, gram, n): grams of a group's words, which are letters with a space on both sides, lower-cased; single spaces are no grams.

    Words are counted first, so a gram is cut out of a word once, however often and wherever the word stands.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}]+", " ")), " ")
    counted = df.select(*keys, F.explode(words).alias("w")).where("w <> ''").groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("c"))
    w = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    cut = lambda k: F.when(F.length(w) >= k, F.transform(F.sequence(F.lit(1), F.length(w) - k + 1), lambda i: F.substr(w, i, F.lit(k)))).otherwise(F.array())
    grams = counted.select(*keys, "c", F.explode(F.concat(*map(cut, LENGTHS))).alias("gram")).where("gram <> ' '")
    return grams.groupBy(*keys, "gram").agg(F.sum("c").alias("n"))


def ranked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gram, rank): the ``RANKS`` most frequent grams of a group from 1 on, equal ones in order of the gram."""
    by = Window.partitionBy(*keys).orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= RANKS).select(*keys, "gram", "rank")


def profiles(df: DataFrame, language: str = "lang", text: str = "text") -> DataFrame:
    """(language, gram, rank) of labelled texts: ``RANKS`` rows a language."""
    return settled(ranked(gram_counts(df.where(F.col(language).isNotNull()), [language], text), [language]).withColumnRenamed(language, "language"))


def spaced(text: str) -> Column:
    """A text's words, which are letters, lower-cased, with one space between and at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def code(gram: str) -> Column:
    """A gram of up to three characters as a number, in order of the gram: 21 bits for each character's code point and one, 0 for none."""
    point = lambda i: F.when(F.length(gram) >= i, F.ascii(F.substring(gram, i, 1)) + 1).otherwise(0).cast("long")
    return F.call_function("shiftleft", point(1), F.lit(42)) + F.call_function("shiftleft", point(2), F.lit(21)) + point(3)


def text_codes(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of the grams of a spaced text, how often each stands there, and its number of words. A gram holds no inner space."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    space = c == 33
    one, two, three = c << 42, (c[:-1] << 42) + (c[1:] << 21), (c[:-2] << 42) + (c[1:-1] << 21) + c[2:]
    codes, n = np.unique(np.concatenate([one[~space], two[~(space[:-1] & space[1:])], three[~space[1:-1]]]), return_counts=True)
    return codes, n, int((space[:-1] & ~space[1:]).sum())


def ranked_codes(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, words, grams): of each group its number of words and the codes of its ``RANKS`` most frequent grams, in the order of :func:`ranked`.

    Only the texts are shuffled, once; a group's texts come one after the other, and of a group only the counts of its grams are kept.
    """

    def best(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, at = np.unique(np.concatenate(codes), return_inverse=True)
        return every, np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, counts, words, kinds = None, [], [], 0, []

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            schema = pa.schema([*kinds, ("words", pa.int64()), ("grams", pa.list_(pa.int64()))])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)

        def row() -> tuple:
            c, n = best(codes, counts) if len(codes) > 1 else (codes[0], counts[0])
            return *now, words, c[np.lexsort((c, -n))[:RANKS]]

        for b in batches:
            out, kinds = [], [b.schema.field(k) for k in keys]
            for *key, t in zip(*[b.column(c).to_pylist() for c in (*keys, "_s")]):
                if key != now:
                    if now is not None:
                        out.append(row())
                    now, codes, counts, words = key, [], [], 0
                c, n, w = text_codes(t)
                codes.append(c)
                counts.append(n)
                words += w
                if len(codes) == 64:
                    codes, counts = ([x] for x in best(codes, counts))
            yield packed(out)
        if now is not None:
            yield packed([row()])

    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    rows = df.where(whole).select(*keys, spaced(text).alias("_s")).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, f"{', '.join(f'{k} {df.schema[k].dataType.simpleString()}' for k in keys)}, words long, grams array<long>")


def distances(df: DataFrame, known: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, language, words, distance): how far a group's grams are out of place in each profile that shares one with it, and its number of words."""
    own = ranked_codes(df, keys, text)
    own = own.select(*keys, "words", F.size("grams").alias("_all"), F.posexplode("grams").alias("_r", "_c"))
    at = known.select("language", code("gram").alias("_c"), (F.col("rank") - 1).alias("_at"))
    met = own.join(F.broadcast(at), "_c").groupBy(*keys, "language").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.abs(F.col("_r") - F.col("_at"))).alias("_d"), F.first("_all").alias("_all"), F.first("words").alias("words"))
    return met.select(*keys, "language", "words", (F.col("_d") + RANKS * (F.col("_all") - F.col("_n"))).alias("distance"))


def told(df: DataFrame, known: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, tag, distance): the nearest language, the first of equals by name; NULL for groups of fewer than ``LEAST_WORDS`` words.

    Groups whose texts have no gram of any profile have no row.
    """
    best = distances(df, known, keys, text).groupBy(*keys).agg(F.min(F.struct("distance", "language")).alias("_b"), F.first("words").alias("_words"))
    return best.select(*keys, F.when(F.col("_words") >= LEAST_WORDS, F.col("_b.language")).alias("tag"), F.col("_b.distance").alias("distance"))


def consistency(people: DataFrame, posts: DataFrame, known: DataFrame, most: int = 10, key: str = "account_id") -> DataFrame:
    """(key, consistency): 1 if the bio and the first ``most`` posts are in one language, 0 if not, 0.5 where one is unknown."""
    first = posts.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("post_id"))).where(F.col("_r") <= most)
    side = lambda df, name: df.select(key, F.col("tag").alias(name))
    bios = side(told(people.select(key, F.coalesce("bio", F.lit("")).alias("text")), known, [key]), "_bio")
    spoken = side(told(first.select(key, "text"), known, [key]), "_posts")
    both = people.select(key).join(bios, key, "left").join(spoken, key, "left")
    same = F.when(F.col("_bio").isNull() | F.col("_posts").isNull(), 0.5).when(F.col("_bio") == F.col("_posts"), 1.0).otherwise(0.0)
    return both.select(key, same.alias("consistency"))
