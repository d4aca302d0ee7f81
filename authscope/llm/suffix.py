"""Suffix-array dedup (operator 7): sparse suffixes at minimisers, neighbours in sorted order, matches extended both ways.

Words are maximal runs of anything but ASCII white space. Suffixes are kept where the hash of ``GRAM`` words is the least
of ``WINDOW`` in a row, a choice that depends on the content alone: passages of GRAM + WINDOW - 1 = 50 words or more that
two documents share hold a suffix that both keep. Suffixes whose first GRAM words stand in one document only go. Those
that stay cover their GRAM words; suffixes of a document that touch and have the same first document form a chain, so only a chain's two ends are open. There
the words that follow (or, to the left, precede) are sorted with those of all suffixes of equal beginning, and the longest
prefix shared with a neighbour in that order extends the match; WINDOW - 1 words are enough, as more would hold one more suffix.

Sorting is within a beginning and the next word, after equal contexts are counted as one, so many copies of a passage
are one row. NULL and empty texts, and rows of NULL id, have no repeats; rows of equal id are one document and repeat
nothing for themselves; an empty table gives no rows. Other columns are left out. Counts and hashes only move, never texts, but
for one join that brings the open suffixes to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authscope.llm.common import cut, slices
from authscope.llm.wordhash import Words

GRAM, WINDOW = 34, 17
LEAST_WORDS = GRAM + WINDOW - 1


def minimisers(df: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, at, h): word positions of the suffixes kept, and the hash of their first ``gram`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Words([x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()], fold=False)
            grams = w.runs(gram)
            rows, places = [], []
            for k, (a, e) in enumerate(zip(w.first.tolist(), w.first[1:].tolist())):
                own = grams[a : max(a, e - gram + 1)]
                if len(own):
                    # the least of each window, rightmost among equals; a text of fewer grams is one window
                    at = np.arange(len(own) - window + 1) + (window - 1 - sliding_window_view(own[::-1], window).argmin(1))[::-1] if len(own) > window else np.array([len(own) - 1 - own[::-1].argmin()])
                    at = np.unique(at)
                    rows.append(np.full(len(at), k))
                    places.append(at)
            k = np.concatenate(rows) if rows else np.empty(0, np.int64)
            at = np.concatenate(places) if places else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(k)), pa.array(at.astype(np.int32)), pa.array(grams.take(w.first.take(k) + at).view(np.int64) if len(k) else np.empty(0, np.int64))], ["id", "at", "h"])

    return df.mapInArrow(run, "id long, at int, h long")


def contexts(df: DataFrame, gram: int, window: int) -> DataFrame:
    """(id, at, side, ctx): word hashes after (side 1) or before (side 0, nearest first) the suffixes ``df(id, text, asked)`` asks for, at most ``window - 1``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Words([x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()], fold=False)
            ids, rows = b.column("id").to_pylist(), []
            hashes = w.hashes.view(np.int64)
            for i, asked, a, e in zip(ids, b.column("asked").to_pylist(), w.first.tolist(), w.first[1:].tolist()):
                for x in asked:
                    at, side = x["at"], x["side"]
                    c = hashes[a + at + gram : min(e, a + at + gram + window - 1)] if side else hashes[max(a, a + at - window + 1) : a + at][::-1]
                    rows.append((i, at, side, c))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int64()))], ["id", "at", "side", "ctx"])

    return df.mapInArrow(run, "id long, at int, side int, ctx array<long>")


def owned_runs(spans: DataFrame, gram: int, window: int) -> DataFrame:
    """(id, start_word, end_word, n_words, first_doc) of ``spans(id, own(at, first_doc), more(at, side, owners))``, a row for each document.

    Each suffix covers ``gram`` words, and its match the words of ``owners`` after (side 1) or before (side 0, nearest first)
    them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, own, more in zip(b.column("id").to_pylist(), b.column("own").to_pylist(), b.column("more").to_pylist()):
                least = min(x["at"] for x in own) - window
                size = max(x["at"] for x in own) + gram + window - least
                owner, there = np.full(size, (1 << 63) - 1, np.int64), np.zeros(size, bool)
                for x in own:
                    a = x["at"] - least
                    np.minimum(owner[a : a + gram], x["first_doc"], out=owner[a : a + gram])
                    there[a : a + gram] = True
                for x in more or ():
                    o, a = np.array(x["owners"], np.int64), x["at"] - least
                    at = a + gram + np.arange(len(o)) if x["side"] else a - 1 - np.arange(len(o))
                    owner[at] = np.minimum(owner[at], o)
                    there[at] = True
                edges = np.flatnonzero(np.diff(np.concatenate(([False], there, [False])).astype(np.int8))).tolist()
                for s, e in zip(edges[::2], edges[1::2]):
                    if e - s >= gram + window - 1:
                        cuts = [s, *(s + 1 + np.flatnonzero(np.diff(owner[s:e]))).tolist(), e]
                        rows += [(i, x + least, y + least, y - x, int(owner[x])) for x, y in zip(cuts, cuts[1:])]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["id", "start_word", "end_word", "n_words", "first_doc"])

    return spans.mapInArrow(run, "id long, start_word int, end_word int, n_words int, first_doc long")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc): maximal runs of repeated words of ``gram + window - 1`` or more.

    A run is split where its owner changes, so a row may be shorter, and ``n_words`` counts the row's own words. ``first_doc``, the
    owner, is the smallest id of a document that shares the words; where it is the row's own id, this occurrence stays. Words
    that several shared passages cover go by the least of their owners, so what an earlier document holds goes, and stays there.
    """
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kept = minimisers(docs, gram, window)
    shared = kept.groupBy("h").agg(F.min("id").alias("first_doc"), F.max("id").alias("last")).where("first_doc < last").drop("last")
    found = cut(kept.join(shared, "h"))  # numbers of repeated suffixes only
    along = Window.partitionBy("id").orderBy("at")
    # an end is open where no suffix follows that touches, and where the next one's first document is another
    ends_at = lambda gap, other: F.coalesce((gap > gram) | (other != F.col("first_doc")), F.lit(True))
    found = found.withColumns({"left": ends_at(F.col("at") - F.lag("at").over(along), F.lag("first_doc").over(along)), "right": ends_at(F.lead("at").over(along) - F.col("at"), F.lead("first_doc").over(along))})
    ends = found.select("h", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("open")), F.struct(F.lit(1).alias("side"), F.col("right").alias("open")))).alias("e")).where("e.open").select("h", "e.side").distinct()
    asked = found.select("id", "at", "h").join(ends, "h").groupBy("id").agg(F.collect_list(F.struct("at", "side")).alias("asked"), F.collect_list(F.struct("at", "h")).alias("_h"))
    there = contexts(docs.join(asked.select("id", "asked"), "id"), gram, window)
    at_ends = there.where(F.size("ctx") > 0).join(found.select("id", "at", "h", "left", "right"), ["id", "at"])
    at_ends = cut(at_ends.select("id", "at", "side", "h", "ctx", F.when(F.col("side") == 0, F.col("left")).otherwise(F.col("right")).alias("open")))
    distinct = at_ends.groupBy("h", "side", "ctx").agg(F.min("id").alias("first"), (F.min("id") < F.max("id")).alias("many"))
    order = Window.partitionBy("h", "side", F.get("ctx", F.lit(0))).orderBy("ctx")
    same = lambda a, b: F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False) - 1, F.lit(0))
    common = lambda o: F.when(o.isNull(), 0).otherwise(F.when(same(F.col("ctx"), o) < 0, F.size("ctx")).otherwise(same(F.col("ctx"), o)))
    near = distinct.withColumns({"_a": F.lag("ctx").over(order), "_b": F.lead("ctx").over(order)})
    reach = near.select("h", "side", "ctx", "first", F.when(F.col("many"), F.size("ctx")).otherwise(F.greatest(common(F.col("_a")), common(F.col("_b")))).cast("int").alias("more")).where("more > 0")
    # the owner of each word of a match beyond the suffix: the first document of those that share it up to there
    upto = F.transform(F.sequence(F.lit(1), F.col("more")), lambda k: F.xxhash64(F.slice("ctx", F.lit(1), k)))
    steps = reach.select("h", "side", F.xxhash64("ctx").alias("c"), "first", F.posexplode(upto).alias("k", "p"))
    owner = steps.groupBy("h", "side", "k", "p").agg(F.min("first").alias("owner"))
    owners = steps.select("h", "side", "c", "k", "p").join(owner, ["h", "side", "k", "p"]).groupBy("h", "side", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "owner"))), lambda x: x["owner"]).alias("owners"))
    more = at_ends.select("id", "at", "side", "h", F.xxhash64("ctx").alias("c"), "open").where("open").join(owners, ["h", "side", "c"])
    more = more.groupBy("id").agg(F.collect_list(F.struct("at", "side", "owners")).alias("more"))
    spans = found.groupBy("id").agg(F.collect_list(F.struct("at", "first_doc")).alias("own")).join(more, "id", "left")
    return owned_runs(spans, gram, window).withColumnRenamed("id", id_col)
