"""Ranked lexical search by the Best Position Algorithm over impact lists.

One pass over the texts counts, for each document, its terms and the occurrences of those terms that some item asks for; these
counts are a written table. Document frequencies, N and L are sums over it. A task then reads its documents as shards of
``SHARD`` postings: a shard has an impact list for each term (documents by falling impact), and for each term the documents in order
with their positions in that list, for direct access. For an item, its lists are read in step; a document that turns up is looked up
in all the item's lists, and every position it has in them counts as seen. A list's best position is the last one before its first
unseen position, which lies beyond what sorted reading has reached. A document not seen yet scores at most the sum of the impacts at the
best positions (nothing from a list that is seen whole); the item leaves the shard once this sum is below its k-th score, strictly,
as ties go to the smaller id. The k-th scores go along from shard to shard of a task. At most k rows an item leave a task, and one
window ranks them.

Items go out in blocks of ``ITEM_TERMS`` terms (or one item), each answered by one pass over the texts, so what is broadcast is
bounded however many items there are. A text is taken apart in pieces of ``PIECE`` bytes cut between terms.

NULL texts have no terms; a document without terms is not counted in N and never found. A document of NULL id comes last among equal
scores; repeated ids are documents each. Rows of one item_id are one item with the terms of all of them; items without terms, or whose
terms stand nowhere, have no rows. Empty tables give none. Other columns are not read. Scores are longs: with a term more than 9e9 times in
one document, or 90 n N beyond a long, Python's integers take over; a score that does not fit raises.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authscope.llm.common import cut, forget, slices
from authscope.llm.vectors import NO_ID, id_array, ints

#: ASCII letters and digits and everything beyond ASCII make terms; A-Z are lower-cased, all else parts terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
PIECE = 1 << 20
#: Postings of a shard, for each of which a task holds some 100 bytes at most.
SHARD = 1_500_000
#: Terms of the items, with repeats, that are broadcast at once.
ITEM_TERMS = 200_000
#: Positions that are read of each list at first; the reach then doubles.
FIRST = 16
COUNTED = "doc_id long, n long, terms binary, tf binary"
FOUND = "item long, doc_id long, score long"
LONG = 2**63


def occurrences(raw: bytes) -> Counter:
    """Terms of a whole text and how often each stands in it."""
    out: Counter = Counter()
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            piece = raw[at:end].translate(TERM_BYTES)
            found = piece.rfind(b" ")
            while found < 0 and end < len(raw):  # one term over the whole piece: the piece grows
                end += PIECE
                piece = raw[at:end].translate(TERM_BYTES)
                found = piece.rfind(b" ")
            end = at + found if found >= 0 and end < len(raw) else min(end, len(raw))
        piece = raw[at:end].translate(TERM_BYTES)
        out.update(piece.split())
        at = max(end, at + 1)
    return out


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms): distinct terms of each item, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [(i, t) for i, raw in zip(b.column("id").to_pylist(), b.column("text").to_pylist()) for t in occurrences(raw or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["id", "term"])

    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, term binary").groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def item_blocks(terms: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    block, size = [], 0
    for row in terms.toLocalIterator():
        if block and size + len(row["terms"]) > ITEM_TERMS:
            yield block
            block, size = [], 0
        block.append((row["id"], [bytes(t) for t in row["terms"]]))
        size += len(row["terms"])
    if block:
        yield block


def count_terms(docs: DataFrame, numbers: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tf) of documents with terms: packed 32-bit numbers of asked terms and 64-bit counts of them."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # at most ITEM_TERMS of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in slices(batches, "text"):
            ids, sizes, terms, tf = [], [], [], []
            for i, raw in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                counts = occurrences(raw or b"")
                if counts:
                    asked = [(number[t], c) for t, c in counts.items() if t in number]
                    ids.append(i)
                    sizes.append(counts.total())
                    terms.append(np.array([a[0] for a in asked], "<i4").tobytes())
                    tf.append(np.array([a[1] for a in asked], "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, COUNTED)


def document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Of each asked term, the number of documents that hold it; a row a term comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), "<i4"), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["term", "df"])

    out = np.zeros(size, np.int64)
    for row in counted.mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """w * ((1000000000 tf) div (1000 tf + 8 m)), m = 10 + (90 n N) div L, of each posting."""
    if 90 * int(n.max(initial=0)) * total_docs >= LONG or int(tf.max(initial=0)) >= LONG // 10**9:
        weight, tf, n = ints(weight), ints(tf), ints(n)
    m = 10 + (90 * n * total_docs) // total_terms
    return (weight * ((10**9 * tf) // (1000 * tf + 8 * m))).astype(np.int64)


class Shard:
    """Impact lists of some documents. ``offsets``: where each term's postings begin, in both orders.

    by_impact, impact: documents and impacts by falling impact; by_doc, position: documents in order and their positions in that list.
    """

    def __init__(self, ids: np.ndarray, n: np.ndarray, terms: np.ndarray, sizes: np.ndarray, tf: np.ndarray, weights: np.ndarray, total_docs: int, total_terms: int):
        self.ids = ids
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        impact = impacts(weights[terms], tf, n[doc], total_docs, total_terms)
        good = impact > 0
        doc, terms, impact = doc[good], terms[good], impact[good]
        order = np.argsort(terms, kind="stable")  # documents stay in order
        terms, self.by_doc, impact = terms[order], doc[order], impact[order]
        self.offsets = np.searchsorted(terms, np.arange(len(weights) + 1))
        fall = np.lexsort((-impact, terms))
        self.by_impact, self.impact = self.by_doc[fall], impact[fall]
        self.position = np.empty(len(fall), np.int32)
        self.position[fall] = np.arange(len(fall)) - self.offsets[terms]

    def scores(self, docs: np.ndarray, lists: list[tuple[int, int]], seen: list[np.ndarray]) -> np.ndarray:
        """Direct access: whole scores of ``docs``; their positions in all lists become seen."""
        total = np.zeros(len(docs), np.int64)
        for (a, b), mark in zip(lists, seen):
            own = self.by_doc[a:b]
            at = np.searchsorted(own, docs)
            at[at == b - a] = 0
            hit = own[at] == docs
            at = self.position[a:b][at[hit]]
            mark[at] = True
            total[hit] += self.impact[a:b][at]
        return total

    def search(self, terms: np.ndarray, best: Best) -> None:
        lists = [(a, b) for a, b in zip(self.offsets[terms].tolist(), self.offsets[terms + 1].tolist()) if a < b]
        seen = [np.zeros(b - a + 1, bool) for a, b in lists]  # the one past the end is never seen
        places = [0] * len(lists)
        known, done, reach = np.zeros(len(self.ids), bool), 0, FIRST
        while True:
            shown = [self.by_impact[a + done : min(a + reach, b)] for a, b in lists if a + done < b]
            if not shown:
                return
            new = np.unique(np.concatenate(shown))
            new = new[~known[new]]
            known[new] = True
            if len(new):
                best.offer(self.ids[new], self.scores(new, lists, seen))
            bound = 0
            for i, (a, b) in enumerate(lists):
                places[i] += int(seen[i][places[i] :].argmin())
                if places[i] < b - a:
                    bound += int(self.impact[a + places[i] - 1])
            if bound < best.least:
                return
            done, reach = reach, 2 * reach


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.found, self.least = k, np.empty(0, np.int64), np.empty(0, np.int64), 1

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            ids, scores = np.concatenate([self.ids, ids[good]]), np.concatenate([self.found, scores[good]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.found = ids[order], scores[order]
            if len(order) == self.k:
                self.least = int(self.found[-1])


def searcher(asked: list[np.ndarray], weights: np.ndarray, total_docs: int, total_terms: int, k: int):
    """Of a task's documents, the k best for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows, held = [Best(k) for _ in asked], [], 0

        def search() -> None:
            ids, n, terms, tf = (np.concatenate(c) for c in list(zip(*rows))[:4])
            shard = Shard(ids, n, terms, np.concatenate([r[4] for r in rows]), tf, weights, total_docs, total_terms)
            for t, found in zip(asked, best):
                shard.search(t, found)

        for b in slices(batches, "tf", 12 * SHARD):
            terms = b.column("terms").to_pylist()
            sizes = np.array([len(t) >> 2 for t in terms], np.int64)
            rows.append((b.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False), b.column("n").to_numpy(), np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(b.column("tf").to_pylist()), "<i8"), sizes))
            held += int(sizes.sum())
            if held >= SHARD:
                search()
                rows, held = [], 0
        if rows:
            search()
        of = np.repeat(np.arange(len(best)), [len(x.ids) for x in best])
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), id_array(np.concatenate([x.ids for x in best])), pa.array(np.concatenate([x.found for x in best]), pa.int64())], ["item", "doc_id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item whose score is above 0."""
    spark, parts = docs.sparkSession, []
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for block in item_blocks(item_terms(items, item_col, item_text)):
        numbers = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        counted = cut(count_terms(docs, numbers, id_col, text_col))
        total = counted.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = document_frequencies(counted, len(numbers))
        weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        asked = [np.array([numbers[t] for t in terms], np.int64) for _, terms in block]
        found = counted.mapInArrow(searcher(asked, weights, total["docs"], total["terms"], k), FOUND)
        found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        named = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item long, item_id long")  # as many as the block has
        parts.append(cut(found.join(named, "item").select("item_id", "rank", "doc_id", "score")))
        forget(counted)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
