"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

The index is a written table of blocks: the vectors of a block and, for each dimension, their order by that dimension. A task reads
its blocks one after the other and keeps each query's k best so far. In a block the lists of all dimensions are read in step, from
both ends: the greatest entries for the positive entries of a query, the least for the negative ones. Every vector that turns up in
any list is looked up whole and scored. What no list has shown yet scores at most the sum of the query's entries times the entries
read last; a query leaves the block when that bound lies below its k-th best score, and need not enter it if the bound of the first
entries does. At equal scores the smaller id wins, so a bound equal to the k-th score reads on. Each task returns at most k rows a
query, which one window ranks.

Queries go out in blocks of ``QUERY_BYTES`` at most, each broadcast and answered by one pass over the index, so memory is bounded by
the block sizes however many queries or vectors there are. Scores are exact: doubles hold all sums below 2**53, beyond that
Python's integers are used; a score that does not fit a long raises.

NULL, empty, non-finite vectors and those of another length than most take no part (:func:`vectors.usable`). Queries of NULL id do
not exist; a candidate of NULL id comes last among equal scores. A row is no candidate of queries with its id; rows that repeat an
id are candidates each, and queries each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authscope.llm import vectors
from authscope.llm.common import cut, forget

#: Bytes of query vectors that are broadcast at once.
QUERY_BYTES = 16_000_000
#: Positions that are read of each list at first; the reach then doubles.
FIRST = 16
LIMIT = 2.0**53


def whole(v: np.ndarray) -> np.ndarray:
    return np.floor(vectors.SCALE * v)


def index(rows: DataFrame, d: int) -> DataFrame:
    """Blocks (ids, x, sorted): ids, whole numbers as doubles, and rows of the block by each dimension, ascending."""

    def make(ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        x = whole(v)
        return pa.RecordBatch.from_arrays(vectors.packed(ids, x, np.argsort(x, axis=0, kind="stable").astype("<i4")), ["ids", "x", "sorted"])

    return cut(vectors.blocks(rows, d, "ids binary, x binary, sorted binary", make))


class Best:
    """The k best of each query so far: scores fall, ids rise among equal scores."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.scores = np.full((len(q), k), -np.inf, object if q.dtype == object else float)
        self.found = np.full((len(q), k), vectors.NO_ID, np.int64)
        self.count = np.zeros(len(q), np.int64)

    @property
    def least(self) -> np.ndarray:
        """Of each query, the score that a new row must reach."""
        return self.scores[:, -1]

    def offer(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of the rows ``ids`` for the queries ``at``."""
        scores[self.ids[at][:, None] == ids[None, :]] = -np.inf
        good = (scores >= self.least[at][:, None]) & (scores > -np.inf)
        for i in np.flatnonzero(good.any(axis=1)):
            g, n, j = at[i], self.count[at[i]], np.flatnonzero(good[i])
            s, f = np.concatenate([self.scores[g, :n], scores[i, j]]), np.concatenate([self.found[g, :n], ids[j]])
            order = (sorted(range(len(s)), key=lambda t: (-s[t], f[t])) if s.dtype == object else np.lexsort((f, -s)))[: self.k]
            self.count[g] = len(order)
            self.scores[g, : len(order)], self.found[g, : len(order)] = s[order], f[order]


def bound(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest score of any vector whose entries lie between ``low`` and ``high``."""
    return np.where(q > 0, q * high, q * low).sum(axis=1)


def read_block(best: Best, ids: np.ndarray, x: np.ndarray, order: np.ndarray) -> int:
    """The threshold algorithm over one block; returns how many positions of the lists were read."""
    n = len(ids)
    ranked = np.take_along_axis(x, order, 0)
    active = np.flatnonzero(bound(best.q, ranked[0], ranked[-1]) >= best.least)
    seen, done, reach = np.zeros(n, bool), 0, FIRST
    while len(active) and done < n:
        end = min(n, reach)
        shown = np.concatenate([order[done:end].ravel(), order[n - end : n - done].ravel()])
        mark = np.zeros(n, bool)
        mark[shown] = True
        new = np.flatnonzero(mark & ~seen)
        seen[new] = True
        if len(new):
            best.offer(active, ids[new], best.q[active] @ x[new].T)
        if seen.all():
            return end
        active = active[bound(best.q[active], ranked[end - 1], ranked[n - end]) >= best.least[active]]
        done, reach = end, 2 * end
    return done


def exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if all sums of products stay below 2**53, else as Python's integers."""
    if q.dtype != object and q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < LIMIT:
        return q, x
    return vectors.ints(q), vectors.ints(x)


def searcher(q_ids: np.ndarray, queries: np.ndarray, d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            for i, p, o in zip(*(b.column(c) for c in ("ids", "x", "sorted"))):
                ids, order = np.frombuffer(i.as_py(), "<i8"), np.frombuffer(o.as_py(), "<i4").reshape(-1, d)
                q, x = exact(queries if best is None else best.q, np.frombuffer(p.as_py(), "<f8").reshape(-1, d))
                if best is None:
                    best = Best(q_ids, q, k)
                elif q.dtype != best.q.dtype:  # from here on sums may leave the doubles' range; those before did not
                    best.q = q
                    best.scores = np.array([[int(s) if s > -np.inf else -np.inf for s in row] for row in best.scores], object)
                read_block(best, ids, x, order)
        if best is not None:
            rows = np.repeat(np.arange(len(q_ids)), best.count)
            kept = np.arange(k)[None, :] < best.count[:, None]
            scores = pa.array([int(s) for s in best.scores[kept]], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), vectors.id_array(best.found[kept]), scores], ["q", "vec_id", "score"])

    return run


def query_blocks(rows: DataFrame, d: int) -> DataFrame:
    """Rows (ids, x): at most ``QUERY_BYTES`` of vectors each."""
    size = max(1, QUERY_BYTES // (8 * d))

    def make(ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(vectors.packed(ids, whole(v)), ["ids", "x"])

    return cut(vectors.blocks(rows.repartition(max(1, -(-rows.count() // size))), d, "ids binary, x binary", make, size))


def search(df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row whose id ``every`` divides."""
    rows, d = vectors.usable(df, id_col, vector_col)
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not d:
        return empty
    lists, queries, parts = index(rows, d), query_blocks(rows.where(F.col("id") % every == 0), d), []
    by = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    for block in queries.toLocalIterator():
        ids = np.frombuffer(block["ids"], "<i8")
        found = lists.mapInArrow(searcher(ids, np.frombuffer(block["x"], "<f8").reshape(-1, d), d, k), "q long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        named = df.sparkSession.createDataFrame([(n, int(i)) for n, i in enumerate(ids)], "q long, query_id long")  # as many as the block has
        parts.append(cut(found.join(named, "q").select("query_id", "rank", "vec_id", "score")))
    forget(queries)
    forget(lists)
    return reduce(DataFrame.unionByName, parts) if parts else empty
