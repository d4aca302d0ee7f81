"""Vectors of a table as rows of whole numbers: which rows take part, and packed blocks of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a packed block.
BLOCK = 4096
#: Steps that 1 is divided into.
SCALE = 1024
#: What a NULL id counts as.
NO_ID = np.iinfo(np.int64).max


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """((id, v) of the vectors that take part, their length).

    A vector is left out if it is NULL or empty or holds a NULL or non-finite entry, or is not as long as most vectors are (as
    many of two lengths: the greater). Ids may be NULL or repeat. Of ``df`` only the two columns are read. Without any vector
    the length is 0.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.size("v") > 0).where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    d = sizes[0]["d"] if sizes else 0
    return rows.where(F.size("v") == d), d


def blocks(rows: DataFrame, d: int, schema: str, make: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], size: int = BLOCK) -> DataFrame:
    """A row of ``schema`` for each ``size`` vectors of a partition at most: what ``make(ids, v)`` returns for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                piece = b.slice(at, size - held)
                ids.append(piece.column("id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False))
                parts.append(piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                at, held = at + piece.num_rows, held + piece.num_rows
                if held == size:
                    yield make(np.concatenate(ids), np.concatenate(parts))
                    ids, parts, held = [], [], 0
        if held:
            yield make(np.concatenate(ids), np.concatenate(parts))

    return rows.mapInArrow(run, schema)


def ints(a: np.ndarray) -> np.ndarray:
    """Whole numbers as Python's, which do not overflow."""
    return np.frompyfunc(int, 1, 1)(a)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def packed(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array([c.tobytes()], pa.binary()) for c in columns]
