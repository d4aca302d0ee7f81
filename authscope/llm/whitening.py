"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

The matrix X has a row for each vector, centred; it stays with Spark, as a written table of packed blocks. A step takes a direction v
of as many entries as a vector has, makes u = Xv in every task, and sums X'u and what u shares with the vectors u before; both
products are made in one pass, since a row's entry of u needs that row alone and its length can be divided out afterwards. Earlier
vectors u are kept as the directions w with u = Xw, a vector's length each, and made again in the tasks: nothing of X's height is
stored, and a lost executor loses nothing. u is orthogonalised against all u before, v against all v before, twice. The driver
holds two square matrices of a vector's length at most. The SVD of the small bidiagonal matrix gives the components and deviations.

Where a product vanishes (the vectors found so far are a space of their own, as with equal eigenvalues) a random direction outside
goes on. Steps end when the wanted singular values have settled and all that is left of X weighs less than the last of them, else
with as many steps as a vector has entries, when nothing is left.

Entries c become floor(1024 c) + 100000; a vector with one that is not below 2**52 in size is left out, besides those that
:func:`vectors.usable` leaves out. Repeated and NULL ids are rows like others. Components whose deviation is below 1e-10 of the first
are not resolved and not returned: with one vector, or only equal ones, there is none. An empty table gives no rows. Deviations that
do not fit a decimal of 38 digits raise. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.llm import vectors
from authscope.llm.common import cut
from authscope.llm.vectors import ints

SHIFT = 100_000
RESOLVED = 1e-10
SETTLED = 1e-13
PACKED = "ids binary, x binary"


class Centre(NamedTuple):
    """Count, and the mean as floor and remainder over the count, so that x minus the mean keeps all digits."""

    n: int
    floor: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest / self.n

    def squares(self, x: np.ndarray) -> pa.Array:
        """Of each row, the sum of (n x - S)**2, exact."""
        z = x - self.floor
        if (float(np.abs(z).max(initial=0)) + 1) * self.n < 2**31 / np.sqrt(x.shape[1]):
            return pa.array(((self.n * z - self.rest) ** 2).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        return pa.array([int(s) for s in ((self.n * ints(z) - ints(self.rest)) ** 2).sum(axis=1)], pa.decimal128(38, 0))


class Model(NamedTuple):
    """components: rows of unit length, by falling eigenvalue."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    steps: int


def store(rows: DataFrame, d: int) -> DataFrame:
    """Blocks (ids, x) of whole numbers."""

    def make(ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(vectors.packed(ids, np.floor(vectors.SCALE * v).astype("<i8") + SHIFT), ["ids", "x"])

    fits = F.forall("v", lambda c: F.abs(c) < 2.0**42)
    return cut(vectors.blocks(rows.where(fits), d, PACKED, make))


def unpacked(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for i, x in zip(b.column("ids"), b.column("x")):
            yield np.frombuffer(i.as_py(), "<i8"), np.frombuffer(x.as_py(), "<i8").reshape(-1, d)


def summed(packed: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> list:
    """The sum over all blocks of the numbers ``of(x)``, added up by Spark; as many rows as there are numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in unpacked(batches, d):
            part = of(x)
            total = part if total is None else total + part
        if total is not None:
            values = pa.array(total, pa.float64()) if kind == "double" else pa.array([int(v) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], ["at", "value"])

    rows = packed.mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return [r["value"] for r in sorted(rows, key=lambda r: r["at"])]


def centre(packed: DataFrame, d: int) -> Centre | None:
    """Exact sums, in two halves of the numbers so that none overflows."""
    found = summed(packed, d, lambda x: np.concatenate([[len(x)], ints((x >> 26).sum(axis=0)) * 2**26 + ints((x & (2**26 - 1)).sum(axis=0))]).astype(object), "decimal(38,0)")
    if not found:
        return None
    n, sums = int(found[0]), [int(s) for s in found[1:]]
    return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


def outside(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along ``basis``, taken off twice."""
    if basis:
        m = np.array(basis)
        for _ in range(2):
            v = v - m.T @ (m @ v)
    return v


def bidiagonalise(packed: DataFrame, d: int, c: Centre, k: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(right singular vectors as rows, singular values, squared weight of X, steps)."""
    random = np.random.default_rng(11)

    def fresh() -> np.ndarray:
        v = outside(random.standard_normal(d), vs)
        return v / np.linalg.norm(v)

    vs: list[np.ndarray] = []
    ws, ts = np.zeros((d, d)), np.zeros((d, d))  # u = X w and X'u of each step
    alphas, betas, weight = [], [], 0.0
    v, beta = fresh(), 0.0
    for j in range(d):
        vs.append(v)
        to, before = v - beta * ws[j - 1] if j else v, ws[:j].T.copy()

        def products(x: np.ndarray, to=to, before=before) -> np.ndarray:
            y = c.centred(x)
            u = y @ to
            return np.concatenate([[(y * y).sum(), u @ u], (y @ before).T @ u, y.T @ u])

        got = np.array(summed(packed, d, products))
        weight, shared, back = got[0], got[2 : 2 + j], got[2 + j :]
        least = weight * (RESOLVED * 1e-4) ** 2
        square = got[1] - shared @ shared
        alpha = np.sqrt(square) if square > least else 0.0
        if alpha:
            ws[j] = (to - shared @ ws[:j]) / alpha
            ts[j] = (back - shared @ ts[:j]) / alpha
        rest = outside(ts[j] - alpha * v, vs)
        norm = float(np.linalg.norm(rest))
        alphas.append(alpha)
        small = np.diag(alphas) + np.diag(betas, 1)
        left, sigma, right = np.linalg.svd(small)
        wanted = min(k, len(sigma))
        settled = wanted == min(k, d) and norm * np.abs(left[-1, :wanted]).max() <= SETTLED * sigma[0]
        over = weight - (small**2).sum() - norm**2
        if j + 1 == d or (settled and over < sigma[wanted - 1] ** 2):
            break
        beta = norm if norm**2 > least else 0.0
        v = rest / norm if beta else fresh()
        betas.append(beta)
    return right @ np.array(vs), sigma, weight, len(vs)


def fit(packed: DataFrame, d: int, k: int = 8) -> Model | None:
    """None without vectors."""
    c = centre(packed, d) if d else None
    if c is None:
        return None
    rows, sigma, weight, steps = bidiagonalise(packed, d, c, k)
    keep = np.flatnonzero(sigma[:k] > RESOLVED * sigma[0])
    rows = rows[keep] / np.linalg.norm(rows[keep], axis=1, keepdims=True)
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]) if len(rows) else np.ones(0)
    return Model(c, rows * signs[:, None], sigma[keep] ** 2 / c.n, weight / c.n, steps)


def identity_error(packed: DataFrame, d: int, m: Model) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    to, k = (m.components / np.sqrt(m.eigenvalues)[:, None]).T, len(m.components)

    def products(x: np.ndarray) -> np.ndarray:
        z = m.centre.centred(x) @ to
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    got = np.array(summed(packed, d, products)) / m.centre.n
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


def whiten(df: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component; deviation is a decimal."""
    rows, d = vectors.usable(df, id_col, vector_col)
    packed = store(rows, d) if d else None
    m = fit(packed, d, k) if d else None
    if m is None or not len(m.components):
        return df.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    to, found = (m.components / np.sqrt(m.eigenvalues)[:, None]).T, len(m.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in unpacked(batches, d):
            each = np.repeat(np.arange(len(ids)), found)
            z = m.centre.centred(x) @ to
            yield pa.RecordBatch.from_arrays(
                [vectors.id_array(ids[each]), pa.array(np.tile(np.arange(1, found + 1), len(ids)), pa.int32()), m.centre.squares(x).take(pa.array(each)), pa.array(z.ravel(), pa.float64())],
                ["vec_id", "component", "deviation", "whitened"],
            )

    share = F.element_at(F.array(*[F.lit(float(e / m.trace)) for e in m.eigenvalues]), F.col("component"))
    out = packed.mapInArrow(run, "vec_id long, component int, deviation decimal(38,0), whitened double")
    return out.select("vec_id", "component", F.lit(m.centre.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(identity_error(packed, d, m)).alias("identity_error"))
