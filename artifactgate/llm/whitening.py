"""Embedding whitening by spectral divide and conquer.

Entries are read as whole numbers, ``x = floor(64 c) + OFFSET``; the fit list is
each distinct vector of these once. Spark sums it to a mean and a covariance, and
whitens every row with the components, which are small and broadcast. Between the
two stands a covariance matrix of bounded size, taken apart as Nakatsukasa and
Higham (2013) do: the polar factor U of ``V - shift`` has eigenvalues 1 and -1 on
either side of the shift, so that ``(U + 1) / 2`` projects on an invariant
subspace. Bases of the two subspaces split V into two smaller blocks, and so on
down to single components. The polar factor comes from the QDWH iteration, whose
weights follow a lower bound of the singular values: some six rounds for any
matrix that double precision can tell from a singular one.

Sums are exact: a vector meets the others as its difference from the whole part
of the mean, and what a mean leaves over is carried along.

Defined results: rows whose vector is null, or holds a null or non-finite entry,
or one so large that no long holds x, give no rows; vectors of each length are
whitened among themselves, an empty one gives none. Components without variance
(within rounding of the largest) can't be whitened and give no rows, so that a
single distinct vector has none. A ``deviation`` beyond a long is null. Rows that
repeat a vec_id are rows of their own; other columns play no part. A vector of
more than ``MOST_DIMENSIONS`` entries is an error: the covariance of its length
would not fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artifactgate.llm.common import stored
from artifactgate.llm.groups import batches_of

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
MOST_DIMENSIONS = 1_024
#: Entries below this, times SCALE, leave room in a long.
LARGEST = 2.0**55
#: Tasks that sum up what the others have summed.
SUMMED_BY = 16
EPS = np.finfo(float).eps


# -- the covariance, taken apart on the driver ---------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix, by dynamically weighted Halley iterations."""
    n = len(a)
    x = a / np.sqrt(np.linalg.norm(a, 1) * np.linalg.norm(a, np.inf))
    r = np.linalg.qr(x, mode="r")
    diagonal = np.abs(np.diag(r)).min()
    low = EPS if diagonal < EPS else min(1.0, max(EPS, 0.9 / (np.linalg.norm(np.linalg.inv(r), 2))))
    one = np.eye(n)
    for _ in range(30):
        d = np.cbrt(max(0.0, 4 * (1 - low**2) / low**4))
        a_ = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        b = (a_ - 1) ** 2 / 4
        c = a_ + b - 1
        if c > 100:  # an ill-conditioned x: through QR, else through a solve
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))
            new = (b / c) * x + (a_ - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            new = (b / c) * x + (a_ - b / c) * np.linalg.solve(one + c * (x.T @ x), x.T).T
        low = min(1.0, low * (a_ + b * low**2) / (1 + c * low**2))
        moved, x = np.linalg.norm(new - x), new
        if abs(1 - low) < 10 * EPS and moved < np.cbrt(EPS) * 1e-1:
            break
    return x


def _basis(projector: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """An orthonormal basis of a projector's range: a random block, projected and orthonormalised until it stays."""
    q = np.random.default_rng(seed).standard_normal((len(projector), rank))
    for _ in range(3):
        q, _ = np.linalg.qr(projector @ q)
    return q


def split(a: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces of a symmetric matrix, that of the larger eigenvalues first; None if its eigenvalues are all one."""
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.diag(np.full(len(a), np.diag(a).mean())), 2)
    if spread <= tolerance:
        return None
    middle = np.diag(a).mean()
    shifts = [np.median(diagonal), middle, *(middle + spread * s for s in (0.3, -0.3, 0.6, -0.6, 0.1, -0.1, 0.8, -0.8, 0.9, -0.9, 0.95, -0.95, 0.99, -0.99))]
    best = None
    for shift in shifts:
        u = polar(a - shift * np.eye(len(a)))
        p = (np.eye(len(a)) + (u + u.T) / 2) / 2
        rank = int(round(np.trace(p)))
        if not 0 < rank < len(a):
            continue
        upper, lower = _basis(p, rank, 1), _basis(np.eye(len(a)) - p, len(a) - rank, 2)
        off = np.linalg.norm(upper.T @ a @ lower)
        if best is None or off < best[0]:
            best = off, upper, lower
        if off <= tolerance:
            break
    if best is None or best[0] > 1e3 * tolerance:
        raise ArithmeticError("the covariance could not be split")
    return best[1], best[2]


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``most`` largest eigenvalues of a symmetric matrix, falling.

    Blocks that are known to lie below the wanted components are left whole.
    """
    tolerance = 16 * EPS * np.linalg.norm(v) * max(1, np.sqrt(len(v)))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    todo = [np.eye(len(v))]  # bases of subspaces, that of the largest eigenvalues last
    while todo and len(values) < most:
        q = todo.pop()
        a = q.T @ v @ q
        a = (a + a.T) / 2
        parts = split(a, tolerance) if len(a) > 1 else None
        if parts is None:
            values += np.diag(a).tolist()
            vectors += list(q.T)
            continue
        for part in parts[::-1]:
            todo.append(np.linalg.qr(q @ part)[0])
    order = np.argsort(-np.array(values), kind="stable")[:most]
    return np.array(values)[order], np.array(vectors)[order].T


# -- sums over the fit list ----------------------------------------------------


class Fit(NamedTuple):
    """Of the vectors of one length: their number, sums by dimension, the components' eigenvalues, vectors and shares, and the identity's error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """(whole part of the mean, what n times the mean has beyond n times that)."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, dtype=np.int64), np.array([s - w * self.n for s, w in zip(self.sums, whole)], dtype=np.float64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre()
        return (x - whole).astype(np.float64) - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - sum)**2, exact."""
        whole, rest = self.centre()
        apart = x - whole
        most = int(np.abs(apart).max(initial=0)) * self.n + self.n
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * apart - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(y) - int(r)) ** 2 for y, r in zip(row, rest)) for row in apart]
        return [y if y < 1 << 63 else None for y in exact]


def numbers(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (rows, x as long) of the usable rows."""
    lists = column.cast(pa.large_list(pa.float64()))
    offsets, flat = lists.offsets.to_numpy(), lists.values
    size = np.diff(offsets)
    values = flat.to_numpy(zero_copy_only=False)  # null becomes NaN
    with np.errstate(over="ignore"):
        good = np.abs(values * SCALE) < LARGEST
    bad = np.concatenate([[0], np.cumsum(~good)])
    usable = np.asarray(lists.is_valid()) & (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    out = {}
    for n in np.unique(size[usable]).tolist():
        if n > MOST_DIMENSIONS:
            raise ValueError(f"vectors of {n} entries; at most {MOST_DIMENSIONS} can be whitened")
        rows = np.flatnonzero(usable & (size == n))
        part = values[offsets[rows][:, None] + np.arange(n)]
        out[n] = rows, np.floor(part * SCALE).astype(np.int64) + OFFSET
    return out


def _summed(spark, fit: DataFrame, each: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Length -> sum over the fit list of what ``each`` makes of a block of its vectors; summed in tasks, then in few of them."""

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            size = batch.column(0).to_numpy()
            for n in np.unique(size).tolist():
                rows = batch.column(1).filter(pa.array(size == n))
                x = np.frombuffer(b"".join(rows.to_pylist()), dtype=np.int64).reshape(-1, n)
                total[n] = total.get(n, 0) + each(n, x)
        yield _rows(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, (kind, shape, data) in zip(batch.column(0).to_pylist(), zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                total[n] = total.get(n, 0) + np.frombuffer(data, dtype=kind).reshape(shape)
        yield _rows(total)

    def _rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.dtype.str for t in total.values()], pa.string()), pa.array([t.shape for t in total.values()], pa.list_(pa.int32())), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["length", "kind", "shape", "data"])

    kinds = "length int, kind string, shape array<int>, data binary"
    with batches_of(spark, 4096):
        parts = fit.mapInArrow(of_blocks, kinds).repartition(SUMMED_BY).mapInArrow(again, kinds).collect()
    out: dict[int, np.ndarray] = {}
    for n, kind, shape, data in parts:
        out[n] = out.get(n, 0) + np.frombuffer(data, dtype=kind).reshape(shape)
    return out


def fitted(fit: DataFrame, components: int) -> dict[int, Fit]:
    """A fit for each length. ``fit``: (length, x) of the distinct vectors."""
    spark = fit.sparkSession
    half = np.int64(1) << np.int64(32)
    # Halves of the numbers are summed apart, so that no sum leaves a long.
    sums = _summed(spark, fit, lambda n, x: np.stack([(x // half).sum(axis=0), (x % half).sum(axis=0), np.full(n, len(x))]))
    fits = {n: Fit(int(s[2, 0]), [int(hi) * int(half) + int(lo) for hi, lo in zip(s[0], s[1])], np.ones(0), np.zeros((n, 0)), np.ones(0)) for n, s in sums.items()}
    products = _summed(spark, fit, lambda n, x: (z := fits[n].centred(x)).T @ z)
    for n, p in products.items():
        v = p / fits[n].n
        values, vectors = leading((v + v.T) / 2, min(components, n)) if v.any() else (np.ones(0), np.zeros((n, 0)))
        some = values > n * EPS * max(values.max(initial=0), 0)
        fits[n] = fits[n]._replace(values=values[some], vectors=np.ascontiguousarray(vectors[:, some]), explained=values[some] / np.trace(v) if some.any() else np.ones(0))

    def moments(n: int, x: np.ndarray) -> np.ndarray:
        y = np.hstack([np.ones((len(x), 1)), fits[n].whitened(x)])
        return y.T @ y

    for n, m in _summed(spark, fit, moments).items():
        mean = m[0, 1:] / fits[n].n
        covariance = m[1:, 1:] / fits[n].n - np.outer(mean, mean)
        fits[n] = fits[n]._replace(error=float(np.abs(covariance - np.eye(len(mean))).max(initial=0)))
    return fits


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row of ``embeddings`` and component."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (_, x) in numbers(batch.column(0)).items():
                distinct = np.unique(x, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), n, dtype=np.int32)), pa.array([r.tobytes() for r in distinct], pa.binary())], ["length", "x"])

    with batches_of(spark, 4096):
        fit = stored(rows.select("v").mapInArrow(quantised, "length int, x binary").distinct(), "fit")
    fits = spark.sparkContext.broadcast(fitted(fit, components))

    out = T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields])

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (own, x) in numbers(batch.column(1)).items():
                fit = fits.value[n]
                if not len(fit.values):
                    continue
                m, k = len(own), len(fit.values)
                repeated = pa.array(np.repeat(own, k))
                deviation = pa.array(fit.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, fit.n), None, fit.whitened(x).ravel(), np.tile(fit.explained, m), np.full(m * k, fit.error)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(repeated), *(deviation if c is None else pa.array(c) for c in columns)], out.names)

    return rows.mapInArrow(whiten, out)
