"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, ``floor(scale * entry)``; each distinct vector
is fitted once, so copies carry no weight.  With X the centred fit rows, the
process alternates the distributed products p = X v and z = X' u: one pass over
the rows per step.  The left vectors u have an entry for each row and are never
stored: u = X w for a w as long as a vector, so a pass over the rows also gives
the products of p with every earlier u, and p is orthogonalised against all of
them (again with a second pass where much cancelled); the right vectors v
are orthogonalised twice on the driver.  What the driver holds is a few
matrices of dimension x steps.

X V = U B with B upper bidiagonal; its small singular value decomposition
B = P S Q' gives the components V Q and the deviations S.  Steps go on until V
spans the whole space, so that repeated deviations are found too; where the
process breaks down it starts again with a new direction.

Defined results: rows whose vector is null, empty, holds a null or a non-finite
entry, or is shorter than the longest one give nothing; copies and repeated
rows each give their rows; an empty table, or fit rows without spread, give no
rows; components without spread (a deviation below 1e-10 of the largest) are
left out; a squared deviation beyond a long is null.  Other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_stage

#: Relative size below which a vector of the process counts as nothing.
TINY = 1e-11


@dataclass
class Whitening:
    """A fit: ``components`` has a column for each of the ``deviations``."""

    n: int
    sums: list[int]
    scale: int
    components: np.ndarray
    deviations: np.ndarray  # singular values over sqrt(n)
    explained: np.ndarray
    identity_error: float


def whole(vector: Column, scale: int) -> Column:
    """``floor(scale * entry)`` as longs; null for a vector that is left out."""
    entry = lambda x: x.cast("double")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(entry(x)) & (F.abs(entry(x)) < float("inf")))
    rows = F.transform(vector, lambda x: F.floor(entry(x) * F.lit(float(scale))).cast("long"))
    return F.when((F.size(vector) > 0) & F.coalesce(fine, F.lit(False)), rows)


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n; the whole part of the mean is taken off exactly."""
    low = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - low) - rest


def _summed(rows: DataFrame, dims: int, length: int, of) -> np.ndarray:
    """The sum over all batches of ``of(matrix)``, an array of ``length``.

    Tasks add up their batches; equal positions are added in sorted order, so
    the result does not depend on which task ends first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(length), False
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                total += of(_rows(batch.slice(at, 4096), dims))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(total)], names=["i", "v"])

    parts = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    out = np.zeros(length)
    for i, v in parts.select("i", F.aggregate("vs", F.lit(0.0), lambda a, x: a + x)).collect():
        out[i] = v
    return out


def _counted(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        n, total = 0, [0] * dims
        for batch in batches:
            x = _rows(batch, dims)
            n += len(x)
            if len(x) and max(int(x.max()), -int(x.min())) * len(x) >= 1 << 62:
                x = x.astype(object)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0))] if len(x) else total
        if n:
            values = pa.array([Decimal(v) for v in [*total, n]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), values], names=["i", "v"])

    found = dict(rows.mapInArrow(run, "i long, v decimal(38,0)").groupBy("i").agg(F.sum("v").cast("decimal(38,0)")).collect())
    return int(found.get(dims, 0)), [int(found.get(i, 0)) for i in range(dims)]


class _Process:
    """The bidiagonalisation; every method with ``_pass`` reads all rows once."""

    def __init__(self, rows: DataFrame, n: int, sums: list[int], seed: int):
        self.rows, self.n, self.sums, self.dims = rows, n, sums, len(sums)
        self.random = np.random.default_rng(seed)
        self.size = 0.0  # the largest product so far
        self.v = np.zeros((self.dims, 0))
        self.w = np.zeros((self.dims, 0))  # u = X w
        self.z = np.zeros((self.dims, 0))  # X' u
        self.alpha: list[float] = []
        self.beta: list[float] = []

    def _pass(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For p = X w: (X' p, U' p, p' p)."""
        d, k, n, sums = self.dims, self.w.shape[1], self.n, self.sums
        columns = np.column_stack([self.w, w])

        def of(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            u = c @ columns
            return np.concatenate([c.T @ u[:, k], u.T @ u[:, k]])

        out = _summed(self.rows, d, d + k + 1, of)
        return out[:d], out[d : d + k], out[-1]

    def _left(self, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(norm, w, z) of p = X w after orthogonalising it against every u."""
        z, along, square = self._pass(w)
        for again in (True, False):
            w = w - self.w @ along
            z = z - self.z @ along
            left = square - along @ along
            self.size = max(self.size, np.sqrt(max(square, 0)))
            if not again or left > 0.5 * square or left <= (TINY * self.size) ** 2:
                break
            z, along, square = self._pass(w)
        norm = np.sqrt(max(left, 0))
        if norm <= TINY * self.size:
            return 0.0, np.zeros(self.dims), np.zeros(self.dims)
        return norm, w / norm, z / norm

    def _outside(self, r: np.ndarray) -> np.ndarray:
        for _ in range(2):
            r = r - self.v @ (self.v.T @ r)
        return r

    def _next(self, r: np.ndarray) -> tuple[float, np.ndarray]:
        """(coupling, unit vector outside V); a new direction if r has nothing left."""
        r, beta = self._outside(r), 0.0
        if (size := np.linalg.norm(r)) > TINY * self.size:
            beta, r = size, self._outside(r / size)
        while (size := np.linalg.norm(r)) < 0.5:
            r = self._outside(self.random.standard_normal(self.dims) / np.sqrt(self.dims))
            beta = 0.0
            if np.linalg.norm(r) > 1e-3:
                r = self._outside(r / np.linalg.norm(r))
        return beta, r / size

    def run(self) -> None:
        beta, v = self._next(np.zeros(self.dims))
        while True:
            u = self.w[:, -1] if self.w.shape[1] else np.zeros(self.dims)
            alpha, w, z = self._left(v - beta * u)
            self.v = np.column_stack([self.v, v])
            self.w = np.column_stack([self.w, w])
            self.z = np.column_stack([self.z, z])
            self.alpha.append(alpha)
            if len(self.alpha) == self.dims:
                return
            beta, v = self._next(z - alpha * v)
            if alpha == 0.0:
                beta = 0.0
            self.beta.append(beta)

    def singular(self) -> tuple[np.ndarray, np.ndarray]:
        """(right singular vectors as columns, singular values), falling."""
        b = np.diag(self.alpha) + np.diag(self.beta, 1) if self.beta else np.diag(self.alpha)
        _, s, qt = np.linalg.svd(b)
        return self.v @ qt.T, s


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", scale: int = 256, components: int = 4, seed: int = 5) -> Whitening | None:
    """Fits on the distinct whole vectors; None without any spread."""
    x = vectors.select(whole(F.col(vector_col), scale).alias("x")).where("x IS NOT NULL")
    dims = x.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return None
    rows = write_stage(x.where(F.size("x") == dims).distinct(), "whitening-fit")
    n, sums = _counted(rows, dims)
    process = _Process(rows, n, sums, seed)
    process.run()
    v, s = process.singular()
    kept = min(components, int((s > 1e-10 * s[0]).sum())) if s[0] > 0 else 0
    if not kept:
        return None
    v, s = v[:, :kept], s[:kept]
    scaled = v * (np.sqrt(n) / s)

    def check(x: np.ndarray) -> np.ndarray:
        c = _centred(x, n, sums)
        y = c @ scaled
        return np.concatenate([[(c * c).sum()], y.sum(axis=0), (y.T @ y).ravel()])

    sums_of = _summed(rows, dims, 1 + kept + kept * kept, check)
    mean = sums_of[1 : kept + 1] / n
    covariance = sums_of[kept + 1 :].reshape(kept, kept) / n - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(kept)).max())
    return Whitening(n, sums, scale, v, s / np.sqrt(n), s * s / sums_of[0], error)


def _transform(fit: Whitening):
    kept, dims = len(fit.deviations), len(fit.sums)
    scaled = fit.components / fit.deviations

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, dims)
            y = _centred(x, fit.n, fit.sums) @ scaled
            far = fit.n * np.abs(x.astype(float)) + np.abs(np.array(fit.sums, dtype=float))
            small = (far * far).sum(axis=1) < 2.0**62
            exact = np.zeros(len(x), dtype=np.int64)
            if small.any():
                away = fit.n * x[small] - np.array(fit.sums, dtype=np.int64)
                exact[small] = (away * away).sum(axis=1)
            deviation = exact.tolist()
            for i in np.flatnonzero(~small):
                value = sum((fit.n * int(a) - s) ** 2 for a, s in zip(x[i], fit.sums))
                deviation[i] = value if value < 1 << 63 else None
            each = np.repeat(np.arange(len(x)), kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), fit.n)),
                    pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(y.ravel()),
                    pa.array(np.tile(fit.explained, len(x))),
                    pa.array(np.full(len(each), fit.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, fit: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col), fit.scale).alias("x"))
    return rows.where(F.col("x").isNotNull() & (F.size("x") == len(fit.sums))).mapInArrow(_transform(fit), schema)
