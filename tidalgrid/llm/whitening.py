"""Whitening of embeddings: exact covariance in Spark, its eigenvectors by spectral divide and conquer,
and every vector projected and scaled where it lies.

Three passes over the vectors reach the driver as sums only: one number a dimension, one a pair of
dimensions, and one a pair of components.  They grow with the width of the vectors, not with their number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spectral import EPS, eigenvectors

#: Vectors are whole numbers here: x = floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Rows handled at once.
ROWS_AT_ONCE = 16_384


@dataclass
class Whitening:
    """What the fit knows.  ``components``: unit eigenvectors as columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (self.n * x - np.array(self.sums, np.int64)) / self.n

    def varies(self) -> np.ndarray:
        """Which components have any variance beyond rounding."""
        return self.eigenvalues > len(self.sums) * EPS * self.trace

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column a component that varies."""
        on = self.varies()
        return self.centred(x) @ (self.components[:, on] / np.sqrt(self.eigenvalues[on]))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over the dimensions, exact; None where it exceeds a long."""
        far = self.n * x - np.array(self.sums, np.int64)
        most = int(np.abs(far).max(initial=0))
        if most * most * max(1, far.shape[1]) < 1 << 63:
            return (far * far).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in (sum(e * e for e in r) for r in far.tolist())]


def _usable(vector: str) -> Column:
    """No NULL, and no entry that is NULL or not finite."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.col(vector).isNotNull() & ~F.exists(F.col(vector), odd)


def usable_vectors(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector is whole, and its width.  Widths differ in odd tables only: the greatest
    counts, and a narrower vector lacks entries and goes like one with NULLs."""
    whole = df.where(_usable(vector))
    width = whole.agg(F.max(F.size(vector))).first()[0] or 0
    return whole.where(F.size(vector) == width), width


def _integers(column: pa.Array, width: int) -> np.ndarray:
    c = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) * SCALE)
    if np.abs(c).max(initial=0) >= 1 << 52:
        raise ValueError("entries beyond 2**42 have no exact whole number here")
    return c.astype(np.int64) + OFFSET


def _blocks(batches, width: int):
    for b in batches:
        for i in range(0, b.num_rows, ROWS_AT_ONCE):
            piece = b.slice(i, ROWS_AT_ONCE)
            yield piece, _integers(piece.column(piece.num_columns - 1), width)


def _added(vectors: DataFrame, sums, kind: str) -> dict[tuple[int, int], int | float]:
    """``sums(batches)``: a square array a task, added up by Spark entry by entry."""

    def emit(batches):
        total = sums(batches)
        if total is not None:
            i, j = np.indices(total.shape)
            at = np.triu(np.ones(total.shape, bool)) if total.shape[0] == total.shape[1] else np.ones(total.shape, bool)
            yield pa.record_batch({"i": i[at].astype(np.int32), "j": j[at].astype(np.int32), "v": total[at]})

    whole = kind == "bigint"
    value = F.col("v").cast("decimal(38,0)") if whole else F.col("v")  # sums of longs may exceed a long
    added = vectors.mapInArrow(emit, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum(value).alias("v"))
    return {(r.i, r.j): int(r.v) if whole else r.v for r in added.collect()}


def _products(y: np.ndarray) -> np.ndarray:
    """Exact products of whole columns, added over the rows."""
    most = int(np.abs(y).max(initial=0)) ** 2
    if most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    if most * len(y) < 1 << 62:
        return y.T @ y
    if len(y) == 1:
        raise ValueError("entries spread too far for exact products")
    return _products(y[: len(y) // 2]) + _products(y[len(y) // 2 :])


def fit_whitening(vectors: DataFrame, width: int, components: int = 8) -> Whitening | None:
    """Fit on all rows of ``vectors`` (one column, from :func:`usable_vectors`); None without rows or entries.

    Products are taken of whole numbers already centred, to the unit, and the fraction left over is
    taken out in whole numbers too: the covariance is the exact one, rounded once.  Entries beyond 2**42,
    or a spread beyond 2**20, are refused with a ValueError.
    """

    def first(batches):
        total = None
        for _, x in _blocks(batches, width):
            new = np.append(x.sum(axis=0), len(x))[None, :]
            total = new if total is None else total + new
        return total

    if not width:
        return None
    found = _added(vectors, first, "bigint")
    n = found.get((0, width), 0)
    if not n:
        return None
    fit = Whitening(n, [found[0, d] for d in range(width)])
    centre = np.array([(2 * s + n) // (2 * n) for s in fit.sums], np.int64)

    def second(batches):
        total = None
        for _, x in _blocks(batches, width):
            new = _products(x - centre)
            total = new if total is None else total + new
        return total

    products = _added(vectors, second, "bigint")
    rest = [s - n * int(c) for s, c in zip(fit.sums, centre, strict=True)]
    exact = {(i, j): n * p - rest[i] * rest[j] for (i, j), p in products.items()}
    covariance = np.zeros((width, width))
    for (i, j), p in exact.items():
        covariance[i, j] = covariance[j, i] = p / (n * n)
    fit.trace = sum(exact[d, d] for d in range(width)) / (n * n)
    values, turned = eigenvectors(covariance)
    k = min(components, width)
    fit.components, fit.eigenvalues = turned[:, :k], np.maximum(values[:k], 0)

    def third(batches):
        total = None
        for _, x in _blocks(batches, width):
            w = np.column_stack([fit.whitened(x), np.ones(len(x))])
            new = w.T @ w
            total = new if total is None else total + new
        return total

    if on := int(fit.varies().sum()):
        moments = _added(vectors, third, "double")
        fit.identity_error = max(abs(moments[i, j] / n - moments[i, on] * moments[j, on] / n**2 - (i == j)) for i in range(on) for j in range(i, on))
    return fit


SCHEMA = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 8) -> DataFrame:
    """One row for each whole vector and each of the first ``components`` components (or as many as the
    vectors are wide): key, component (from 1), n, deviation, whitened, explained, identity_error.

    A vector that is NULL, or holds NULL or what is not finite, gives no row; nor does an empty vector.  Repeated rows and rows
    without key all count in the fit and give their own rows.  A component without variance (equal vectors, fewer
    rows than dimensions) has whitened NULL and explained 0 (NULL if nothing varies at all); identity_error is over the others,
    NULL without any.  Equal eigenvalues have some orthonormal basis.  An empty table gives an empty
    result.  Only ``vector`` and ``key`` are read, so other columns may have any names.
    """
    whole, width = usable_vectors(df.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector")
    kind = dict(df.select(key).dtypes)[key]
    fit = fit_whitening(whole.select("vector"), width, components)

    def project(batches):
        if fit is None:
            return
        k, on = fit.components.shape[1], fit.varies()
        explained = [None if not fit.trace else float(e / fit.trace) if v else 0.0 for e, v in zip(fit.eigenvalues, on, strict=True)]
        for piece, x in _blocks(batches, width):
            m = len(x)
            whitened = np.zeros((m, k))
            whitened[:, on] = fit.whitened(x)
            yield pa.record_batch([
                piece.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)),
                pa.array(fit.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(whitened.ravel(), mask=np.tile(~on, m)),
                pa.array(explained * m, pa.float64()), pa.array([fit.identity_error] * (m * k), pa.float64())],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.select("key", "vector").mapInArrow(project, f"`{key}` {kind}, {SCHEMA}")
