"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Vectors are whole numbers (floor(1024 * component)), so sums and scatter are exact: a first pass adds components up, a
second one centres vectors on the rounded mean and multiplies them in halves of 14 bits, whose products a double holds
exactly. The covariance V is rounded once, entry by entry. With P'VP = LL', rotating pairs of columns of L until all are
orthogonal gives L J = U S: the squared norms of the columns are V's eigenvalues, the columns at length 1 its components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import small_batches
from groundspark.llm.integers import exact_sums, integer_vectors, matrix

COMPONENTS = 8
#: Bits of a half; products of two halves, added over a batch, fit a double's 53 bits.
HALF = 14
#: Sweeps of rotations at most; they settle after six or seven.
SWEEPS = 60
SHIFT = 100_000


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (d x rank), in v's order of rows, with v = LL': the largest remaining diagonal entry leads each step, of those
    that are more than rounding of their first value."""
    rest, out = v.astype(np.float64).copy(), []
    least = len(v) * np.finfo(float).eps * v.diagonal()
    for _ in range(len(v)):
        left = np.where(rest.diagonal() > least, rest.diagonal(), 0)
        p = int(left.argmax())
        if left[p] <= 0:
            break
        column = rest[:, p] / np.sqrt(rest[p, p])
        rest -= np.outer(column, column)
        rest[p], rest[:, p] = 0, 0  # exactly, so that later columns are 0 in this row
        out.append(column)
    return np.column_stack(out) if out else np.zeros((len(v), 0))


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of factor @ factor.T, from rotations of factor's columns."""
    g = factor.T.copy()  # columns as rows
    least = max(1, len(factor)) * np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for i in range(len(g) - 1):
            for j in range(i + 1, len(g)):
                a, b, c = g[i] @ g[i], g[j] @ g[j], g[i] @ g[j]
                if abs(c) <= least * np.sqrt(a * b):
                    continue
                turned = True
                z = (b - a) / (2 * c)
                t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.hypot(1, z))
                cos = 1 / np.hypot(1, t)
                g[i], g[j] = cos * (g[i] - t * g[j]), cos * (g[j] + t * g[i])
        if not turned:
            break
    values = (g**2).sum(1)
    order = np.argsort(-values, kind="stable")
    values, g = values[order], g[order]
    return values, (g / np.sqrt(np.where(values > 0, values, 1))[:, None]).T


@dataclass
class Whitener:
    n: int
    sums: list[int]  # of floor(1024 * c); those of the contract's x are SHIFT * n more
    centre: np.ndarray  # rounded means
    rest: np.ndarray  # sums - n * centre
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, columns
    trace: float

    def whitened(self, x: np.ndarray, most: int) -> np.ndarray:
        """Projections on the components of positive eigenvalue, over the root of the eigenvalue."""
        m = min(most, int((self.values > 0).sum()))
        return ((x - self.centre) - self.rest / self.n) @ (self.vectors[:, :m] / np.sqrt(self.values[:m]))

    def deviation(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of (n * x - sums)^2 of each row, exact, and where it fits a long."""
        if self.n >= 1 << 34:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        t = self.n * (x - self.centre) - self.rest
        return (t * t).sum(1), (t.astype(np.float64) ** 2).sum(1) < 9.2e18  # overflows wrap where they don't count


def scatter(rows: DataFrame, centre: np.ndarray) -> list[list[int]]:
    """Products of the vectors' components, centred on whole numbers, added up exactly."""
    width = len(centre)
    i, j = np.triu_indices(width)

    def run(batches):
        sums = np.zeros((3, len(i)), np.int64)
        for batch in batches:
            if batch.num_rows:
                z = matrix(batch.column(1), batch.num_rows) - centre
                low, high = (z & ((1 << HALF) - 1)).astype(np.float64), (z >> HALF).astype(np.float64)
                cross = low.T @ high
                for part, product in enumerate((low.T @ low, cross + cross.T, high.T @ high)):
                    sums[part] += product[i, j].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(3), len(i)), pa.int32()), pa.array(np.tile(np.arange(len(i)), 3), pa.int32()), pa.array(sums.ravel())], names=["part", "at", "value"])

    found = exact_sums(rows.mapInArrow(run, "part int, at int, value long"), ["part", "at"])
    out = [[0] * width for _ in range(width)]
    for at, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        out[a][b] = out[b][a] = sum(found[part, at] << (HALF * part) for part in range(3))
    return out


def fit(rows: DataFrame) -> Whitener | None:
    """Mean, covariance (divisor n), eigenvalues and components of all rows (integers.integer_vectors); None without rows.

    Two passes; the driver gets sums of components and of their products only, which don't grow with the table."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), batch.num_rows)
                own = np.append(x.sum(0), batch.num_rows)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "value"])

    found = exact_sums(rows.mapInArrow(run, "at int, value long"), ["at"])
    if not found:
        return None
    *sums, n = (found[k,] for k in range(len(found)))
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    products = scatter(rows, np.array(centre, np.int64))
    # whole numbers until the one division
    v = np.array([[(n * m - a * b) / (n * n) for m, b in zip(line, rest, strict=True)] for line, a in zip(products, rest, strict=True)])
    values, vectors = one_sided_jacobi(pivoted_cholesky(v))
    return Whitener(n, sums, np.array(centre, np.int64), np.array(rest, np.int64), values, vectors, float(np.trace(v)))


def identity_error(rows: DataFrame, whitener: Whitener, components: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured over all rows in a pass of its own."""
    m = min(components, int((whitener.values > 0).sum()))

    def run(batches):
        sums = np.zeros((m + 1, m))
        for batch in batches:
            if batch.num_rows:
                w = whitener.whitened(matrix(batch.column(1), batch.num_rows), components)
                sums += np.vstack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size), pa.int32()), pa.array(sums.ravel())], names=["at", "value"])

    if not m:
        return 0.0
    found = {r["at"]: r["value"] for r in rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    sums = np.array([found[k] for k in range((m + 1) * m)]).reshape(m + 1, m) / whitener.n
    return float(np.abs(sums[:m] - np.outer(sums[m], sums[m]) - np.eye(m)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding", width: int | None = None) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector that takes part
    and component, up to `components`.

    Which vectors take part, integers.integer_vectors says; without a width, the one most vectors have. Repeated rows
    each count, null ids stay. Only components of positive eigenvalue are returned: vectors that are all equal, or one
    alone, give no rows, for nothing can be divided by 0. deviation is null where it doesn't fit a long.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_vectors(vectors, id_col, vec_col, width)
    whitener = fit(rows)
    if whitener is None:
        return spark.createDataFrame([], schema)
    error = identity_error(rows, whitener, components)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), batch.num_rows)
                w = whitener.whitened(x, components)
                rows, m = w.shape
                deviation, fits = whitener.deviation(x)
                own = np.repeat(np.arange(rows), m)
                share = whitener.values[:m] / whitener.trace if m else np.zeros(0)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(own)), pa.array(np.tile(np.arange(1, m + 1), rows), pa.int32()), pa.array(np.full(rows * m, whitener.n)),
                    pa.array(deviation[own], mask=~fits[own]), pa.array(w.ravel()), pa.array(np.tile(share, rows)), pa.array(np.full(rows * m, error)),
                ], names=names)

    return rows.mapInArrow(run, schema)


def report(vectors: DataFrame) -> DataFrame:
    """Rows of query op12. Its x has SHIFT added to every component, which changes sums, but neither n * x - S nor V."""
    return whiten(vectors).withColumnRenamed("id", "vec_id")
