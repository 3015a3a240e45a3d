"""Operator 13: embedding whitening by pivoted Cholesky and one-sided Jacobi.

An entry c becomes the whole number floor(64 c) + 1,000,000. The covariance of
these vectors is factored by Cholesky with diagonal pivoting, V = L L', which
also finds its rank, and one-sided Jacobi rotations make the columns of L
orthogonal. The squared norms of the rotated columns are the eigenvalues of V,
the normalised columns its eigenvectors; V is never squared nor multiplied
out, so small eigenvalues keep their digits.

Scale: four scans and no exchange of vectors. Two gather sums and the centred
scatter, of which a task sends one entry a dimension or a pair of dimensions;
the third gathers the scatter of the whitened vectors, which gives the error
against the identity as measured, the fourth returns the rows. The driver holds matrices
of dimension x dimension only. Every row is computed from the same model, so
a task that is run again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.llm.common import map_arrow, without

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
TOO_LARGE = 2.0 ** 56  # 64 c no longer fits a long
SWEEPS = 60  # ten are usual
ADDED = ("n", "deviation", "whitened", "explained", "identity_error")


@dataclass
class Whitening:
    """dimension entries a vector; n vectors with sums S; unit rows of components with eigenvalues."""

    dimension: int
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def base(self) -> tuple[np.ndarray, np.ndarray]:
        """S/n as whole numbers k and remainders r: S = n k + r, 0 <= r < n."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        k, r = self.base()
        return (x - k).astype(np.float64) - r / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; None where no long holds it."""
        k, r = self.base()
        near = ((self.n * (x - k).astype(np.float64) - r) ** 2).sum(axis=1)
        fits = near < 2.0 ** 62
        out = [None] * len(x)
        d = self.n * (x[fits] - k) - r
        for i, value in zip(np.flatnonzero(fits), (d * d).sum(axis=1).tolist()):
            out[i] = value
        for i in np.flatnonzero(~fits):
            value = sum((self.n * int(a) - s) ** 2 for a, s in zip(x[i], self.sums))
            out[i] = value if value < 1 << 63 else None
        return out


# -- vectors in Arrow batches ---------------------------------------------------

def whole_numbers(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors remain, and their entries as whole numbers."""
    remains = pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False).to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(remains)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dimension)  # nulls become nan
    fine = (np.abs(values) < TOO_LARGE).all(axis=1)
    remains = remains.copy()
    remains[np.flatnonzero(remains)[~fine]] = False
    return remains, np.floor(values[fine] * SCALE).astype(np.int64) + OFFSET


def _entries(i: np.ndarray, j: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value, pa.float64())], ["i", "j", "value"])


def _sum_up(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for batch in batches:
            _, x = whole_numbers(batch.column("vector"), dimension)
            n += len(x)
            high += (x >> 31).sum(axis=0)
            low += (x & ((1 << 31) - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension), pa.int32()), pa.array(np.full(dimension, n)),
                                              pa.array(high), pa.array(low)], ["i", "n", "high", "low"])
    return run


def _scatter(dimension: int, vectors):
    """Sums of products of the entries of ``vectors(x)``; at j = -1 their own sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sums = 0
        for batch in batches:
            _, x = whole_numbers(batch.column("vector"), dimension)
            if len(x):
                z = vectors(x)
                total, sums = total + z.T @ z, sums + z.sum(axis=0)
        if isinstance(total, np.ndarray):
            i, j = np.triu_indices(len(total))
            yield _entries(i, j, total[i, j])
            yield _entries(np.arange(len(total)), np.full(len(total), -1), sums)
    return run


def _whiten(model: Whitening, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            remains, x = whole_numbers(batch.column("vector"), model.dimension)
            rows, k = len(x), len(model.components)
            own = batch.filter(pa.array(remains))
            places = pa.array(np.arange(rows + 1) * k, pa.int32())
            lists = [pa.ListArray.from_arrays(places, pa.array(v)) for v in
                     (model.project(x).ravel(), np.tile(model.explained, rows))]
            yield pa.RecordBatch.from_arrays(
                [*(own.column(c) for c in names), pa.array(np.full(rows, model.n)), pa.array(model.deviations(x), pa.int64()),
                 *lists, pa.array(np.full(rows, model.identity_error))], [*names, *ADDED])
    return run


# -- the factorisation, dimension x dimension on the driver ------------------------

def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L', as many columns as the rank of v, the largest remaining diagonal entry first."""
    d = len(v)
    factor, rest, pivots = np.zeros((d, d)), v.diagonal().copy(), []
    least = d * np.finfo(float).eps * rest.max(initial=0)
    for k in range(d):
        p = int(rest.argmax())
        if not rest[p] > least:
            return factor[:, :k]
        column = (v[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(rest[p])
        column[pivots] = 0
        column[p] = np.sqrt(rest[p])
        factor[:, k] = column
        rest -= column ** 2
        pivots.append(p)
        rest[pivots] = -np.inf
    return factor


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms, falling, and unit rows: the columns of ``factor`` rotated in pairs until all are orthogonal.

    The pairs of a round have no column in common and turn at once; the rounds of a
    sweep meet every pair, as in a tournament.
    """
    a = np.ascontiguousarray(factor.T)
    if len(a) % 2:
        a = np.vstack([a, np.zeros(a.shape[1])])
    least = max(a.shape) * np.finfo(float).eps
    order, half = np.arange(len(a)), len(a) // 2
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(a) - 1):
            p, q = order[:half], order[half:][::-1]
            x, y = a[p], a[q]
            xx, yy, xy = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            on = np.abs(xy) > least * np.sqrt(xx * yy)
            if on.any():
                turned = True
                p, q, x, y = p[on], q[on], x[on], y[on]
                zeta = (yy[on] - xx[on]) / (2 * xy[on])
                tangent = np.copysign(1, zeta) / (np.abs(zeta) + np.hypot(1, zeta))
                cosine = 1 / np.hypot(1, tangent)
                c, s = cosine[:, None], (cosine * tangent)[:, None]
                a[p], a[q] = c * x - s * y, s * x + c * y
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            break
    norms = (a * a).sum(axis=1)
    first = np.argsort(-norms, kind="stable")[:factor.shape[1]]
    units = a[first] / np.sqrt(norms[first])[:, None]
    signs = np.sign(units[np.arange(len(units)), np.abs(units).argmax(axis=1)])
    return norms[first], units * signs[:, None]


# -- the operator -----------------------------------------------------------------

def _dimension(vectors: DataFrame) -> int:
    """The length that most vectors have, the longer of equals; 0 without vectors."""
    usual = vectors.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).count() \
        .orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return usual[0].d if usual else 0


def _matrix(vectors: DataFrame, function, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the tasks' entries: a symmetric matrix of ``size``, and the sums."""
    total, sums = np.zeros((size, size)), np.zeros(size)
    entries = map_arrow(vectors, function, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    for i, j, value in entries.collect():
        if j < 0:
            sums[i] = value
        else:
            total[i, j] = total[j, i] = value
    return total, sums


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of all remaining rows of ``vectors`` (vector); None if all of them are equal or there are none."""
    d = _dimension(vectors)
    if not d:
        return None
    big = "decimal(38,0)"
    sums = map_arrow(vectors, _sum_up(d), "i int, n bigint, high bigint, low bigint").groupBy("i") \
        .agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(big)).alias("high"), F.sum(F.col("low").cast(big)).alias("low")) \
        .orderBy("i").collect()
    if not sums:
        return None
    none = np.zeros(0)
    model = Whitening(d, sums[0].n, [(int(r.high) << 31) + int(r.low) for r in sums], np.zeros((0, d)), none, none)
    scatter, _ = _matrix(vectors, _scatter(d, model.centred), d)
    covariance = scatter / model.n
    values, units = one_sided_jacobi(pivoted_cholesky(covariance))
    keep = min(components, len(values))
    if not keep:
        return None
    model.components, model.eigenvalues = units[:keep], values[:keep]
    model.explained = model.eigenvalues / covariance.trace()
    products, own = _matrix(vectors, _scatter(d, model.project), keep)
    mean = own / model.n
    model.identity_error = float(np.abs(products / model.n - np.outer(mean, mean) - np.eye(keep)).max())
    return model


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Add n, deviation, whitened (array, a component an entry), explained (array) and identity_error.

    Rows are dropped whose vector is null, empty or holds a null, a
    non-finite entry or one of 2^56 or more (no long holds its whole number),
    and those whose length is not the one that most vectors have. The others
    all stay, repeated ones too. There are as many components as asked for
    or as the rank of the covariance; if it is 0 (one row, equal rows) or the
    table is empty, no row is returned. A deviation that no long holds is null.
    Input columns with the added names are replaced.
    """
    chosen = F.col(f"`{vector}`").cast("array<double>")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ADDED or c == vector], chosen.alias("__vector"))
    passed = [c for c in df.columns[:-1] if c.lower() not in ADDED]
    names = [f"c{i}" for i in range(len(passed))]
    model = fit(df.select(F.col("__vector").alias("vector")), components)
    types = [T.LongType(), T.LongType(), T.ArrayType(T.DoubleType()), T.ArrayType(T.DoubleType()), T.DoubleType()]
    schema = T.StructType([*[T.StructField(n, df.schema[c].dataType) for n, c in zip(names, passed)],
                           *[T.StructField(a, t) for a, t in zip(ADDED, types)]])
    if model is None:
        return df.sparkSession.createDataFrame([], schema).toDF(*passed, *ADDED)
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(passed, names)], F.col("__vector").alias("vector"))
    return map_arrow(rows, _whiten(model, names), schema).toDF(*passed, *ADDED)


def by_component(whitened: DataFrame) -> DataFrame:
    """One row a vector and component: component (from 1), n, deviation, whitened, explained, identity_error."""
    others = [F.col(f"`{c}`") for c in whitened.columns if c not in ADDED]
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "pair")
    return whitened.select(*others, "n", "deviation", "identity_error", pairs).select(
        *others, (F.col("place") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error")
