"""Embedding whitening: a distributed centred covariance, its leading components by Householder reflections, Sturm counts and inverse
iteration, and a projection of every vector in its own row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, quoted, settle

COMPONENTS = 4
SCALE = 256
# A covariance of this many dimensions is what the driver may hold; longer vectors are refused.
MAX_DIMENSION = 4096
# Numbers of one step of a task.
STEP = 1 << 20
# Bound on |n * x - S|: squares of the halves of such a number can be added up over MAX_DIMENSION dimensions in 64 bits.
EXACT = 1 << 49
HALF = 24
EPS = float(np.finfo(float).eps)


# ---- leading eigenpairs of a symmetric matrix ---------------------------------------------------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflectors of Householder's reduction of a symmetric matrix."""
    a = a.astype(float, copy=True)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.abs(x).max()
        v = np.zeros_like(x)
        if size > 0:
            # Scaled, so that no square under- or overflows.
            v = x / size
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            block = a[k + 1:, k + 1:]
            p = 2 * (block @ v)
            w = p - (v @ p) * v
            block -= np.outer(v, w) + np.outer(w, v)
            a[k + 1:, k] = x - 2 * (v @ x) * v
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def count_below(d: np.ndarray, e2: np.ndarray, x: float, tiny: float) -> int:
    """Sturm count: eigenvalues of the tridiagonal matrix (diagonal ``d``, squared off-diagonal ``e2``) below ``x``."""
    below, q = 0, 1.0
    for i in range(len(d)):
        q = d[i] - x - (e2[i - 1] / q if i else 0.0)
        if abs(q) < tiny:
            q = -tiny
        below += q < 0
    return below


def eigenvalue(d: np.ndarray, e: np.ndarray, rank: int) -> float:
    """The ``rank``-th largest eigenvalue (from 0), by bisection."""
    off = np.concatenate([[0.0], np.abs(e), [0.0]])
    radius = off[:-1] + off[1:]
    low, high = float((d - radius).min()), float((d + radius).max())
    norm = max(abs(low), abs(high), np.finfo(float).tiny)
    tiny, e2 = max(np.finfo(float).tiny, EPS * EPS * norm), (e * e).tolist()
    diagonal = d.tolist()
    low, high = low - 2 * EPS * norm, high + 2 * EPS * norm
    wanted = len(d) - rank  # as many eigenvalues are not above it
    while high - low > 2 * EPS * max(abs(low), abs(high)) + tiny:
        middle = low + (high - low) / 2
        if middle in (low, high):
            break
        if count_below(diagonal, e2, middle, tiny) >= wanted:
            high = middle
        else:
            low = middle
    return low + (high - low) / 2


def shifted_solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; a vanishing pivot counts as ``tiny``."""
    n = len(d)
    main, upper, second, x = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    lower = e.copy()
    for i in range(n - 1):
        if abs(main[i]) >= abs(lower[i]):
            pivot = main[i] if abs(main[i]) > tiny else tiny
            main[i] = pivot
            f = lower[i] / pivot
            main[i + 1] -= f * upper[i]
            x[i + 1] -= f * x[i]
        else:
            f = main[i] / lower[i]
            main[i], old = lower[i], upper[i]
            upper[i], main[i + 1] = main[i + 1], old - f * main[i + 1]
            second[i], upper[i + 1] = upper[i + 1], -f * upper[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for i in reversed(range(n)):
        x[i] -= (upper[i] * x[i + 1] if i + 1 < n else 0.0) + (second[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] /= main[i]
    return x


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Vectors of eigenvalues closer than a thousandth of the matrix's norm are kept orthogonal to one another at every step of the
    inverse iteration.
    """
    n = len(a)
    k = min(k, n)
    scale = float(np.abs(a).max()) or 1.0
    d, e, reflectors = tridiagonal(a / scale)
    values = np.array([eigenvalue(d, e, j) for j in range(k)])
    norm = float(np.abs(d).max() + 2 * (np.abs(e).max() if n > 1 else 0.0)) or 1.0
    seeds = np.random.default_rng(13)
    vectors = np.zeros((n, k))
    for j in range(k):
        cluster = [i for i in range(j) if values[i] - values[j] < 1e-3 * norm]
        # Equal eigenvalues get shifts that differ, or every solve would run into the same vector.
        shift = values[j] - 2 * EPS * norm * sum(values[i] - values[j] <= 4 * EPS * norm for i in cluster)
        z = seeds.standard_normal(n)
        for _ in range(6):
            z = shifted_solve(d, e, shift, z / np.abs(z).max(), EPS * norm)
            for _ in range(2):
                for i in cluster:
                    z = z - (vectors[:, i] @ z) / (vectors[:, i] @ vectors[:, i]) * vectors[:, i]
            z /= np.linalg.norm(z)
        vectors[:, j] = z
    for m in reversed(range(len(reflectors))):
        v = reflectors[m]
        vectors[m + 1:] -= 2 * np.outer(v, v @ vectors[m + 1:])
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)


# ---- sums over vectors --------------------------------------------------------------------------------------------------

def matrices(batches: Iterator[pa.RecordBatch], at: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with column ``at`` as a matrix of 64-bit integers."""
    rows = max(STEP // dims, 1)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def column_sums(vectors: DataFrame, dims: int, make: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sums of the columns of ``make(x)`` over all vectors x; a task hands on one row a column."""
    def run(batches):
        total = None
        for _, x in matrices(batches, 0, dims):
            part = make(x).sum(axis=0)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    out = vectors.mapInArrow(run, f"i long, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()
    return out["v"].to_numpy()


def products(vectors: DataFrame, dims: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of the outer products of the rows of ``make(x)`` with themselves. A task adds up its own and hands on the lower half once,
    a row for each dimension; the halves are added by Spark."""
    def run(batches):
        total = None
        for _, x in matrices(batches, 0, dims):
            y = make(x)
            total = y.T @ y if total is None else total + y.T @ y
        for i in range(0 if total is None else len(total)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[i, : i + 1]])], names=["i", "v"])

    parts = vectors.mapInArrow(run, "i long, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    half = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    i, j = half["i"].to_numpy(), half["j"].to_numpy()
    out = np.zeros((i.max() + 1,) * 2)
    out[i, j] = out[j, i] = half["v"].to_numpy()
    return out


@dataclass
class Whitening:
    n: int                     # distinct vectors
    sums: np.ndarray           # of each dimension over them
    values: np.ndarray         # leading eigenvalues of their covariance, falling
    vectors: np.ndarray        # unit components as columns
    trace: float
    identity_error: float = 0.0

    def moved(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * x - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.moved(x) / float(self.n)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[Decimal]:
        """The sum of the squares of n * x - S, exact: squares of halves are added in 64 bits and put together as unbounded integers."""
        y = self.moved(x)
        high, low = y >> HALF, y & ((1 << HALF) - 1)
        parts = [(high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)]
        return [Decimal((int(a) << (2 * HALF)) + (int(b) << (HALF + 1)) + int(c)) for a, b, c in zip(*parts, strict=True)]


def usable(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(_key, x) with x = floor(SCALE * c) as integers, and the dimension; rows that take no part are left out."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    some = only(df, _key=key, _v=vector).filter(F.col("_v").isNotNull() & (F.size("_v") > 0)).withColumn("_v", F.col("_v").cast("array<double>")).filter(F.forall("_v", finite))
    most = F.array_max(F.transform("_v", F.abs))
    census = some.groupBy(F.size("_v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(most).alias("most")).orderBy(F.desc("n"), F.desc("dims")).first()
    if census is None:
        return some, 0
    if census["dims"] > MAX_DIMENSION:
        raise ValueError(f"vectors of more than {MAX_DIMENSION} dimensions")
    if census["most"] * SCALE >= 1 << 31:
        raise ValueError(f"a component of {census['most']} or beyond does not fit 32 bits when multiplied by {SCALE}")
    x = F.transform("_v", lambda c: F.floor(c * SCALE).cast("int"))
    return some.filter(F.size("_v") == census["dims"]).select("_key", x.alias("x")), census["dims"]


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """Learn from ``vectors`` (x), each distinct one once. None where nothing varies."""
    distinct = settle(vectors.select("x").distinct())
    n = distinct.count()
    sums = column_sums(distinct, dims, lambda x: x, "long").astype(np.int64)
    farthest = int(distinct.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c.cast("long")))))).first()[0])
    if n * farthest + int(np.abs(sums).max()) > EXACT:
        raise ValueError("so many vectors of so large numbers can't be centred exactly in 64 bits")
    model = Whitening(n, sums, np.empty(0), np.empty((dims, 0)), 0.0)
    covariance = products(distinct, dims, model.centred) / n
    model.trace = float(np.trace(covariance))
    values, found = leading(covariance, components)
    # What is left of an eigenvalue of zero after rounding is no component.
    kept = values > dims * EPS * model.trace
    if not kept.any():
        return None
    model.values, model.vectors = values[kept], found[:, kept]
    means = column_sums(distinct, dims, model.project, "double") / n
    white = products(distinct, dims, lambda x: model.project(x) - means) / n
    model.identity_error = float(np.abs(white - np.eye(len(white))).max())
    return model


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    ``whitened`` is the centred vector on a unit component over the root of its eigenvalue, ``explained`` the eigenvalue's share of the
    trace, ``deviation`` the exact squared length of n * x - S, ``identity_error`` how far the covariance of what was whitened is from
    the identity. The fit takes each distinct vector once, so copies and repeated rows do not weigh; every row, repeated ones and null keys
    too, is projected. Rows take no part if their vector is null, empty, holds null or a non-finite number, or has another length than most have
    (of equally frequent lengths, the longest counts). Components whose eigenvalue is zero but for rounding have no rows, so a table
    without rows, or with one distinct vector, gives none. Other columns are not read. The driver holds one covariance, of at most
    MAX_DIMENSION dimensions; larger vectors and numbers raise an error.
    """
    rows, dims = usable(df, key, vector)
    kind = rows.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(rows, dims, components) if dims else None
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("_key", key)
    k = len(model.values)

    def run(batches):
        for part, x in matrices(batches, 1, dims):
            again = np.repeat(np.arange(len(x)), k)
            columns = [part.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(again), model.n)),
                       pa.array(model.deviation(x), pa.decimal128(38, 0)).take(pa.array(again)), pa.array(model.project(x).ravel()),
                       pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(len(again), model.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).select(F.col("_key").alias(key), *[F.col(quoted(c)) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")])
