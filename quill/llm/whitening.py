"""Whitening of embeddings: components of the covariance by cyclic Jacobi rotations.

Vectors are put on a grid of whole numbers, so counts, sums and, as far as
doubles hold whole numbers exactly, the centred scatter are exact: no result
depends on how rows are dealt to tasks. Three scans of the table each send
sums per partition; the driver gets a matrix of dimensions by dimensions,
turns it diagonal, and sends the projection back with the tasks. No rows are
shuffled, and no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released
from .vectors import by_length, is_whole, scaled

#: The grid of the query: floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Sweeps over all pairs of dimensions at most; some ten are needed.
SWEEPS = 100
LONG = 2**63


class Whitening(NamedTuple):
    """A fit over n vectors on a grid."""

    scale: float
    offset: int
    n: int
    sums: tuple[int, ...]  # per dimension, exact
    centre: np.ndarray  # the whole number next to each mean
    rest: np.ndarray  # mean - centre
    values: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # unit eigenvectors, as columns

    @property
    def trace(self) -> float:
        return float(self.values.sum())

    def positive(self) -> np.ndarray:
        """Which eigenvalues are more than rounding."""
        return self.values > len(self.values) * np.finfo(float).eps * max(self.trace, 0.0)

    def projection(self, components: int) -> np.ndarray:
        """Columns that take centred vectors to whitened ones; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            divisor = np.where(self.positive(), np.sqrt(self.values), np.nan)
        return (self.vectors / divisor)[:, :components]


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix.

    A sweep meets every pair of dimensions once, in rounds of disjoint pairs
    that turn together. A pair rests when its entry is below rounding measured
    by its own two diagonal entries, which keeps small eigenvalues accurate.
    The largest entry of each eigenvector is positive.
    """
    a = np.array(matrix, np.float64)
    d = len(a)
    v, eps = np.eye(d), np.finfo(float).eps
    least = np.finfo(float).tiny
    seats = np.arange(d + d % 2)
    half = len(seats) // 2
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[:half], seats[half:][::-1]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            there = (p < d) & (q < d)
            p, q = p[there], q[there]
            live = np.abs(a[p, q]) > np.maximum(eps * np.sqrt(np.abs(a[p, p] * a[q, q])), least)
            p, q = p[live], q[live]
            if not len(p):
                continue
            turned = True
            pp, qq, pq = a[p, p], a[q, q], a[p, q]
            with np.errstate(over="ignore"):
                slope = (qq - pp) / (2 * pq)
                t = np.where(slope < 0, -1.0, 1.0) / (np.abs(slope) + np.sqrt(1 + slope * slope))
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            for m in (a, v):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            a[p, p], a[q, q] = pp - t * pq, qq + t * pq
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    else:
        raise ArithmeticError("the off-diagonal entries do not vanish")
    order = np.argsort(-a.diagonal(), kind="stable")
    v = v[:, order]
    peak = v[np.abs(v).argmax(axis=0), np.arange(d)] if d else np.zeros(0)
    return a.diagonal()[order].copy(), v * np.where(peak < 0, -1.0, 1.0)


def _summed(scale: float, offset: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in arrow:
            for rows, matrix in by_length(batch.column(0)):
                x = scaled(matrix, scale, offset)
                # Two halves of 32 bits, so no sum of a batch leaves a long.
                sums = [(h << 32) + low for h, low in zip((x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist())]
                n, before = found.get(x.shape[1], (0, [0] * x.shape[1]))
                found[x.shape[1]] = n + len(rows), list(map(sum, zip(before, sums)))
        for d, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(Decimal, sums), pa.decimal128(38, 0))],
                names=["dims", "dim", "n", "s"],
            )

    return run


def _centred(batch: pa.Array, scale: float, offset: int, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose vectors have the fit's length, those on the grid, less the centre)"""
    for rows, matrix in by_length(batch):
        if matrix.shape[1] == len(centre):
            return rows, scaled(matrix, scale, offset) - centre
    return np.zeros(0, np.int64), np.zeros((0, len(centre)), np.int64)


def _scatter(of):
    """Sums of products of the columns that of(vectors) gives, a row per pair of columns."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in arrow:
            y = of(batch.column(0))
            total = total + y.T @ y
        if isinstance(total, np.ndarray):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    return run


def _symmetric(parts: DataFrame, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    column = F.col(vector).cast("array<double>")
    return df.select(column.alias("_v")).filter(is_whole(F.col("_v")))


def fit(df: DataFrame, vector: str = "embedding", scale: float = SCALE, offset: int = OFFSET) -> Whitening | None:
    """The components of all whole vectors of df, on the grid floor(scale * entry) + offset.

    Rows whose vector is null or holds a null or non-finite entry count for
    nothing. Where vectors differ in length, the length that most rows have is
    fitted (of equals the shorter). Repeated rows count each. None without any
    vector of one entry or more.
    """
    rows = _vectors(df, vector)
    sums = rows.mapInArrow(released(_summed(scale, offset)), "dims int, dim int, n long, s decimal(38,0)").groupBy("dims", "dim").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    most = sums.groupBy("dims").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "s"))).alias("s")).orderBy(F.desc("n"), "dims").first()
    if most is None:
        return None
    n, totals = most.n, tuple(int(x.s) for x in most.s)
    centre = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)
    rest = np.array([(s - int(c) * n) / n for s, c in zip(totals, centre)])
    whole = _scatter(lambda column: _centred(column, scale, offset, centre)[1].astype(np.float64))
    about = _symmetric(rows.mapInArrow(released(whole), "i int, j int, v double"), len(totals))
    values, vectors = jacobi(about / n - np.outer(rest, rest))
    return Whitening(scale, offset, n, totals, centre, rest, values, vectors)


def whiten(df: DataFrame, fitted: Whitening, key: str = "vec_id", vector: str = "embedding", components: int | None = None) -> DataFrame:
    """key, deviation long, distance2 double, whitened array<double> for each row of df that could be fitted.

    whitened has a number per component, by falling eigenvalue: null for a
    component without variance. deviation is the sum over dimensions of
    (n * x - sum)^2, exact, or null where a long does not hold it (beyond some
    million vectors); distance2, its n^2-th part, is the squared distance from
    the mean. Rows that fit() leaves out give none; repeated rows, and null or
    repeated keys, give one each. Other columns of df are not looked at.
    """
    d = len(fitted.sums)
    left = np.array([int(s) - fitted.n * int(c) for s, c in zip(fitted.sums, fitted.centre)], object)
    projection, n = fitted.projection(components or d), fitted.n

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            rows, y = _centred(batch.column(1), fitted.scale, fitted.offset, fitted.centre)
            most = n * (int(np.abs(y).max(initial=0)) + 1)
            kind = np.int64 if d * most * most < LONG else object
            exact = ((n * y.astype(kind) - left.astype(kind)) ** 2).sum(axis=1).tolist() if len(rows) else []
            x = y - fitted.rest
            flat = pa.array((x @ projection).ravel(), from_pandas=True)  # NaN: null
            ends = np.arange(len(rows) + 1, dtype=np.int32) * projection.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([e if e < LONG else None for e in exact], pa.int64()), pa.array((x * x).sum(axis=1)), pa.ListArray.from_arrays(pa.array(ends), flat)],
                names=["key", "deviation", "distance2", "whitened"],
            )

    keyed = df.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v")).filter(is_whole(F.col("_v")))
    kind = keyed.schema["_k"].dataType.simpleString()
    out = keyed.mapInArrow(released(run), f"key {kind}, deviation long, distance2 double, whitened array<double>")
    return out.withColumnRenamed("key", key)


def identity_error(df: DataFrame, fitted: Whitening, vector: str = "embedding", components: int | None = None) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity; None if no component has variance."""
    projection = fitted.projection(components or len(fitted.sums))
    projection = projection[:, ~np.isnan(projection).any(axis=0)]
    if not projection.shape[1]:
        return None
    white = _scatter(lambda column: (_centred(column, fitted.scale, fitted.offset, fitted.centre)[1] - fitted.rest) @ projection)
    found = _symmetric(_vectors(df, vector).mapInArrow(released(white), "i int, j int, v double"), projection.shape[1])
    return float(np.abs(found / fitted.n - np.eye(projection.shape[1])).max())


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector and component up to COMPONENTS of the whole table; see fit() and whiten() for odd rows."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fitted = fit(table)
    if fitted is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(table, fitted, components=COMPONENTS)
    rows = whiten(table, fitted, components=COMPONENTS).select(F.col("vec_id").cast("long").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = fitted.values[:COMPONENTS] / fitted.trace if fitted.trace > 0 else []
    explained = F.element_at(F.array(*map(F.lit, map(float, shares))).cast("array<double>"), F.col("at") + 1) if len(shares) else F.lit(None).cast("double")
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
