"""Principal components of embeddings and their whitened coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import feast
from .common import cut, forget

#: Entries of this size and more count as not finite: 64 times them would come near the bounds of a long.
TOO_LARGE = 2.0**56


@dataclass
class Whitening:
    """n fit vectors with sums by dimension; values and vectors (a row each) of the components, falling; trace of the covariance; the largest departure of the
    whitened fit vectors' covariance from the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def steps(vector: Column) -> Column:
    """floor(64 * entry) + 1000000 of each entry, as longs; null for what has no use: no vector, an empty one, or one with an entry that is null or not finite."""
    sane = (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c) < TOO_LARGE, F.lit(False)))  # NaN is above all
    return F.when(sane, F.transform(vector, lambda c: F.floor(c.cast("double") * 64) + F.lit(1_000_000).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _gram(rows: DataFrame, d: int, made) -> np.ndarray:
    """The sum over all rows of made(x)' made(x), d x d: a matrix for each task, then sums by its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            y = made(_matrix(b.column(0)))
            total += y.T @ y if len(y) else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.select("x").mapInArrow(run, "i int, row array<double>")
    summed = parts.groupBy("i").agg(F.array(*[F.sum(F.get("row", F.lit(j))) for j in range(d)]).alias("row")).collect()
    out = np.zeros((d, d))
    for r in summed:
        out[r["i"]] = r["row"]
    return out


def fit(vectors: DataFrame, column: str = "embedding", components: int = 16) -> Whitening:
    """The largest components of the distinct vectors' covariance, in steps of 1/64.

    Vectors that steps() gives none for have no part; of those left, vectors of another length than most have (the greatest among equals) have none either. Distinct
    vectors are written once; counts and sums are exact; the covariance is summed from vectors centred before, a matrix of dimension squared for each task, and is all that comes to the driver.
    Each task then extracts the components of one interval. Components of zero variance are left out: one distinct vector has none, and no vector has none."""
    spark = vectors.sparkSession
    distinct = cut(vectors.select(steps(F.col(column)).alias("x")).where("x is not null").distinct(), "whitening")
    sizes = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        forget(distinct)
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    d, n = sizes[0]
    rows = distinct.where(F.size("x") == d)
    sums = np.zeros(d, np.int64)
    for r in rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).collect():
        sums[r["i"]] = r["s"]
    covariance = _gram(rows, d, lambda x: (x * n - sums) / n) / n
    covariance = (covariance + covariance.T) / 2
    values, parts = _components(spark, covariance, components)
    error = 0.0
    if len(values):
        weights = parts.T / np.sqrt(values)
        inner = _gram(rows, len(values) + 1, lambda x: np.column_stack([(x * n - sums) / n @ weights, np.ones(len(x))])) / n
        error = float(np.abs(inner[:-1, :-1] - np.outer(inner[-1, :-1], inner[-1, :-1]) - np.eye(len(values))).max())
    forget(distinct)
    return Whitening(n, sums, values, parts, float(np.trace(covariance)), error)


def _components(spark, covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    pieces = feast.intervals(*feast.tridiagonal(covariance), k)
    if not pieces:
        return np.zeros(0), np.zeros((0, len(covariance)))
    shared = spark.sparkContext.broadcast(covariance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                e, x = feast.extracted(shared.value, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(list(x.T), pa.list_(pa.float64()))], ["e", "v"])

    rows = spark.createDataFrame(pieces, "low double, high double, count int").repartition(len(pieces)).mapInArrow(run, "e double, v array<double>").collect()
    shared.unpersist()
    best = sorted(rows, key=lambda r: -r["e"])[:k]
    together, _ = np.linalg.qr(np.array([r["v"] for r in best]).T)  # intervals know nothing of each other: their vectors are at right angles but for rounding
    return np.array([r["e"] for r in best]), together.T


def whitened(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """(row, deviation, whitened): each row of vectors that the fit could use, whole, with the sum over dimensions of (n * x - sums)^2, exact, and its coordinate on each component.

    A deviation beyond a long raises. Rows whose vector is null, empty, of another length, or holds an entry that is null or not finite are left out. Repeated rows
    stay; other columns may have any name. Nothing is shuffled. A model without vectors gives no rows."""
    n, sums = model.n, model.sums
    d = len(sums)
    weights = model.vectors.T / np.sqrt(model.values) if len(model.values) else np.zeros((d, 0))

    @F.arrow_udf("deviation long, whitened array<double>")
    def placed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            x = _matrix(b)
            if not len(x):
                x = x.reshape(0, d)
            if len(x) and (float(n) * np.abs(x).max() > 9e18 or ((n * x.astype(float) - sums) ** 2).sum(1).max() > 9.2e18):
                raise OverflowError("a deviation is beyond a long")
            y = n * x - sums
            w = y / max(n, 1) @ weights
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1], pa.int32())
            yield pa.StructArray.from_arrays([pa.array((y * y).sum(1), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["deviation", "whitened"])

    usable = vectors.select(F.struct("*").alias("row"), steps(F.col(column)).alias("x")).where((F.size("x") == max(d, 1)) & F.col("x").isNotNull())
    return usable.select("row", placed("x").alias("p")).select("row", "p.deviation", "p.whitened")
