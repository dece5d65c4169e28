"""Embedding whitening by blockwise QR and a bidiagonal qd solver.

1. One pass sums the vectors as whole numbers, exactly.
2. A second pass centres them and reduces each task's rows to one triangle by QR, block by block; triangles are joined
   in rounds, `fan` to one, until one R is left, whose R'R is n times the covariance. No product of rows is ever formed,
   so small eigenvalues keep their digits.
3. `qd.right_singular` takes R, a matrix as wide as a vector: Householder bidiagonal form, dqds, twisted factorisations.
4. A last pass projects each row. Nothing grows on the driver: sums and R have the size of one vector and its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrid.llm.qd import right_singular
from weekgrid.operators.staging import staged

_ROWS = 4_096
#: Entries that would leave the whole numbers of 64 bits stop here.
_LARGEST = float(1 << 62)


@dataclass(frozen=True)
class Fit:
    """How rows are centred and projected; `sums` are those of the whole numbers over all n rows."""

    n: int
    sums: tuple[int, ...]
    scale: int
    offset: int
    weights: np.ndarray | None = None  # dimension by component, divided by the root of the eigenvalue


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): the rows whose vector has an entry and only finite ones."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite))


def _blocks(batches: Iterator[pa.RecordBatch], fit: Fit) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with their whole numbers."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
            x = np.clip(np.floor(flat.reshape(part.num_rows, -1) * fit.scale), -_LARGEST, _LARGEST).astype(np.int64)
            yield part, x + fit.offset


def _far(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min())))


def _total(fit: Fit):
    """(at, total): each block's sums by dimension; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, fit):
            small = _far(x) < 2**62 // _ROWS
            sums = x.sum(axis=0).tolist() if small else x.astype(object).sum(axis=0).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sums)), pa.int32()), pa.array(map(str, sums), pa.string())], names=["at", "total"]
            )

    return run


def _deviations(fit: Fit, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """x - S/n as doubles, and the exact sum of (n x - S)^2 of each row; None beyond 64 bits."""
    far = fit.n * _far(x) + max(map(abs, fit.sums))
    if far < 2**62:
        d = fit.n * x - np.array(fit.sums, np.int64)
    else:
        d = fit.n * x.astype(object) - np.array(fit.sums, object)
    centred = (d / fit.n).astype(float)
    if far < 2**62 and _far(d) ** 2 * d.shape[1] < 2**63:
        squares = (d * d).sum(axis=1).tolist()
    else:
        squares = [v if v < 2**63 else None for v in (d.astype(object) ** 2).sum(axis=1).tolist()]
    return d, centred, squares


def _row(triangle: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([triangle.ravel()], pa.list_(pa.float64()))], names=["triangle"])


def _stacked(triangle: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """R of the rows under the triangle so far, as a full square."""
    wide = rows.shape[1]
    stack = rows if triangle is None else np.concatenate([triangle, rows])
    r = np.linalg.qr(stack, mode="r")
    return r if len(r) == wide else np.concatenate([r, np.zeros((wide - len(r), wide))])


def _reduce(fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = None
        for _, x in _blocks(batches, fit):
            triangle = _stacked(triangle, _deviations(fit, x)[1])
        if triangle is not None:
            yield _row(triangle)

    return run


def _join(wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = None
        for batch in batches:
            for one in batch.column("triangle"):
                triangle = _stacked(triangle, np.asarray(one.values).reshape(wide, wide))
        if triangle is not None:
            yield _row(triangle)

    return run


def triangle(rows: DataFrame, fit: Fit, fan: int = 32) -> np.ndarray:
    """R of the centred rows."""
    wide = len(fit.sums)
    parts = staged(rows.mapInArrow(_reduce(fit), "triangle array<double>"), "triangles")
    while (left := parts.count()) > 1:
        parts = staged(parts.repartition(-(-left // fan)).mapInArrow(_join(wide), "triangle array<double>"), "triangles")
    return np.array(parts.first()["triangle"]).reshape(wide, wide)


def _project(fit: Fit):
    """A row per vector and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = fit.weights.shape[1]
        for part, x in _blocks(batches, fit):
            _, centred, squares = _deviations(fit, x)
            white = centred @ fit.weights
            again = np.repeat(np.arange(part.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)),
                    pa.array(squares, pa.int64()).take(pa.array(again)),
                    pa.array(white.ravel()),
                ],
                names=["vec_id", "component", "deviation", "whitened"],
            )

    return run


def _moments(fit: Fit):
    """(at, total): each block's sums of whitened values and of their products, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches, fit):
            white = _deviations(fit, x)[1] @ fit.weights
            sums = np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["at", "total"])

    return run


def identity_error(rows: DataFrame, fit: Fit) -> float:
    """Largest entry, in size, of the whitened rows' covariance minus the identity."""
    k = fit.weights.shape[1]
    sums = rows.mapInArrow(_moments(fit), "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    values = np.array([r.total for r in sums]) / fit.n
    mean, products = values[:k], values[k:].reshape(k, k)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, fan: int = 32) -> DataFrame:
    """A row per vector of `vectors` (vec_id, embedding) and component, fitted on all of them.

    An entry c counts as floor(scale * c) + offset. Components are eigenvectors of the covariance (divisor n) by falling
    eigenvalue, the entry largest in size positive. `deviation` is the exact sum over dimensions of (n x - S)^2,
    null beyond 64 bits; `whitened` the projection of x - S/n over the root of the eigenvalue, `explained` the
    eigenvalue over the trace, `identity_error` one value for all.

    Null vectors, empty ones and those with a null or non-finite entry take no part; of several lengths the commonest
    counts (of equally common ones the shortest), others take no part. Entries beyond 2**62 / scale stop there. Repeated
    rows and null vec_ids count and come out as they came in; other columns are not looked at. Where vectors
    vary in fewer than `components` directions there are only as many components: none, and so no row, for an empty table
    or if all vectors are the same.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    lengths = rows.groupBy(F.size("embedding").alias("wide")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), "wide").first()
    if first is None:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.where(F.size("embedding") == first.wide)
    fit = Fit(first.n, (0,) * first.wide, scale, offset)
    sums = rows.mapInArrow(_total(fit), "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    fit = Fit(first.n, tuple(int(r.total) for r in sums.orderBy("at").collect()), scale, offset)
    r = triangle(rows, fit, fan)
    squares, directions = right_singular(r, components)
    if not directions.shape[1]:
        return spark.createDataFrame([], SCHEMA)
    shares = [float(s) for s in squares[: directions.shape[1]] / float((r * r).sum())]
    weights = directions / np.array([sqrt(s / fit.n) for s in squares[: directions.shape[1]]])
    fit = Fit(fit.n, fit.sums, scale, offset, weights)
    error = identity_error(rows, fit)
    projected = rows.mapInArrow(_project(fit), "vec_id long, component int, deviation long, whitened double")
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("component"))
    return projected.select(
        "vec_id", "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"),
    )
