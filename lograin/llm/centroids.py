"""Centroid clustering with PCA-rotated filtering.

Vectors become integers once and are stored with their leading coordinates in the frame of the
principal axes and the norm of what is left. For a vector x and a centroid c,

    |Px - Pc|^2 + (|Rx| - |Rc|)^2  <=  |x - c|^2

with P the leading rotated coordinates and R the rest: the lower bounds of all centroids
cost a few dimensions each. The centroid with the least bound is measured first, in
integers; only centroids whose bound stays within that distance are measured too, in integers as
well, so the nearest one is exact and ties go to the smaller number. A relative and an
absolute slack far above the rounding of doubles keep every tie among the survivors.

The axes come from the covariance of all vectors, summed up in the tasks; any rotation
gives right results, a good one gives few survivors. Rounds are passes over the stored
table without a shuffle of vectors: tasks return sums per cluster. The driver holds the
centroids, ``k`` rows of ``dims`` integers, and one matrix of dims x dims.

Defined cases: vectors of another length, null, or with null or non-finite components are
left out; rows that repeat an id, or have none, are vectors of their own (those without one start
no centroid before all others); equal hashes are ordered by vector; fewer than
``k`` vectors give as many centroids; an empty table gives no rows; other columns are
ignored. Components may have any finite size; a distance that exceeds a long fails the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograin.session import materialize

LEADING = 32
#: Far above the rounding of sums of doubles, far below what would keep a farther centroid.
SLACK = 1e-9
SUMS = "cluster int, dim int, total string, n long"
ASSIGNED = "vec_id long, cluster int, distance long, measured int"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dims)


def _exact(values: np.ndarray) -> np.ndarray:
    """Whole-numbered doubles as integers whose squared distances cannot wrap."""
    small = float(np.abs(values).max(initial=0)) < 2.0**27
    return values.astype(np.int64) if small else np.vectorize(int, otypes=[object])(values)


class Frame:
    """Principal axes: leading coordinates and residual norm of vectors."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray):
        self.mean, self.axes = mean, axes

    @classmethod
    def fit(cls, n: int, sums: np.ndarray, products: np.ndarray, leading: int) -> Frame:
        mean = sums / max(n, 1)
        covariance = products / max(n, 1) - np.outer(mean, mean)
        if not np.isfinite(covariance).all():
            return cls(np.zeros_like(mean), np.eye(len(mean))[:, :leading])
        return cls(mean, np.linalg.eigh(covariance)[1][:, ::-1][:, :leading])

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved = vectors - self.mean
        lead = moved @ self.axes
        rest = moved - lead @ self.axes.T
        return lead, np.sqrt(np.einsum("ij,ij->i", rest, rest))


def _products(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            rows = _matrix(batch.column(0), dims)
            n, total, squares = n + len(rows), total + rows.sum(axis=0), squares + rows.T @ rows
        if n:
            packed = np.concatenate([[n], total, squares.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(packed)), pa.int32()), pa.array(packed)], names=["place", "part"])

    return run


def _stored(frame: Frame, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = frame.of(_matrix(batch.column("vector"), dims))
            led = pa.array([row.tobytes() for row in lead.astype("<f8")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, led, pa.array(rest)], names=[*batch.schema.names, "leading", "residual"])

    return run


def nearest(vectors: np.ndarray, leading: np.ndarray, residual: np.ndarray, frame: Frame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid, exact squared distance, and how many were measured."""
    lead, rest = frame.of(centroids.astype(np.float64))
    gaps = leading[:, None, :] - lead[None, :, :]
    bounds = np.einsum("ijk,ijk->ij", gaps, gaps) + (residual[:, None] - rest[None, :]) ** 2
    size = np.einsum("ij,ij->i", vectors, vectors)[:, None] + np.einsum("ij,ij->i", centroids.astype(np.float64), centroids.astype(np.float64))[None, :]
    bounds -= SLACK * (bounds + size) + SLACK
    whole, centres = _exact(vectors), _exact(np.asarray(centroids, np.float64))

    def measure(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        apart = whole[rows] - centres[numbers]
        return (apart * apart).sum(axis=1)

    every = np.arange(len(vectors))
    likely = bounds.argmin(axis=1)
    best, distance = likely.copy(), measure(every, likely)
    measured = np.ones(len(vectors), np.int32)
    for number in range(len(centroids)):
        rows = np.flatnonzero((bounds[:, number] <= distance.astype(np.float64)) & (likely != number))
        if len(rows):
            found = measure(rows, np.full(len(rows), number))
            measured[rows] += 1
            nearer = (found < distance[rows]) | ((found == distance[rows]) & (number < best[rows]))
            best[rows[nearer]], distance[rows[nearer]] = number, found[nearer]
    return best, distance, measured


def _visit(frame: Frame, centroids: np.ndarray, dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        vectors = _matrix(batch.column("vector"), dims)
        leading = _matrix(batch.column("leading"), frame.axes.shape[1])
        residual = batch.column("residual").to_numpy(zero_copy_only=False)
        yield batch, vectors, *nearest(vectors, leading, residual, frame, centroids)


def _sums(frame: Frame, centroids: np.ndarray, dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((len(centroids), dims), object)
    counts = np.zeros(len(centroids), np.int64)
    for _, vectors, best, *_ in _visit(frame, centroids, dims, batches):
        whole = _exact(vectors)
        for number in np.unique(best):
            totals[number] += whole[best == number].sum(axis=0).astype(object)
        counts += np.bincount(best, minlength=len(centroids))
    met = [(c, d) for c in np.flatnonzero(counts) for d in range(dims)]
    if met:
        columns = [[c for c, _ in met], [d for _, d in met], [str(totals[c, d]) for c, d in met], [counts[c] for c, _ in met]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["cluster", "dim", "total", "n"])


def _assign(frame: Frame, centroids: np.ndarray, dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, best, distance, measured in _visit(frame, centroids, dims, batches):
        columns = [batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance.tolist(), pa.int64()), pa.array(measured, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "measured"])


def _moved(stored: DataFrame, frame: Frame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """Centroids replaced by the floors of their vectors' means; at most k x dims sums reach the driver."""
    parts = stored.select("vector", "leading", "residual").mapInArrow(partial(_sums, frame, centroids, dims), SUMS)
    summed = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    moved = centroids.copy()
    for row in summed:
        moved[row["cluster"], row["dim"]] = int(row["total"]) // row["n"]
    return moved


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, leading: int = LEADING) -> DataFrame:
    """Assign every vector after ``rounds`` rounds from the ``k`` vectors whose hashed ids are smallest.

    Columns: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured
    (centroids whose distance was computed in the last pass).
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter((F.size("embedding") == dims) & finite)
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") * scale).alias("scaled"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # + 0.0 gives negative zero the bytes of zero
            rows = np.floor(batch.column("scaled").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "vector"])

    whole = materialize(kept.mapInArrow(floors, "vec_id long, vector binary"))
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = whole.select(order.alias("hash"), "vector").orderBy(F.asc_nulls_last("hash"), "vector").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, measured int")
    centroids = np.array([[int(x) for x in np.frombuffer(r["vector"], "<f8")] for r in first], object)

    sums = whole.select("vector").mapInArrow(_products(dims), "place int, part double").groupBy("place").agg(F.sum("part").alias("part"))
    packed = np.array([r["part"] for r in sums.orderBy("place").collect()])  # 1 + dims + dims^2 numbers
    frame = Frame.fit(packed[0], packed[1 : dims + 1], packed[dims + 1 :].reshape(dims, dims), leading)
    stored = materialize(whole.mapInArrow(_stored(frame, dims), "vec_id long, vector binary, leading binary, residual double"))
    for _ in range(rounds):
        centroids = _moved(stored, frame, centroids, dims)

    assigned = materialize(stored.mapInArrow(partial(_assign, frame, centroids, dims), ASSIGNED))
    # one row per centroid
    inertia = {r["cluster"]: r["n"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(number, hashes[number], own, sum(inertia.values())) for number, own in inertia.items()]
    numbers = spark.createDataFrame(rows, "cluster int, centroid_sha256 string, cluster_inertia long, inertia long")
    return assigned.join(F.broadcast(numbers), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured"
    )
