"""Centroid clustering: Lloyd's rounds over distinct quantised vectors, each weighed by how often it occurs.

Equal vectors are grouped before anything else, so a vector that a third of all rows share is one row of every round. A round reads
the distinct vectors once, adds weighted whole numbers in every task, and sends k x size sums to the driver, whatever the table's
size. Sums, means and distances are whole numbers, so the order of tasks changes nothing. At the end the assignment is joined back
by the vector itself: vectors that hold a thousandth of all rows or more (there are at most a thousand) by broadcast, so that no
task gets their copies, all others by a shuffle.

Defined cases: rows whose vector is null, has another length, or holds a null or non-finite entry are left out. Rows with a null or
repeated vec_id each get a row; equal hashes of a start are ordered by their vectors, null ids come last. Fewer rows than k give as
many centroids as rows; an empty table gives no rows. Columns but the id and the vector are not read. An entry beyond ``LARGEST``
raises an error, as squared distances of such vectors leave a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import materialize

#: Entries of a quantised vector stay below this; 64 squares of differences then fit a long.
LARGEST = 1 << 27
#: Up to this size sums of products are exact in doubles.
_EXACT = 1 << 22
#: Vectors with a thousandth of all rows or more are joined by broadcast.
HOT = 1000


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor non-finite entries."""
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, plain), F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every entry x, taken as a double."""

    def whole(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(x.cast("double")) * scale < LARGEST, scaled.cast("int")).otherwise(F.raise_error(F.lit("an entry of a vector is too large to quantise")))

    return F.transform(vector, whole)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point, the smaller number among equals, and its squared distance, in whole numbers."""
    points = points.astype(np.int64)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(np.abs(points).max(), np.abs(centroids).max()) <= _EXACT:
        a, b = points.astype(np.float64), centroids.astype(np.float64)
        squares = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    else:
        squares = np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)
    best = squares.argmin(1)
    return best, squares[np.arange(len(points)), best].astype(np.int64)


def _round(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round."""
    k, size = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            points, weights = matrix(batch.column(0), size).astype(np.int64), batch.column(1).to_numpy()
            best, _ = nearest(points, centroids)
            np.add.at(sums, best, points * weights[:, None])
            np.add.at(counts, best, weights)
        used = np.flatnonzero(counts)
        cluster, dim = np.repeat(used, size), np.tile(np.arange(size), len(used))
        yield pa.record_batch({"cluster": cluster.astype(np.int32), "dim": dim.astype(np.int32), "total": sums[used].ravel(), "n": np.repeat(counts[used], size)})

    sums = distinct.select("q", "n").mapInArrow(add, "cluster int, dim int, total long, n long").groupBy("cluster", "dim")
    after = centroids.copy()
    for r in sums.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k x size rows at most
        after[r.cluster, r.dim] = r.total // r.n
    return after


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, salt: str = "2:", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept."""
    kept = rows.where((F.size(vector) == size) & finite(F.col(vector))).select(F.col(vec_id).alias("vec_id"), quantised(F.col(vector), scale).alias("q"))
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h")
    starts = kept.select(hashed, "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    centroids = np.array([r.q for r in starts], np.int64).reshape(-1, size)
    distinct = materialize(kept.groupBy("q").agg(F.count("*").alias("n")), "vectors")
    for _ in range(rounds if starts else 0):
        centroids = _round(distinct, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, squares = nearest(matrix(batch.column(0), size), centroids)
            yield pa.record_batch({"q": batch.column(0), "n": batch.column(1), "cluster": best.astype(np.int32), "distance": squares})

    assigned = materialize(distinct.select("q", "n").mapInArrow(assign, "q array<int>, n long, cluster int, distance long"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum((F.col("distance") * F.col("n").cast("decimal(19,0)"))).alias("inertia")).collect()
    inertia = {r.cluster: int(r.inertia) for r in sums}
    hot = assigned.where(F.col("n") * HOT >= sum(r.n for r in sums)).select("q", "cluster", "distance")
    cold = assigned.where(F.col("n") * HOT < sum(r.n for r in sums)).select("q", "cluster", "distance")
    placed = kept.join(F.broadcast(hot), "q").unionByName(kept.join(F.broadcast(hot.select("q")), "q", "left_anti").join(cold, "q"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    listed = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    return placed.select(
        "vec_id", "cluster", "distance", listed([inertia.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), listed(names, "string").alias("centroid_sha256"),
    )
