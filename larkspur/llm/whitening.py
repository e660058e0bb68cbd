"""Embedding whitening by cyclic Jacobi rotations.

Entries become whole numbers, so sums and scatter are exact: tasks centre their vectors by the nearest whole number to the mean,
add up products, and the driver takes off what the rounded mean left, in whole numbers again. What reaches the driver is one
triangle of size x size sums, however many rows there are. There the covariance is turned to a diagonal by Jacobi rotations, in
cyclic order over disjoint pairs, until every off-diagonal entry is negligible against the two diagonal ones that it couples; this
keeps small eigenvalues accurate. The matrix of unit eigenvectors over square roots is broadcast.

Defined cases: rows whose vector is null or holds a null or non-finite entry are left out, and so are vectors of another length than
the most common one (the longer of equally common ones), as they have no place in the scatter. Rows with a null or repeated vec_id
are kept. Where an eigenvalue is zero, as with fewer rows than dimensions, its component explains 0 and ``whitened`` is null.
``deviation`` is null where it exceeds a long. An empty table gives no rows. An entry beyond ``LARGEST`` raises an error. Columns
but the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.centroids import finite, matrix

#: scale * entry stays below this, so that squares of whole numbers fit a long.
LARGEST = 1 << 30
#: Sums of products are exact in doubles up to here.
_EXACT = 1 << 53
_LOW = 40
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * x) + shift of every entry x, taken as a double."""

    def one(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * F.lit(float(scale))) + F.lit(shift)
        return F.when(F.abs(x.cast("double")) * scale < LARGEST, scaled.cast("long")).otherwise(F.raise_error(F.lit("an entry of a vector is too large to whiten")))

    return F.transform(vector, one)


def _sums(kept: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, np.int64)
        for batch in batches:
            n, total = n + batch.num_rows, total + matrix(batch.column(0), size).sum(0)
        yield pa.record_batch({"i": np.arange(size, dtype=np.int32), "total": total, "n": np.full(size, n, np.int64)})

    rows = kept.select("x").mapInArrow(add, "i int, total long, n long").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    by = {r.i: r for r in rows}
    return (by[0].n if by else 0), [int(by[i].total) for i in range(size)] if by else [0] * size


def scatter(kept: DataFrame, size: int, centre: list[int]) -> np.ndarray:
    """Sums of products of vectors less centre, as Python's whole numbers."""
    upper = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        for batch in batches:
            y = matrix(batch.column(0), size) - np.array(centre, np.int64)
            most = int(np.abs(y).max(initial=0))
            exact = most * most * len(y) < _EXACT
            part = y.astype(np.float64) if exact else y.astype(object)
            product = part.T @ part
            total += product.astype(np.int64).astype(object) if exact else product
        values = total[upper]
        yield pa.record_batch({"i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), "high": [int(v) >> _LOW for v in values], "low": [int(v) & ((1 << _LOW) - 1) for v in values]})

    rows = kept.select("x").mapInArrow(add, "i int, j int, high long, low long").groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = np.zeros((size, size), object)
    for r in rows.collect():  # one triangle
        out[r.i, r.j] = out[r.j, r.i] = (r.high << _LOW) + r.low
    return out


def _rounds(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of dimensions in rounds of disjoint pairs, as in a tournament."""
    players = list(range(size + size % 2))
    out = []
    for _ in range(len(players) - 1):
        pairs = [(a, b) for a, b in zip(players[: len(players) // 2], reversed(players[len(players) // 2 :])) if max(a, b) < size]
        out.append((np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)))
        players = [players[0], players[-1], *players[1:-1]]
    return out


def jacobi(symmetric: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    a, size = symmetric.astype(np.float64).copy(), len(symmetric)
    vectors = np.eye(size)
    for _ in range(most):
        turned = False
        for p, q in _rounds(size):
            apq, app, aqq = a[p, q], a[p, p], a[q, q]
            far = np.abs(apq) > np.finfo(float).eps * np.sqrt(np.abs(app * aqq)) * 0.5
            far &= np.abs(apq) > np.finfo(float).tiny
            if not far.any():
                continue
            turned, p, q, apq, app, aqq = True, p[far], q[far], apq[far], app[far], aqq[far]
            theta = (aqq - app) / (2 * apq)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            for m in (a, vectors):
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            top, low = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * top - s[:, None] * low, s[:, None] * top + c[:, None] * low
            a[p, p], a[q, q], a[p, q], a[q, p] = app - t * apq, aqq + t * apq, 0.0, 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    values, vectors = np.diag(a)[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(size)])
    return values, vectors * signs


def _identity_error(kept: DataFrame, size: int, project) -> float:
    """The largest absolute entry of the whitened covariance less the identity, over the vectors themselves."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = 0.0, 0.0
        for batch in batches:
            w = project(matrix(batch.column(0), size))
            sums, products = sums + w.sum(0), products + w.T @ w
        if np.ndim(sums):
            m = len(sums)
            i, j = np.indices((m, m)).reshape(2, -1)
            yield pa.record_batch({"i": np.concatenate([i, np.arange(m)]).astype(np.int32), "j": np.concatenate([j, np.full(m, -1)]).astype(np.int32), "s": np.concatenate([products.ravel(), sums])})

    found = {(r.i, r.j): r.s for r in kept.select("x").mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    n = kept.count()
    return max((abs(s / n - found[i, -1] * found[j, -1] / n**2 - (i == j)) for (i, j), s in found.items() if j >= 0), default=0.0)


def whiten(rows: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector that is kept and every component."""
    spark = rows.sparkSession
    kept = rows.where(finite(F.col(vector)) & (F.size(vector) > 0)).select(F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(vector), scale, shift).alias("x"))
    lengths = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], SCHEMA)
    size = lengths[0]["size"]
    kept = kept.where(F.size("x") == size)
    n, sums = _sums(kept, size)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    left = [s - n * c for s, c in zip(sums, centre)]
    products = scatter(kept, size, centre)
    covariance = np.array([[(n * int(products[i, j]) - left[i] * left[j]) / (n * n) for j in range(size)] for i in range(size)])
    values, vectors = jacobi(covariance)
    m = min(components, size)
    sound = values[:m] > values[0] * size * np.finfo(float).eps
    scales = np.where(sound, 1 / np.sqrt(np.where(sound, values[:m], 1.0)), 0.0)
    # one matrix of size x components, and the mean in two exact parts
    shared = spark.sparkContext.broadcast((vectors[:, :m] * scales, np.array(centre, np.int64), np.array(left, object)))

    def deviations(x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: in longs where they hold it."""
        _, whole_mean, rest = shared.value
        y = x - whole_mean
        small = int(np.abs(y).max(initial=0)) * n + max(map(abs, left)) < 1 << 62
        return y * n - rest.astype(np.int64) if small else y.astype(object) * n - rest

    def project(x: np.ndarray) -> np.ndarray:
        return (deviations(x).astype(np.float64) / n) @ shared.value[0]

    error = _identity_error(kept, size, lambda x: project(x)[:, sound])
    trace = float(np.trace(covariance))
    explained = np.where(sound, values[:m], 0.0) / trace if trace > 0 else np.zeros(m)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 1000):
                batch = whole_batch.slice(at, 1000)
                k, x = batch.num_rows, matrix(batch.column(1), size)
                far = deviations(x)
                if far.dtype == object or int(np.abs(far).max()) ** 2 * size >= 1 << 63:
                    squares = [v if v < 1 << 63 else None for v in (far.astype(object) ** 2).sum(1)]
                else:
                    squares = (far * far).sum(1)
                up = pa.array(np.repeat(np.arange(k), m))
                yield pa.record_batch({
                    "vec_id": batch.column(0).take(up), "component": np.tile(np.arange(1, m + 1, dtype=np.int32), k), "n": np.full(k * m, n, np.int64),
                    "deviation": pa.array(squares, pa.int64()).take(up), "whitened": pa.array(project(x).ravel(), mask=np.tile(~sound, k)),
                    "explained": np.tile(explained, k), "identity_error": np.full(k * m, error),
                })

    return kept.select("vec_id", "x").mapInArrow(emit, SCHEMA)
