"""Connected components of a graph held as a DataFrame.

Each partition first replaces its edges by a spanning forest. If at most FOREST edges are left, one executor task
joins the forests; this bound is checked, so the task's memory does not grow with the input. Beyond it, large and
small stars alternate. Every round is a pair of shuffles over the edges; nothing but two counters reaches the driver. In a large
star each node sends its larger neighbours to its least one, in a small star its smaller ones; the edges
become stars around the least node of each component after some log n rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import discard, materialize


#: Edges of all partitions' forests that one task joins at most (some 200 MB).
FOREST = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the partition's edges with the least node it reaches there, itself left out."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    for start in range(0, len(nodes), 100_000):
        part = nodes[start : start + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["a", "b"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, component): each node of an edge with the least node it can reach."""
    now = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_forest, "a long, b long"), "edges")
    if now.count() <= FOREST:
        now = materialize(now.coalesce(1).mapInArrow(_forest, "a long, b long"), "edges")
        return _members(now)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        after = materialize(_small(_large(now).distinct()).distinct(), "edges")
        discard(now)
        now = after
    return _members(now)


def _members(stars: DataFrame) -> DataFrame:
    """Stars (a, b), b the least of its component, to (node, component)."""
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
