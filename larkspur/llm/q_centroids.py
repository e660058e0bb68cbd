"""Query op13_centroid_clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import centroids
from larkspur.llm.common import table

K, ROUNDS, SIZE = 40, 5, 64


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), K, ROUNDS, SIZE)


def _assigned(centres: str) -> str:
    return f"""SELECT rid, vec_id, q, min_by(k, (dist, k)) AS k, min(dist) AS dist FROM (
  SELECT e.rid, e.vec_id, e.q, c.k, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(e.q, c.q)])::BIGINT AS dist FROM e, {centres} c) GROUP BY ALL"""


def _moved(before: str, assigned: str) -> str:
    return f"""SELECT c.k, coalesce(m.q, c.q) AS q FROM {before} c LEFT JOIN (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY d)::BIGINT[] AS q FROM (SELECT k, d, sum(q[d]) AS s, count(*) AS n FROM {assigned}, range(1, {SIZE + 1}) r(d) GROUP BY k, d) GROUP BY k
) m USING (k)"""


_STEPS = ",\n".join(f"a{i} AS MATERIALIZED ({_assigned(f'c{i}')}),\nc{i + 1} AS MATERIALIZED ({_moved(f'c{i}', f'a{i}')})" for i in range(ROUNDS))

SQL = f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = {SIZE} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM e ORDER BY h NULLS LAST, q LIMIT {K})),
{_STEPS},
a AS MATERIALIZED ({_assigned(f"c{ROUNDS}")})
SELECT vec_id, a.k::INT AS cluster, dist AS distance, (sum(dist) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a JOIN c{ROUNDS} c USING (k)
"""
