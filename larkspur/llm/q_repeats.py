"""Query op6_suffix_dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import repeats
from larkspur.llm.common import table


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


_N = repeats.LENGTH
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
win AS (SELECT rid, i, md5(substring(h, 2 * i + 1, {2 * _N})) AS m FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - {_N - 1})) AS i FROM d)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY m) AS n FROM win) WHERE n > 1),
edge AS (SELECT rid, i, coalesce(i > lag(i) OVER w + {_N}, true) AS fresh FROM dup WINDOW w AS (PARTITION BY rid ORDER BY i)),
run AS (SELECT rid, i, count(*) FILTER (fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM edge),
span AS (SELECT rid, k, min(i) AS a, max(i) + {_N} AS b FROM run GROUP BY rid, k),
gap AS (SELECT rid, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM span WINDOW w AS (PARTITION BY rid ORDER BY a)
  UNION ALL SELECT rid, max(b), 1000000000 FROM span GROUP BY rid),
kept AS (SELECT g.rid, string_agg(substring(h, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS h FROM gap g JOIN d USING (rid) GROUP BY g.rid),
n AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY rid)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.h, CASE WHEN n.rid IS NULL THEN d.h ELSE '' END))) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""
