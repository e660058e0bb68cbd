"""Query op10_jaccard_join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import jaccard
from larkspur.llm.common import SPACE, table


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}') IF x <> ''] AS words
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS g
  FROM w
),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM e x JOIN e y ON x.t = y.t AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
),
r AS (SELECT DISTINCT a AS doc_id, a AS node FROM p UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.node = p.a)
SELECT s.doc_id, len(g) AS n_shingles, least(s.doc_id, coalesce(min(r.node), s.doc_id)) AS component_id
FROM s LEFT JOIN r USING (doc_id) GROUP BY s.doc_id, g
"""
