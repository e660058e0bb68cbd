"""Query op1_decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontaminate as d
from larkspur.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _re2(replacement: str) -> str:
    return replacement.replace("$", "\\")


def _marked(text: str) -> str:
    out = f"coalesce({text}, '')"
    for _, replaces in d.STEPS:
        for pattern, replacement in replaces:
            out = f"regexp_replace({out}, '{pattern}', '{_re2(replacement)}', 'g')"
    return f"lower({out})"


def _windows(table: str, key: str) -> str:
    split = lambda t: f"[x FOR x IN regexp_split_to_array({t}, '{d.SEPARATOR}') IF x <> '']"
    return f"""
  SELECT rid, {key}, i, c[i:i + {d.WINDOW - 1}] AS w, [x FOR x IN r[i:i + {d.WINDOW - 1}] IF regexp_matches(x, '{d.MARK}')] AS slots
  FROM (
    SELECT rid, {key}, c, r, unnest(range(1, len(c) - {d.WINDOW - 2})) AS i
    FROM (SELECT rid, {key}, {split("t")} AS r, {split(f"regexp_replace(t, '{d.BLANK[0]}', '{_re2(d.BLANK[1])}', 'g')")} AS c
          FROM (SELECT row_number() OVER () AS rid, {key}, {_marked("text")} AS t FROM {table}))
  )"""


SQL = f"""
WITH dw AS ({_windows("documents", "doc_id")}),
bw AS ({_windows("benchmark", "item_id")}),
b AS (SELECT DISTINCT item_id, i, w, slots FROM bw WHERE len(slots) <= {d.WINDOW - d.MIN_LITERAL}),
size AS (SELECT item_id, count(DISTINCT w) AS total FROM b GROUP BY item_id),
pair AS (
  SELECT dw.doc_id, b.item_id, dw.i - b.i AS shift, dw.w, list_zip(b.slots, dw.slots) AS p, b.slots AS ours, dw.slots AS theirs
  FROM dw JOIN b ON dw.w = b.w
),
aligned AS (
  SELECT doc_id, item_id, shift, list(DISTINCT w) AS ws, len(list_distinct(flatten(list(p)))) AS n,
    len(list_distinct(flatten(list(ours)))) AS n_ours, len(list_distinct(flatten(list(theirs)))) AS n_theirs
  FROM pair GROUP BY ALL
),
hit AS (
  SELECT doc_id, item_id, len(list_distinct(flatten(list(ws)))) AS n
  FROM aligned WHERE n = n_ours AND n = n_theirs GROUP BY ALL
),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items
  FROM hit JOIN size USING (item_id) WHERE n >= {d.COVERAGE} * total GROUP BY doc_id
)
SELECT documents.doc_id, n_items IS NOT NULL AS leaked, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items
FROM documents LEFT JOIN found ON documents.doc_id IS NOT DISTINCT FROM found.doc_id
"""
