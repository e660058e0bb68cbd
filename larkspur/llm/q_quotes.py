"""Query op9_chat_quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import quotes
from larkspur.llm.common import table


def op9_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


def _runs(lines: str) -> str:
    """Maximal runs of lines(rid, conv_id, turn, i, depth, body) of one depth; a blank line of depth 0 stands alone."""
    return f"""(SELECT rid, conv_id, turn, run, max(kind) AS depth, string_agg(body, ' ' ORDER BY i) AS body FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM (
        SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY rid ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM (
          SELECT *, CASE WHEN depth = 0 AND trim(body) = '' THEN -i ELSE depth END AS kind FROM {lines}))) GROUP BY rid, conv_id, turn, run)"""


SQL = rf"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
),
l AS (SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
d AS (
  SELECT rid, conv_id, turn, i, length(regexp_replace(regexp_extract(x, '{quotes._QUOTE}', 1), '[^>]', '', 'g')) AS depth, regexp_replace(x, '{quotes._QUOTE}', '') AS body FROM l
),
own AS (
  SELECT rid, conv_id, turn, i, depth, body FROM (SELECT *, coalesce(lead(depth) OVER (PARTITION BY rid ORDER BY i) > 0, false) AS before_quote FROM d)
  WHERE depth = 0 AND NOT (regexp_matches(body, '{quotes._INTRO}') AND before_quote)
),
has AS (SELECT rid, max(depth) > 0 AS quoting FROM d GROUP BY rid),
c AS (
  SELECT m.rid, m.conv_id, m.turn, m.role, CASE WHEN has.quoting THEN trim(coalesce(t.body, '')) ELSE m.text END AS text
  FROM m JOIN has USING (rid) LEFT JOIN (SELECT rid, string_agg(body, chr(10) ORDER BY i) AS body FROM own GROUP BY rid) t USING (rid)
),
q AS (SELECT rid, conv_id, turn, depth, md5({_norm("body")}) AS mark FROM {_runs("d")} WHERE depth > 0 AND {_norm("body")} <> ''),
said AS (
  SELECT conv_id, turn, body FROM own UNION ALL SELECT conv_id, turn, body FROM {_runs("own")} WHERE depth = 0 UNION ALL SELECT conv_id, turn, text FROM c
),
src AS (SELECT conv_id, md5({_norm("body")}) AS mark, min(turn) AS source FROM said WHERE {_norm("body")} <> '' GROUP BY 1, 2),
link AS (
  SELECT q.conv_id, q.turn, arg_max(source, (-depth, source)) AS parent, count(*) AS n_linked
  FROM q JOIN src ON q.conv_id = src.conv_id AND q.mark = src.mark WHERE source < q.turn GROUP BY 1, 2
),
up AS (
  SELECT conv_id, turn, parent AS thread FROM link
  UNION ALL SELECT up.conv_id, up.turn, link.parent FROM up JOIN link ON up.conv_id = link.conv_id AND up.thread = link.turn
),
root AS (SELECT conv_id, turn, min(thread) AS thread FROM up GROUP BY 1, 2),
s AS (
  SELECT c.conv_id, c.turn, c.role, c.text, coalesce(nq, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, coalesce(root.thread, c.turn) AS thread
  FROM c LEFT JOIN (SELECT rid, count(*) AS nq FROM q GROUP BY rid) USING (rid)
    LEFT JOIN link ON c.conv_id = link.conv_id AND c.turn = link.turn LEFT JOIN root ON c.conv_id = root.conv_id AND c.turn = root.turn
),
o AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, role, text) - 1) // {quotes.CHUNK} AS chunk FROM s)
SELECT conv_id, chunk, count(*) AS n_messages, CAST(sum(n_quotes) AS BIGINT) AS n_quotes, CAST(sum(n_linked) AS BIGINT) AS n_linked,
  string_agg(CAST(turn AS VARCHAR), ',' ORDER BY thread, turn, role, text) AS turns,
  string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY thread, turn, role, text) AS chat
FROM o GROUP BY ALL
"""
