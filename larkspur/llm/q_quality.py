"""Query op2_quality_rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import quality as q
from larkspur.llm.common import materialize, table


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.judge(materialize(q.measure(table(spark, sf_dir, "documents")).drop("_row"), "quality"))


_VOTES = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {n}" for n, bad, good in q.RULES)
_M, _CLASSES = len(q.NAMES), len(q.PRIORS)


def _listed(values: list[float]) -> str:
    return "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "]"


def _posteriors(shares: str, accuses: str, v: str) -> str:
    """The chance of each class, as a list."""
    evidence = f"list_sum([CASE {v}[k] WHEN -1 THEN ln({accuses}[c][k]) WHEN 1 THEN ln(1 - {accuses}[c][k]) ELSE 0.0 END FOR k IN range(1, {_M + 1})])"
    logs = f"[ln({shares}[c]) + {evidence} FOR c IN range(1, {_CLASSES + 1})]"
    return f"list_transform([{logs}], lambda l: [exp(x - list_max(l)) / list_sum([exp(y - list_max(l)) FOR y IN l]) FOR x IN l])[1]"


_BAD = "list_sum([CASE r.v[j] WHEN -1 THEN r.w[c] ELSE 0.0 END FOR r IN b])"
_CAST = "list_sum([CASE r.v[j] WHEN 0 THEN 0.0 ELSE r.w[c] END FOR r IN b])"
_PRIORS = f"[{', '.join(map(_listed, q.PRIORS))}]"

SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM d),
win AS (
  SELECT rid, i, words[i:i + 4] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)
),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid
),
f AS (
  SELECT d.doc_id, len(words) AS n_words,
    CAST(coalesce(list_sum([length(x) FOR x IN words]), 0) AS BIGINT) AS word_chars,
    length(text) - length(translate(text, '{q.SYMBOLS}', '')) AS n_symbols,
    length(regexp_replace(text, '{q.NO_LETTERS}', '', 'g')) AS n_letters,
    len(list_distinct(words)) AS n_distinct,
    len([x FOR x IN words IF regexp_matches(x, '[{q.SYMBOLS}]')]) AS n_marked,
    length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
    length(text) - length(translate(text, '!?', '')) AS n_marks,
    len([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')]) AS n_lines,
    len([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')])
      - len(list_distinct([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')])) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid)
),
v AS (SELECT *, {_VOTES} FROM f),
h AS (SELECT list({{'v': v, 'n': n}} ORDER BY v) AS t FROM (SELECT [{", ".join(q.NAMES)}] AS v, count(*)::DOUBLE AS n FROM v GROUP BY ALL)),
em AS (
  SELECT 0 AS k, {_listed(q.SHARES)} AS shares, {_PRIORS} AS accuses
  UNION ALL
  SELECT k + 1,
    [(list_sum([r.w[c] FOR r IN b]) + {_listed(q.SHARES)}[c] * {q.PRIOR_WEIGHT}) / (list_sum([list_sum(r.w) FOR r IN b]) + {q.PRIOR_WEIGHT}) FOR c IN range(1, {_CLASSES + 1})],
    [[({_BAD} + {_PRIORS}[c][j] * {q.PRIOR_WEIGHT}) / ({_CAST} + {q.PRIOR_WEIGHT}) FOR j IN range(1, {_M + 1})] FOR c IN range(1, {_CLASSES + 1})]
  FROM (
    SELECT em.k, [{{'v': p.v, 'w': [x * p.n FOR x IN {_posteriors("em.shares", "em.accuses", "p.v")}]}} FOR p IN h.t] AS b FROM em, h WHERE em.k < {q.ROUNDS}
  )
),
m AS (SELECT shares, accuses FROM em WHERE k = {q.ROUNDS}),
s AS (SELECT v.*, {_posteriors("m.shares", "m.accuses", "[" + ", ".join(q.NAMES) + "]")}[1] AS p FROM v, m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND p >= {q.THRESHOLD} AS kept,
  round(p, 6) AS p_quality, {", ".join(q.NAMES)}
FROM s
"""
