"""DuckDB SQL of the similarity of names, for the queries that compare them: LCS rows are prefix maxima of their candidates."""

from __future__ import annotations

from larkspur.functions import names


def _lcs(a: str, b: str) -> str:
    cell = f"CASE WHEN ord(({b})[j]) = c[1] THEN CASE WHEN j > 1 THEN p[j - 1] ELSE 0 END + 1 ELSE p[j] END"
    row = f"[list_max([{cell} FOR j IN range(1, i + 1)]) FOR i IN range(1, length({b}) + 1)]"
    return f"coalesce(list_reduce(list_transform(string_split({a}, ''), lambda c: [ord(c)]), lambda p, c: {row}, [0 FOR i IN range(0, length({b}))])[-1], 0)"


def _indel(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {_lcs(a, b)} / (length({a}) + length({b})) END"


def ratios(pairs: str) -> str:
    """SQL for (a, b, ratio) of SQL for (a, b)."""
    words = lambda x: f"list_sort(list_distinct([w FOR w IN string_split({x}, ' ') IF w <> '']))"
    lists = f"SELECT a, b, {words('a')} AS x, {words('b')} AS y FROM ({pairs})"
    parts = f"SELECT a, b, x, y, [w FOR w IN x IF list_contains(y, w)] AS m, [w FOR w IN x IF NOT list_contains(y, w)] AS p, [w FOR w IN y IF NOT list_contains(x, w)] AS q FROM ({lists})"
    texts = f"SELECT *, array_to_string(m, ' ') AS s, array_to_string(list_concat(m, p), ' ') AS l, array_to_string(list_concat(m, q), ' ') AS r FROM ({parts})"
    return (
        f"SELECT a, b, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE WHEN len(m) > 0 AND (len(p) = 0 OR len(q) = 0) THEN 100.0::DOUBLE"
        f" WHEN len(m) = 0 THEN {_indel('l', 'r')} ELSE greatest({_indel('l', 'r')}, {_indel('s', 'l')}, {_indel('s', 'r')}) END AS ratio FROM ({texts})"
    )


def known(teams: list[str]) -> str:
    """CTEs: k (a, b, ratio, hit, strong, fa, fb) of every pair of the teams; strong has no weak words, fa and fb are marks."""
    listed = ", ".join(f"'{t}'" for t in teams)
    strip = lambda x: f"array_to_string([w FOR w IN string_split({x}, ' ') IF w <> '' AND NOT list_contains({names.WEAK}, w)], ' ')"
    marks = lambda x: f"array_to_string(list_sort(list_distinct([w FOR w IN string_split({x}, ' ') IF list_contains({names.FLAGS}, w)])), ' ')"
    held = f"len([1 FOR v IN string_split(a, ' ') IF length(v) >= {names.MIN_TOKEN} AND len([1 FOR w IN string_split(b, ' ') IF length(w) >= {names.MIN_TOKEN} AND (contains(v, w) OR contains(w, v))]) > 0]) > 0"
    return f"""t AS (SELECT DISTINCT unnest([{listed}]) AS name), s AS (SELECT name, {strip('name')} AS stripped, {marks('name')} AS marks FROM t),
  w AS (SELECT name AS x FROM s UNION SELECT stripped FROM s), q AS ({ratios('SELECT u.x AS a, v.x AS b FROM w u, w v')}),
  h AS (SELECT a, b, ratio, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN {held} THEN greatest(ratio, {names.HELD}) ELSE ratio END AS hit FROM q),
  k AS (SELECT u.name AS a, v.name AS b, p.ratio, p.hit, z.hit AS strong, u.marks AS fa, v.marks AS fb FROM s u, s v, h p, h z WHERE p.a = u.name AND p.b = v.name AND z.a = u.stripped AND z.b = v.stripped)"""
