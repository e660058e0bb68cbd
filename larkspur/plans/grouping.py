"""Queries of guarded grouping: games joined into one by edges, never two fixtures in a group, whatever the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import fixtures as fx
from larkspur.plans.matches import _APART, _FOUR, _GAMES, _NEAR, TEAMS, _games
from larkspur.plans.registry import query
from larkspur.plans.similar import known

_WITH_N = f"SELECT *, game % 5 AS n FROM ({_GAMES})"


def _unify_edges(g: str) -> str:
    """Edges of one game, over the games of a CTE."""
    near = _NEAR.replace("FROM g x JOIN g y", f"FROM {g} x JOIN {g} y")
    return f"""SELECT a, b, greatest(straight, crossed) AS score FROM (SELECT x.game AS a, y.game AS b, least(hh.ratio, aa.ratio) AS straight, least(ah.ratio, ha.ratio) AS crossed, hh.fa = hh.fb AND aa.fa = aa.fb AS m1, ah.fa = ah.fb AND ha.fa = ha.fb AS m2 {near} {_FOUR}
      WHERE NOT (x.fixture IS NOT NULL AND y.fixture IS NOT NULL) AND coalesce({_APART}, 0) <= {fx.UNIFY_MINUTES}) WHERE greatest(straight, crossed) >= {fx.UNIFY_LEAST} AND CASE WHEN straight >= crossed THEN m1 ELSE m2 END"""


_BOARD_EDGES = f"""SELECT a, b, score FROM (SELECT x.game AS a, y.game AS b, x.day = y.day AS day, {_APART} AS apart, greatest(least(hh.ratio, aa.ratio), least(ha.ratio, ah.ratio)) AS score, x.fixture AS f, y.fixture AS h {_NEAR.replace('g x JOIN g y', 'g1 x JOIN g1 y')} {_FOUR})
  WHERE (f IS NULL AND h IS NULL AND ((day AND ((apart = 0 AND score >= 75) OR score >= 88)) OR (NOT day AND score >= 88 AND apart <= 75))) OR ((f IS NULL) <> (h IS NULL) AND day AND ((apart = 0 AND score >= 75) OR score >= 95)) OR f = h"""


def _grouped(k: int, edges: str) -> str:
    """CTEs: alias of the games g{k} by edges: fixtures offered round by round to neighbours without one, then components of one fixture or of none."""
    return f"""e{k} AS MATERIALIZED ({edges}), d{k} AS MATERIALIZED (SELECT a, b, score FROM e{k} UNION ALL SELECT b, a, score FROM e{k}),
  l{k}(game, label, fresh, k) AS (SELECT game, fixture::VARCHAR, fixture IS NOT NULL, 0 FROM g{k} UNION ALL
    SELECT l.game, coalesce(l.label, o.offer), l.label IS NULL AND o.offer IS NOT NULL, l.k + 1 FROM l{k} l
    LEFT JOIN (SELECT d.a, arg_max(x.label, (d.score, x.label)) AS offer FROM d{k} d JOIN l{k} x ON x.game = d.b WHERE x.label IS NOT NULL GROUP BY d.a) o ON o.a = l.game
    WHERE (SELECT count(*) FROM l{k} z WHERE z.fresh) > 0),
  m{k} AS MATERIALIZED (SELECT game, label FROM l{k} WHERE k = (SELECT max(k) FROM l{k})),
  u{k} AS MATERIALIZED (SELECT d.a, d.b FROM d{k} d JOIN m{k} x ON x.game = d.a JOIN m{k} y ON y.game = d.b WHERE x.label IS NOT DISTINCT FROM y.label),
  r{k}(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM u{k} GROUP BY a
    UNION SELECT u.a, min(r.component) FROM r{k} r JOIN u{k} u ON r.node = u.b JOIN recurring.r{k} AS q ON q.node = u.a WHERE r.component < q.component GROUP BY u.a),
  a{k} AS MATERIALIZED (SELECT g.game, arg_min(g.game, (g.fixture IS NULL, -coalesce(g.n, 0), g.game)) OVER (PARTITION BY coalesce(r.component, g.game)) AS canonical FROM g{k} g LEFT JOIN r{k} r ON r.node = g.game)"""


@query(f"WITH RECURSIVE {known(TEAMS)}, g1 AS MATERIALIZED ({_WITH_N}), {_grouped(1, _BOARD_EDGES)} SELECT game, canonical FROM a1")
def board_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The game under which a board shows every row."""
    games = _games(spark, sf_dir)
    return fx.groups(games, fx.board_edges(games))


@query(f"WITH RECURSIVE {known(TEAMS)}, g1 AS MATERIALIZED ({_WITH_N}), {_grouped(1, _unify_edges('g1'))} SELECT game, canonical FROM a1")
def games_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games that are one, after one pass."""
    return fx.unified(_games(spark, sf_dir))


def _next(k: int) -> str:
    return f"g{k + 1} AS MATERIALIZED (SELECT g.* REPLACE (s.n AS n) FROM g{k} g JOIN (SELECT a.canonical, sum(g.n) AS n FROM g{k} g JOIN a{k} a USING (game) GROUP BY 1) s ON s.canonical = g.game)"


_FIXED = f"""WITH RECURSIVE {known(TEAMS)}, g1 AS MATERIALIZED ({_WITH_N}), {_grouped(1, _unify_edges('g1'))}, {_next(1)}, {_grouped(2, _unify_edges('g2'))}, {_next(2)}, {_grouped(3, _unify_edges('g3'))},
  p AS MATERIALIZED (SELECT x.game, z.canonical FROM a1 x JOIN a2 y ON y.game = x.canonical JOIN a3 z ON z.game = y.canonical)"""


@query(f"{_FIXED} SELECT game, canonical FROM p")
def games_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games unified until nothing moves, three passes at most."""
    return fx.fixed_point(_games(spark, sf_dir))


_RECORDS = """SELECT l_orderkey AS game, l_returnflag AS house, 's' || l_linenumber AS source, min(l_quantity) / 10 + 1 AS odd, count(*) AS n_obs, sum(l_partkey % 3)::BIGINT AS n_moves, min(l_shipdate)::TIMESTAMP AS ts,
  CASE min(l_suppkey) % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' WHEN 2 THEN 'settled' ELSE 'pending_result' END AS status, (min(l_partkey) % 9)::BIGINT AS result FROM lineitem GROUP BY ALL"""


@query(f"""{_FIXED}, c AS (SELECT coalesce(p.canonical, r.game) AS game, r.house, r.source || '-' || r.game AS source, r.odd, r.n_obs, r.n_moves, r.ts, r.status, r.result FROM ({_RECORDS}) r LEFT JOIN p USING (game))
  SELECT game, house, arg_min(odd, (ts, source)) AS open_odd, min(ts) AS open_ts, arg_max(odd, (ts, source)) AS last_odd, max(ts) AS last_ts, max(odd) AS max_odd, min(odd) AS min_odd, sum(n_obs)::BIGINT AS n_obs, sum(n_moves)::BIGINT AS n_moves,
  arg_max(status, CASE status WHEN 'settled' THEN 4 WHEN 'pending_result' THEN 3 WHEN 'closed' THEN 2 ELSE 0 END) AS status, arg_max(result, (ts, source)) FILTER (status = 'settled') AS result, string_agg(source, ',' ORDER BY source) AS merged_from FROM c GROUP BY game, house""")
def records_rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records under the games that theirs were unified with, merged where two then share a key."""
    from larkspur.operators import history
    from larkspur.plans.registry import table

    status, part = F.min("l_suppkey") % 4, F.col("l_linenumber").cast("string")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game"), F.col("l_returnflag").alias("house"), F.concat(F.lit("s"), part, F.lit("-"), F.col("l_orderkey")).alias("source")).agg(
        (F.min("l_quantity") / 10 + 1).alias("open_odd"), F.count("*").alias("n_obs"), F.sum(F.col("l_partkey") % 3).alias("n_moves"), F.min("l_shipdate").cast("timestamp_ntz").alias("open_ts"),
        F.when(status == 0, "open").when(status == 1, "closed").when(status == 2, "settled").otherwise("pending_result").alias("status"), (F.min("l_partkey") % 9).alias("result"))
    same = {c: F.col("open_odd") for c in ("last_odd", "max_odd", "min_odd")}
    records = rows.withColumns(same | {"last_ts": F.col("open_ts")})
    return history.merge_records(fx.rekeyed(records, fx.fixed_point(_games(spark, sf_dir))), ["game", "house"])
