"""Queries of count models: teams are the suppliers, leagues the nations, games the orders, matches of fouls the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import models
from larkspur.plans.registry import query, table

#: A game has sides from the suppliers of one league; a pair that is not in it has no price.
GAMES = "SELECT o_orderkey AS id, 'L' || o_orderkey % 5 AS league, o_custkey % 100 AS h, (o_custkey // 2) % 110 AS a FROM orders"
TEAMS = "SELECT 'L' || i AS league, s_suppkey AS team, s_suppkey % 7 + 0.5 AS p, s_suppkey % 5 + 1.0 AS q, s_suppkey % 6 + 0.25 AS r, s_suppkey % 4 + 2.0 AS s, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 8 + 0.5 END AS u, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 9 + 0.5 END AS v FROM supplier, (SELECT unnest([0, 1, 2, 3]) AS i)"
LEAGUES = "SELECT 'L' || n_nationkey AS league, n_nationkey + 4.5 AS home, n_nationkey + 4.0 AS away FROM nation"
_ON = "JOIN t h ON h.league = g.league AND h.team = g.h JOIN t w ON w.league = g.league AND w.team = g.a"
_WITH = f"WITH g AS ({GAMES}), t AS ({TEAMS}), l AS ({LEAGUES})"
HOME, AWAY = [0.5, 0.25, 0.2, 0.15, 0.1, 0.3], [0.4, 0.2, 0.25, 0.1, 0.15, 0.2]


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("L"), k % 5).alias("league"), (c % 100).alias("home_id"), (F.floor(c / 2) % 110).alias("away_id"))


def _teams(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Six figures a team under the given names."""
    s = F.col("s_suppkey")
    figures = [s % 7 + 0.5, s % 5 + 1.0, s % 6 + 0.25, s % 4 + 2.0, F.when(s % 3 > 0, s % 8 + 0.5), F.when(s % 4 > 0, s % 9 + 0.5)]
    return table(spark, sf_dir, "supplier").select(F.explode(F.array(*[F.lit(f"L{i}") for i in range(4)])).alias("league"), s.alias("team"), *[f.cast("double").alias(n) for f, n in zip(figures, names, strict=False)])


def _leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("L"), n).alias("league"), (n + 4.5).cast("double").alias("home"), (n + 4.0).cast("double").alias("away"))


@query(f"{_WITH} SELECT id, round(greatest(0.5, 4.5 + 0.6 * (((h.p + w.s) / 2 + (w.r + h.q) / 2) - 4.5))::DOUBLE, 6) AS mu FROM g {_ON}")
def cards_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = _teams(spark, sf_dir, ["h_given", "h_taken", "a_given", "a_taken"])
    return models.cards(_games(spark, sf_dir), teams, 4.5, 0.6).select("id", F.round("mu", 6).alias("mu"))


@query(f"{_WITH} SELECT id, round(greatest(1.0, home + away + 0.7 * (((h.p + w.s) / 2 + (w.r + h.q) / 2) - (home + away)))::DOUBLE, 6) AS mu FROM g {_ON} JOIN l ON l.league = g.league")
def shots_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = _teams(spark, sf_dir, ["for_home", "against_home", "for_away", "against_away"])
    return models.shots(_games(spark, sf_dir), teams, _leagues(spark, sf_dir), 0.7).select("id", F.round("mu", 6).alias("mu"))


def _side(w: list[float], own: str, f: str, opp: str, g: str) -> str:
    return f"({w[0]} + {w[1]} * {own}.{f} + {w[2]} * {opp}.{g} + {w[3]} * coalesce({own}.u, {own}.{f}) + {w[4]} * coalesce({opp}.v, {opp}.{g}) + {w[5]} * (home + away) / 2)"


@query(f"{_WITH} SELECT id, round(greatest(1.0, 0.8 * ({_side(HOME, 'h', 'p', 'w', 's')} + {_side(AWAY, 'w', 'r', 'h', 'q')}) + 0.2 * (home + away))::DOUBLE, 6) AS mu FROM g {_ON} JOIN l ON l.league = g.league")
def corners_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = _teams(spark, sf_dir, ["for_home", "against_home", "for_away", "against_away", "recent_for", "recent_against"])
    totals = _leagues(spark, sf_dir).select("league", (F.col("home") + F.col("away")).alias("total"))
    return models.corners(_games(spark, sf_dir), teams, totals, HOME, AWAY, 0.2).select("id", F.round("mu", 6).alias("mu"))


def _decayed(rows: str, by: str, value: str, half_life: int, last: int, least: int) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY date DESC, match_id DESC) - 1 AS k FROM ({rows})"
    return f"SELECT {by}, sum(pow(0.5, k / {half_life}.0) * {value}) / sum(pow(0.5, k / {half_life}.0)) AS mean FROM ({ranked}) WHERE k < {last} GROUP BY {by} HAVING count(*) >= {least}"


_MATCHES = "SELECT 'L' || l_orderkey % 5 AS league, l_shipdate AS date, l_orderkey * 10 + l_linenumber AS match_id, l_suppkey AS home_id, l_suppkey + 1 + l_linenumber AS away_id, l_quantity AS home_n, l_partkey % 20 AS away_n FROM lineitem"
_EACH = f"SELECT home_id AS team, date, match_id, home_n AS given, away_n AS taken FROM ({_MATCHES}) UNION ALL SELECT away_id, date, match_id, away_n, home_n FROM ({_MATCHES})"


@query(f"""WITH g AS ({GAMES}), f AS (SELECT x.team, x.mean AS given, y.mean AS taken FROM ({_decayed(_EACH, 'team', 'given', 8, 80, 3)}) x JOIN ({_decayed(_EACH, 'team', 'taken', 8, 80, 3)}) y ON x.team = y.team),
  t AS ({_decayed(f'SELECT *, home_n + away_n AS n FROM ({_MATCHES})', 'league', 'n', 120, 300, 40)})
  SELECT id, round(t.mean + 0.5 * (((h.given + w.taken) / 2 + (w.given + h.taken) / 2) - t.mean), 6) AS mu FROM g JOIN f h ON h.team = g.h JOIN f w ON w.team = g.a JOIN t ON t.league = g.league""")
def fouls_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of teams and totals of leagues from their latest matches."""
    o, n, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    matches = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("L"), o % 5).alias("league"), F.col("l_shipdate").alias("date"), (o * 10 + n).alias("match_id"), s.alias("home_id"), (s + 1 + n).alias("away_id"), F.col("l_quantity").alias("home_n"), (F.col("l_partkey") % 20).alias("away_n"))
    forms, totals = models.foul_forms(matches, 8.0)
    return models.fouls(_games(spark, sf_dir), forms, totals, 0.5).select("id", F.round("mu", 6).alias("mu"))


@query(f"""WITH g AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'goals' ELSE 'corners' END AS market, CASE WHEN league IN ('L1', 'L2') THEN 'cup' ELSE league END AS competition FROM ({GAMES})),
  p AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'goals' ELSE 'corners' END AS market, CASE WHEN c_custkey % 4 = 3 THEN 'cup' ELSE 'L' || c_custkey % 4 END AS competition, c_custkey % 100 AS h, (c_custkey // 2) % 110 AS a, max(c_custkey) % 9 / 2.0 - 1 AS mu_raw FROM customer GROUP BY ALL)
  SELECT id, round(greatest(0.1, 0.2 + 1.1 * mu_raw)::DOUBLE, 6) AS mu FROM g JOIN p USING (market, competition, h, a)""")
def candidate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's own means of pairs, under its names of leagues."""
    c = F.col("c_custkey")
    market = lambda k: F.when(k % 2 == 0, "goals").otherwise("corners").alias("market")
    pairs = table(spark, sf_dir, "customer").groupBy(
        market(c), F.when(c % 4 == 3, "cup").otherwise(F.concat(F.lit("L"), c % 4)).alias("competition"), (c % 100).alias("home_id"), (F.floor(c / 2) % 110).alias("away_id")
    ).agg((F.max("c_custkey") % 9 / 2 - 1).alias("mu_raw")).withColumns({"a": F.lit(0.2), "b": F.lit(1.1)})
    walk = table(spark, sf_dir, "nation").where("n_nationkey IN (1, 2)").select(F.concat(F.lit("L"), "n_nationkey").alias("league"), F.lit("cup").alias("competition"))
    games = _games(spark, sf_dir).withColumn("market", market(F.col("id")))
    return models.candidate(games, pairs, walk).select("id", F.round("mu", 6).alias("mu"))
