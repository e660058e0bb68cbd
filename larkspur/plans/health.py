"""Queries of gates over boards, and of what operators are told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import gates
from larkspur.plans.ledger import B, ledger
from larkspur.plans.registry import query

_GAMES = f"SELECT game, 'h' || game % 6 AS house, market || game % 5 AS market, line || side AS instrument, odd, id FROM ({B})"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("game", F.concat(F.lit("h"), F.col("game") % 6).alias("house"), F.concat("market", F.col("game") % 5).alias("market"), F.concat(F.col("line").cast("string"), "side").alias("instrument"), "odd", "id")


def _collapse(dead: int) -> str:
    """SQL of two boards, of which the later one lost the houses below ``dead`` and, in one market, most games."""
    now = f"SELECT * FROM ({_GAMES}) WHERE CAST(substr(house, 2) AS INTEGER) >= {dead} AND (market <> 'm13' OR game % 30 = 3) AND (house <> 'h4' OR market <> 'm22' OR id % 12 = 2)"
    count = lambda rows, keys, what: f"SELECT {keys}, count(DISTINCT {what}) AS n FROM ({rows}) GROUP BY ALL"
    lost = lambda keys, what, least: f"SELECT b.*, coalesce(a.n, 0) AS now FROM ({count(_GAMES, keys, what)}) b LEFT JOIN ({count(now, keys, what)}) a USING ({keys}) WHERE b.n >= {least} AND coalesce(a.n, 0) < b.n * 0.35"
    return f"""WITH h AS ({lost('house', 'game', 8)})
  SELECT 'house_collapse' AS gate, house AS subject, n || ' -> ' || now AS reason FROM h WHERE (SELECT count(*) FROM h) > 1
  UNION ALL SELECT 'market_collapse', market, n || ' -> ' || now FROM ({lost('market', 'game', 8)})
  UNION ALL SELECT 'pair_collapse', house || '|' || market, n || ' -> ' || now FROM ({lost('house, market', '(game, instrument)', 5)}) WHERE (SELECT count(*) FROM h) > 1 OR house NOT IN (SELECT house FROM h)"""


def _collapsed(spark: SparkSession, sf_dir: str, dead: int) -> DataFrame:
    before, game, i = _lines(spark, sf_dir), F.col("game"), F.col("id")
    alive = F.substring("house", 2, 9).cast("int") >= dead
    now = before.where(alive & ((F.col("market") != "m13") | (game % 30 == 3)) & ((F.col("house") != "h4") | (F.col("market") != "m22") | (i % 12 == 2)))
    return gates.coverage_collapse(now, before)


@query(_collapse(1))
def gate_one_dead_house(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A house that died alone blocks nothing; a market and a pair that collapsed do."""
    return _collapsed(spark, sf_dir, 1)


@query(_collapse(2))
def gate_two_dead_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dead houses block, with all their pairs."""
    return _collapsed(spark, sf_dir, 2)


_SEEN = f"SELECT game, CASE WHEN max(odd) >= 1.2 AND game % 9 = 0 THEN game END AS fixture, count(*) % 3 = 0 AS valued FROM ({B}) GROUP BY game"


@query(f"""WITH g AS ({_SEEN}), s AS (SELECT count(*) AS n, 100.0 * count(fixture) / count(*) AS pct, count(*) FILTER (valued) AS n_value, 100.0 * count(fixture) FILTER (valued) / count(*) FILTER (valued) AS pct_value FROM g), p AS (SELECT date_diff('minute', max(ts), TIMESTAMP '2024-02-01 06:00:00') AS m, count(*) AS n FROM ({B}))
  SELECT 'fixture_source' AS gate, 'fixtures' AS subject, 'invalid' AS reason FROM p WHERE n % 2 = 1
  UNION ALL SELECT 'fixture_source', 'fixtures', printf('%.1f hours old', CAST(floor(m / 60) AS DOUBLE)) FROM p WHERE floor(m / 60) > 12
  UNION ALL SELECT 'fixture_board', 'board', printf('%.1f%%', pct) FROM s WHERE n >= 10 AND pct < 15 UNION ALL SELECT 'fixture_value', 'board', printf('%.1f%%', pct_value) FROM s WHERE n_value >= 3 AND pct_value < 70""")
def gate_fixture_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of fixtures: valid, fresh, and wide enough for the board and for games of value."""
    rows = ledger(spark, sf_dir)
    games = rows.groupBy("game").agg(F.when((F.max("odd") >= 1.2) & (F.col("game") % 9 == 0), F.col("game")).alias("fixture"), (F.count("*") % 3 == 0).alias("valued"))
    minutes = (F.unix_timestamp(F.lit("2024-02-01 06:00:00").cast("timestamp")) - F.unix_timestamp(F.date_trunc("minute", F.max("ts")).cast("timestamp"))) / 60
    pointer = rows.agg((F.count("*") % 2 == 0).alias("valid"), F.floor(minutes / 60).cast("double").alias("age_hours"))
    return gates.fixture_health(games, pointer)


@query(f"""WITH g AS ({_SEEN}), h AS (SELECT house, count(*) % 2 = 0 AS ok FROM ({B}) GROUP BY house), m AS (SELECT market, count(DISTINCT game) AS n FROM ({B}) GROUP BY market)
  SELECT CASE WHEN count(*) < 3 THEN 'warn' ELSE 'bad' END AS level, 'failed_houses' AS kind, string_agg(house, ', ' ORDER BY house) AS subject FROM h WHERE NOT ok HAVING count(*) > 0
  UNION ALL SELECT CASE WHEN a > 120 THEN 'bad' ELSE 'warn' END, 'old_board', CAST(a AS VARCHAR) FROM (SELECT 60 + count(*) % 90 AS a FROM g) WHERE a > 90
  UNION ALL SELECT 'warn', 'few_fixtures', CAST(p AS VARCHAR) FROM (SELECT count(*) AS n, CAST(floor(100 * count(fixture) / count(*)) AS BIGINT) AS p FROM g) WHERE n >= 10 AND p < 40
  UNION ALL SELECT 'info', 'one_market', (SELECT arg_max(market, (n, market)) FROM m) WHERE (SELECT max(n) FROM m) >= (SELECT count(*) FROM g) * 0.7 AND (SELECT count(*) FROM m) >= 2
  UNION ALL SELECT 'info', 'no_history', CAST(count(*) AS VARCHAR) FROM g HAVING count(*) > 0""")
def operator_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operators are told about houses, the board, its markets and the history."""
    rows = ledger(spark, sf_dir)
    games = rows.groupBy("game").agg(F.when((F.max("odd") >= 1.2) & (F.col("game") % 9 == 0), F.col("game")).alias("fixture"))
    board = games.agg((60 + F.count("*") % 90).alias("age_minutes"), F.count("*").alias("games"), F.floor(100 * F.count("fixture") / F.count("*")).alias("fixture_percent"))
    houses = rows.groupBy("house").agg((F.count("*") % 2 == 0).alias("ok"))
    history = games.agg(F.count("*").alias("settled"), F.lit(0).alias("valid"))
    return gates.warnings(houses, board, rows.groupBy("market").agg(F.countDistinct("game").alias("games")), history)
