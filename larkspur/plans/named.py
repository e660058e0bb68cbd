"""Queries in SQL alone, over the names that functions.sql_names registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import sql_names
from larkspur.plans.ledger import B, ledger
from larkspur.plans.prices import _FLAGS, ladders, models
from larkspur.plans.registry import query

_BOARD = """
WITH priced AS (
  SELECT l.*, m.mu, poisson_over(m.mu, l.line) AS p_over, poisson_push(m.mu, l.line) AS p_push
  FROM {l} l JOIN {m} m USING (grp)
  WHERE l.over > 1.01 AND l.over <= 50 AND l.under > 1.01 AND l.under <= 50 AND margin(l.over, l.under) BETWEEN 0 AND 0.12
)
SELECT * FROM (
  SELECT grp, a1, a2, a3, house, line, over, under, round(expected_value(p_over, over, p_push), 6) AS ev, round(conditional_win(p_over, p_push) - fair_over(over, under), 6) AS edge
  FROM priced WHERE p_over BETWEEN 0.15 AND 0.85)
WHERE ev >= 0.05 AND edge >= 0.04
"""


@query(_FLAGS)
def sql_board_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of ev_edge_flags from a text of SQL over registered names."""
    sql_names.register(spark)
    return spark.sql(_BOARD, l=ladders(spark, sf_dir), m=models(spark, sf_dir))


#: The table function ladder_explode would join the events with their distinct texts.
_EXPLODED = """
SELECT game, market, pos, line, over, round(fair_over(over, under), 6) AS fair FROM (
  SELECT game, market, pos, try_variant_get(rung, '$.linha', 'double') AS line, try_variant_get(rung, '$.over', 'double') AS over, try_variant_get(rung, '$.under', 'double') AS under
  FROM (SELECT game, market, market_rungs(body) AS rungs FROM (SELECT game, event_markets(event) AS markets FROM {e}) LATERAL VIEW explode(markets) m AS market, body) LATERAL VIEW posexplode(rungs) r AS pos, rung)
"""
_RUNGS = f"SELECT game, market, row_number() OVER (PARTITION BY game, market ORDER BY id) - 1 AS pos, line, odd AS over FROM ({B})"


@query(f"SELECT game, market, CAST(pos AS INTEGER) AS pos, line, over, round((1 / over) / (1 / over + 1 / (over + 0.2)), 6) AS fair FROM ({_RUNGS})")
def sql_ladder_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON to their rungs by generators over a registered name, priced by another one."""
    sql_names.register(spark)
    rungs = ledger(spark, sf_dir).groupBy("game", "market").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.col("line").alias("linha"), F.col("odd").alias("over"), (F.col("odd") + 0.2).alias("under")))), lambda r: r.dropFields("id")).alias("rows"))
    events = rungs.groupBy("game").agg(F.map_from_entries(F.collect_list(F.struct("market", "rows"))).alias("mercados")).select("game", F.to_json(F.struct("mercados")).alias("event"))
    return spark.sql(_EXPLODED, e=events)
