"""Queries of houses' names: every customer's nation is a team in one of the texts below; SQL has what each text means, not how it is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import houses
from larkspur.plans.boards import dealt, dealt_sql
from larkspur.plans.registry import query, table

#: (text with the team as @, market of the match, market of the team)
COLON = [
    ("Total de Cartões Mais/Menos", "Cartões", None), ("Faltas na partida", "Faltas", None), ("Total de Faltas para o jogo", "Faltas", None), ("Total de Laterais", "Laterais", None), ("Total de Arremessos Laterais", "Laterais", None),
    ("Total de Chutes", "Finalizações", None), ("Total de Chutes no Gol", "Chutes no gol", None), ("Total de Remates", "Finalizações", None), ("Total de Impedimentos", "Impedimentos", None), ("Total de Tiro de Meta", "Tiros de meta", None),
    ("Escanteios Mais/Menos", "Escanteios", None), ("Equipe com Mais Cartões", None, None), ("Qual equipe com mais escanteios", None, None), ("Total de Escanteios - 1º tempo", None, None), ("Total de Chutes do jogador", None, None), ("Faltas", None, None),
    ("@: Total de Faltas da Equipe Mais/Menos", None, "Faltas"), ("@: Chutes no gol", None, "Chutes no gol"), ("@: Chutes", None, "Finalizações"), ("@: Total de Cartões", None, "Cartões"), ("@: Cantos", None, "Escanteios"),
    ("@: Faltas no 1º tempo", None, None), ("@: Desarmes", None, "Desarmes"), ("@: Vencedor", None, None), ("@ total", None, None),
]
EXACT = [
    ("Total de Cartões", "Cartões", None), (" total de finalizações ", "Finalizações", None), ("Total de Chutes", "Finalizações", None), ("Total de Chutes no Gol", "Chutes no gol", None), ("Total de Arremessos Laterais", "Laterais", None),
    ("Total de Gols", None, None), ("Total de Faltas & Cartões", None, None), ("Total de Finalizações @", None, "Finalizações"), ("Total de Chutes no Gol @", None, "Chutes no gol"), ("Total de Cartões 1º tempo", None, None),
    ("@ - Total de Faltas", None, "Faltas"), ("@ - Chutes a gol", None, "Chutes no gol"), ("@ - Cantos", None, "Escanteios"), ("@ – Desarmes", None, "Desarmes"), ("@ - Cartões vermelhos", None, None), ("Silva, Jo - Faltas", None, None),
    ("@ - Total de cantos", None, None), ("Faltas", None, None),
]
PLURAL = [
    ("Total Cartões", "Cartões", None), ("Totais Chutes", "Finalizações", None), ("Totais chutes a gol", "Chutes no gol", None), ("Total de remates", "Finalizações", None), ("Total de Escanteios", "Escanteios", None),
    ("Total de Escanteios Ímpar/Par", None, None), ("Total de Faltas - 1º tempo", None, None), ("@ total de faltas", None, "Faltas"), ("@ Total Desarmes", None, "Desarmes"), ("Total de chutes @", None, "Finalizações"),
    ("Total de chutes a Gol @", None, "Chutes no gol"), ("Total impedimentos @", None, "Impedimentos"), ("@ total de gols", None, None), ("Total de faltas cometidas @", None, None), ("Escanteios", None, None),
]


def _expected(texts: list[tuple]) -> str:
    k = f"(c_custkey % {len(texts)})"
    team = dealt_sql([m for _, _, m in texts], k)
    return f"SELECT c_custkey AS id, {dealt_sql([m for _, m, _ in texts], k)} AS match, {team} AS team_market, CASE WHEN {team} IS NOT NULL THEN n_name END AS team FROM customer JOIN nation ON n_nationkey = c_nationkey"


def _told(spark: SparkSession, sf_dir: str, texts: list[tuple], match, team) -> DataFrame:
    both = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = both.select(F.col("c_custkey").alias("id"), F.replace(dealt([t for t, _, _ in texts], F.col("c_custkey") % len(texts)), F.lit("@"), F.col("n_name")).alias("name"))
    found = rows.select("id", match(F.col("name")).alias("match"), team(F.col("name")).alias("t"))
    return found.select("id", "match", F.col("t.market").alias("team_market"), F.col("t.team").alias("team"))


@query(_expected(COLON))
def house_colon_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, COLON, houses.colon_match, houses.colon_team)


@query(_expected(EXACT))
def house_exact_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, EXACT, houses.exact_match, houses.exact_team)


@query(_expected(PLURAL))
def house_plural_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, PLURAL, houses.plural_match, houses.plural_team)


_ODDS = """SELECT l_orderkey AS event, l_linenumber % 3 AS market_id, l_suppkey % 3 AS pos, CASE WHEN l_partkey % 8 > 0 THEN l_quantity % 4 + 0.5 END AS h, 0.9 + l_quantity / 13 AS coef, l_linestatus = 'F' AND l_partkey % 5 = 0 AS lock,
  l_partkey::BIGINT * 10 + l_linenumber AS seq FROM lineitem"""


@query(f"""SELECT event, market, team, h AS line, arg_max(coef, (seq, coef)) FILTER (side = 'over') AS "over", arg_max(coef, (seq, coef)) FILTER (side = 'under') AS "under" FROM (
  SELECT event, CASE market_id WHEN 0 THEN 'Faltas' ELSE 'Escanteios' END AS market, CASE market_id WHEN 2 THEN 'home' END AS team, h, round(coef, 2) AS coef, seq, CASE WHEN pos = CASE market_id WHEN 1 THEN 1 ELSE 0 END THEN 'over' WHEN pos = CASE market_id WHEN 1 THEN 0 ELSE 1 END THEN 'under' END AS side
  FROM ({_ODDS}) WHERE NOT lock AND coef > 1 AND h IS NOT NULL) GROUP BY event, market, team, h HAVING count(*) FILTER (side = 'over') > 0 AND count(*) FILTER (side = 'under') > 0""")
def house_coded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a house that numbers its markets and sides."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event"), (F.col("l_linenumber") % 3).alias("market_id"), (F.col("l_suppkey") % 3).alias("pos"), F.when(F.col("l_partkey") % 8 > 0, F.col("l_quantity") % 4 + 0.5).alias("h"),
        (0.9 + F.col("l_quantity") / 13).alias("coef"), ((F.col("l_linestatus") == "F") & (F.col("l_partkey") % 5 == 0)).alias("lock"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"))
    codes = spark.sql("SELECT * FROM VALUES (0, 'Faltas', CAST(NULL AS STRING), 0, 1), (1, 'Escanteios', NULL, 1, 0), (2, 'Escanteios', 'home', 0, 1) AS t(market_id, market, team, over_pos, under_pos)")
    return houses.coded_pairs(rows, codes, ["event"])


def _selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k: Column = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event"), (k % 2).alias("place"), F.when(F.col("l_suppkey") % 2 == 0, "Resultado Final").otherwise("Resultado Final (pagamento)").alias("result"), F.concat(F.lit(" m"), k % 2).alias("market"),
        F.when(F.col("l_suppkey") % 3 == 0, " Mais de").when(F.col("l_suppkey") % 3 == 1, "menos de").otherwise("exato").alias("name"), F.when(k % 3 == 0, "1").when(k % 3 == 1, "X").otherwise("2").alias("outcome"),
        F.when(F.col("l_partkey") % 9 > 0, F.col("l_quantity") % 2 + 0.5).alias("handicap"), F.when(F.col("l_partkey") % 7 > 0, F.round(1 + F.col("l_quantity") / 20, 2)).otherwise(0.0).alias("price"), (F.col("l_partkey") * 10 + k).alias("seq"))


_S = """SELECT l_orderkey AS event, l_linenumber % 2 AS place, 'm' || l_linenumber % 2 AS market, CASE l_suppkey % 3 WHEN 0 THEN 'over' WHEN 1 THEN 'under' END AS side, CASE l_linenumber % 3 WHEN 0 THEN '1' WHEN 1 THEN 'X' ELSE '2' END AS outcome,
  CASE WHEN l_partkey % 9 > 0 THEN l_quantity % 2 + 0.5 END AS line, CASE WHEN l_partkey % 7 > 0 THEN round(1 + l_quantity / 20, 2) ELSE 0.0 END AS price, l_partkey::BIGINT * 10 + l_linenumber AS seq FROM lineitem"""


@query(f"""SELECT event, market, line, arg_max(price, (seq, price)) FILTER (side = 'over') AS "over", arg_max(price, (seq, price)) FILTER (side = 'under') AS "under" FROM ({_S}) WHERE line IS NOT NULL AND price <> 0 GROUP BY event, market, line
  HAVING count(*) FILTER (side = 'over') > 0 AND count(*) FILTER (side = 'under') > 0""")
def house_selected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a house that lists selections with handicaps."""
    return houses.selected_pairs(_selections(spark, sf_dir), ["event"])


@query(f"""SELECT event, arg_min(home, place) AS home, arg_min(draw, place) AS draw, arg_min(away, place) AS away FROM (SELECT event, place, arg_max(price, (seq, price)) FILTER (outcome = '1') AS home, arg_max(price, (seq, price)) FILTER (outcome = 'X') AS draw,
  arg_max(price, (seq, price)) FILTER (outcome = '2') AS away FROM ({_S}) GROUP BY event, place) WHERE home IS NOT NULL AND draw IS NOT NULL AND away IS NOT NULL GROUP BY event""")
def house_three_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of home, draw and away, where one market has all three."""
    rows = _selections(spark, sf_dir).select("event", "place", F.col("result").alias("market"), F.col("outcome").alias("name"), "price", "seq")
    return houses.three_results(rows, ["event"])
