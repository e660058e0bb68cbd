"""Snapshots whose markets come in tabs: explode, drop incomplete pairs, map names, one row a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.keys import team_market

#: The tabs in their order, and the markets of a match by the names that tabs give them.
TABS = ("cartoes", "estatisticas", "principais_ou", "escanteios")
MATCH_MARKETS = {
    "Total de Cartões": "Cartões", "Total de Faltas": "Faltas", "Total de chutes": "Finalizações", "Escanteios": "Escanteios", "Chutes no gol": "Chutes no gol",
    "Total de Impedimentos": "Impedimentos", "Total de laterais": "Laterais", "Total de tiros de meta": "Tiros de meta",
}
_ROW = "array<struct<market: string, line: double, over: double, under: double>>"
SCHEMA = f"event_id string, name string, league string, start string, captured_at string, markets struct<{', '.join(f'{t}: {_ROW}' for t in TABS)}>, _corrupt string"


def tabbed(spark: SparkSession, path: str) -> DataFrame:
    """(event columns, tab, pos, raw, line, over, under) of every complete pair; lines that do not read and prices of zero are left out."""
    rows = spark.read.schema(SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt IS NULL")
    tabs = F.array(*[F.struct(F.lit(k).alias("tab"), F.col(f"markets.{t}").alias("rows")) for k, t in enumerate(TABS)])
    each = rows.select("event_id", "name", "league", "start", "captured_at", F.explode(tabs).alias("t")).select("event_id", "name", "league", "start", "captured_at", "t.tab", F.posexplode("t.rows").alias("pos", "r"))
    out = each.select("event_id", "name", "league", "start", "captured_at", "tab", "pos", F.col("r.market").alias("raw"), "r.line", "r.over", "r.under")
    return out.where("line IS NOT NULL AND coalesce(over, 0) != 0 AND coalesce(under, 0) != 0")


def _match_market(raw: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in MATCH_MARKETS.items() for x in kv])[raw]


def _one(rows: DataFrame, by: list[str], first: bool, *values: str) -> DataFrame:
    pick = F.min_by if first else F.max_by
    return rows.groupBy(*by).agg(pick(F.struct(*values), F.struct("tab", "pos")).alias("v")).select(*by, "v.*")


def board_lines(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, market, team, line, over, under): match lines and, with a team, team lines; the first of a line wins, prices in cents."""
    rows = tabbed(spark, path).withColumns({"match": _match_market(F.col("raw")), "t": team_market(F.col("raw"))})
    market = F.coalesce("match", "t.market")
    team = F.when(F.col("match").isNull(), F.col("t.team"))
    named = rows.withColumns({"market": market, "team": team, "over": F.round("over", 2), "under": F.round("under", 2)}).where("market IS NOT NULL")
    return _one(named, ["event_id", "market", "team", "line"], True, "over", "under")


def history_lines(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, home, away, market, line, over, under) of match lines alone; the last of a line wins. Names split at `` vs `` or `` - ``."""
    rows = tabbed(spark, path).withColumn("market", _match_market(F.col("raw"))).where("market IS NOT NULL")
    parts = F.transform(F.split(F.regexp_replace(F.coalesce("name", F.lit("")), r" vs\.? ", " - "), " - "), lambda p: F.trim(p))
    sides = rows.withColumns({"home": F.get(parts, F.lit(0)), "away": F.coalesce(F.get(parts, F.lit(1)), F.lit(""))})
    return _one(sides, ["event_id", "home", "away", "market", "line"], False, "over", "under")
