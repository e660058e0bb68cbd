"""Raw house feeds to over/under pairs: classify the market, classify the side, pivot, keep complete pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.names import plain

#: Market names as (market, pattern), in the order in which they are tried, and what is never a match total.
MARKETS = (
    ("Escanteios", r"escanteio|corner"),
    ("Cartões", r"cart(ao|oes)|card|booking"),
    ("Chutes no gol", r"chutes? (a|no|ao) gol|shots? on (target|goal)"),
    ("Finalizações", r"finaliza|total de chutes|total shots|chutes"),
    ("Faltas", r"falta|foul"),
    ("Impedimentos", r"impediment|offside"),
    ("Gols", r"gols|goals"),
)
NOT_TOTALS = r"jogador|player|primeiro|segundo|1o|2o|1º|2º|tempo|half|handicap|exat|exact|par|impar|asiatic"
VIRTUAL = r"virtual|e-?sport|esoccer|cyber|simulad|\(e\)"


def market_of(name: Column) -> Column:
    text = plain(name)
    out = F.when(text.rlike(NOT_TOTALS), None)
    for market, pattern in MARKETS:
        out = out.when(text.rlike(pattern), market)
    return out


def side_of(text: Column) -> Column:
    t = plain(text)
    return F.when(t.rlike(r"\b(over|mais|acima)\b"), "over").when(t.rlike(r"\b(under|menos|abaixo)\b"), "under")


def line_of(text: Column) -> Column:
    """The number in a text such as ``Over 5.5``; quarter lines written with commas are refused."""
    return F.when(~text.contains(","), F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1)).try_cast("double")


def real_events(rows: DataFrame, name: str = "name", league: str = "league") -> DataFrame:
    """Without virtual and electronic games and without negative ids."""
    return rows.where(~plain(F.col(name)).rlike(VIRTUAL) & ~plain(F.col(league)).rlike(VIRTUAL) & ~F.col("event_id").cast("string").startswith("-"))


def pairs(selections: DataFrame, by: list[str]) -> DataFrame:
    """selections(by, line, side, odd, seq) to complete pairs, the first value of a side winning, in order of lines."""
    first = lambda side: F.min_by(F.when(F.col("side") == side, F.col("odd")), F.when(F.col("side") == side, F.col("seq")))
    both = selections.groupBy(*by, "line").agg(first("over").alias("over"), first("under").alias("under"))
    return both.where("over IS NOT NULL AND under IS NOT NULL AND line IS NOT NULL")


def documents(lines: DataFrame, event: list[str]) -> DataFrame:
    """lines(event, market, line, over, under) to normalized events with a map from market to its ladder."""
    ladders = lines.groupBy(*event, "market").agg(F.sort_array(F.collect_list(F.struct(F.col("line").alias("linha"), "over", "under"))).alias("rows"))
    return ladders.groupBy(*event).agg(F.map_from_entries(F.collect_list(F.struct("market", "rows"))).alias("mercados"))


def first_events(rows: DataFrame, tiers: list[str], league: str, start: str, n: int) -> DataFrame:
    """The first n events by tier of league pattern, then start: a cap that is the feature."""
    tier = F.lit(len(tiers))
    for k, pattern in reversed(list(enumerate(tiers))):
        tier = F.when(plain(F.col(league)).rlike(pattern), F.lit(k)).otherwise(tier)
    return rows.withColumn("tier", tier).orderBy("tier", F.col(start).asc_nulls_last(), "event_id").limit(n)


def in_window(start: Column, now: Column, hours: float) -> Column:
    """Whether an event starts within hours from now; one whose start does not read passes."""
    return F.coalesce((start >= now) & (F.unix_micros(start) - F.unix_micros(now) <= int(hours * 3_600_000_000)), F.lit(True))
