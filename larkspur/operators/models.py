"""Count models: games joined to team and league tables give a mean, prices come from functions.prob.

Each function takes games(league, home_id, away_id, ...) and adds mu; games without the needed rows are left out,
as they have no price. Team and league tables are dimensions; Spark broadcasts them where they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.history import half_life_mean


def _with_teams(games: DataFrame, teams: DataFrame) -> DataFrame:
    """games with the columns of teams(league, team, ...) as structs h and a."""
    row = F.struct(*[c for c in teams.columns if c not in ("league", "team")])
    side = lambda key, name: teams.select("league", F.col("team").alias(key), row.alias(name))
    return games.join(side("home_id", "h"), ["league", "home_id"]).join(side("away_id", "a"), ["league", "away_id"])


def _shrunk(raw: Column, centre: Column, beta: float, least: float) -> Column:
    """raw drawn towards centre, at least least."""
    return F.greatest(F.lit(least), centre + beta * (raw - centre))


def cards(games: DataFrame, teams: DataFrame, mean: float, beta: float) -> DataFrame:
    """teams(league, team, h_given, h_taken, a_given, a_taken): cards shown at home and away, to both sides."""
    t = _with_teams(games, teams)
    raw = (F.col("h.h_given") + F.col("a.a_taken")) / 2 + (F.col("a.a_given") + F.col("h.h_taken")) / 2
    return t.withColumn("mu", _shrunk(raw, F.lit(mean), beta, 0.5)).drop("h", "a")


def shots(games: DataFrame, teams: DataFrame, leagues: DataFrame, beta: float) -> DataFrame:
    """teams(league, team, for_home, against_home, for_away, against_away), leagues(league, home, away)."""
    t = _with_teams(games, teams).join(leagues.select("league", (F.col("home") + F.col("away")).alias("_total")), "league")
    raw = (F.col("h.for_home") + F.col("a.against_away")) / 2 + (F.col("a.for_away") + F.col("h.against_home")) / 2
    return t.withColumn("mu", _shrunk(raw, F.col("_total"), beta, 1.0)).drop("h", "a", "_total")


def corners(games: DataFrame, teams: DataFrame, leagues: DataFrame, home: list[float], away: list[float], blend: float) -> DataFrame:
    """Linear in six weights a side, blended with the league's total; recent figures fall back on the season's.

    teams(league, team, for_home, against_home, for_away, against_away, recent_for, recent_against), leagues(league, total).
    """
    t = _with_teams(games, teams).join(leagues.select("league", F.col("total").alias("_total")), "league")

    def side(w: list[float], own: str, own_for: str, opp: str, opp_against: str) -> Column:
        f, g = F.col(f"{own}.{own_for}"), F.col(f"{opp}.{opp_against}")
        parts = [f, g, F.coalesce(f"{own}.recent_for", f), F.coalesce(f"{opp}.recent_against", g), F.col("_total") / 2]
        return sum((weight * part for weight, part in zip(w[1:], parts, strict=True)), F.lit(w[0]))

    both = side(home, "h", "for_home", "a", "against_away") + side(away, "a", "for_away", "h", "against_home")
    return t.withColumn("mu", F.greatest(F.lit(1.0), (1 - blend) * both + blend * F.col("_total"))).drop("h", "a", "_total")


def foul_forms(matches: DataFrame, half_life: float) -> tuple[DataFrame, DataFrame]:
    """matches(league, date, match_id, home_id, away_id, home_n, away_n) to team forms and league totals.

    Forms are half-life means of the last 80 games, from 3 on; league totals of the last 300 at 120, from 40 on.
    """
    each = matches.select(F.col("home_id").alias("team"), "date", "match_id", F.col("home_n").alias("given"), F.col("away_n").alias("taken")).union(
        matches.select("away_id", "date", "match_id", "away_n", "home_n"))
    order = [F.desc("date"), F.desc("match_id")]
    given = half_life_mean(each, ["team"], order, "given", half_life, 80, 3).select("team", F.col("mean").alias("given"))
    taken = half_life_mean(each, ["team"], order, "taken", half_life, 80, 3).select("team", F.col("mean").alias("taken"))
    totals = half_life_mean(matches.withColumn("n", F.col("home_n") + F.col("away_n")), ["league"], order, "n", 120, 300, 40)
    return given.join(taken, "team"), totals.select("league", F.col("mean").alias("total"))


def fouls(games: DataFrame, forms: DataFrame, totals: DataFrame, beta: float) -> DataFrame:
    """forms(team, given, taken) and totals(league, total), as foul_forms() gives them."""
    side = lambda key, name: forms.select(F.col("team").alias(key), F.struct("given", "taken").alias(name))
    t = games.join(side("home_id", "h"), "home_id").join(side("away_id", "a"), "away_id").join(totals.select("league", F.col("total").alias("_total")), "league")
    raw = (F.col("h.given") + F.col("a.taken")) / 2 + (F.col("a.given") + F.col("h.taken")) / 2
    return t.withColumn("mu", F.col("_total") + beta * (raw - F.col("_total"))).drop("h", "a", "_total")


def candidate(games: DataFrame, pairs: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """pairs(market, competition, home_id, away_id, mu_raw, a, b, phi); crosswalk(league, competition) renames leagues."""
    g = games.join(crosswalk, "league", "left").withColumn("competition", F.coalesce("competition", "league"))
    return g.join(pairs, ["market", "competition", "home_id", "away_id"]).withColumn("mu", F.greatest(F.lit(0.1), F.col("a") + F.col("b") * F.col("mu_raw")))
