"""Fuzzy joins: events to fixtures, names to ids, instruments to results. Blocks are civil days."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.names import leagues_conflict, token_set_ratio
from larkspur.functions.prob import bind, once

PAIR_SCORE, NAME_SCORE, RESULT_SCORE = 80.0, 88.0, 85.0
MINUTES = 45


def pair_score(home: Column, away: Column, other_home: Column, other_away: Column) -> Column:
    """The better of the straight and the crossed pairing; each is as good as its worse side."""
    return four(token_set_ratio, home, away, other_home, other_away, lambda hh, aa, ha, ah: F.greatest(F.least(hh, aa), F.least(ha, ah)))


def four(
    compare: Callable[[Column, Column], Column], home: Column, away: Column, other_home: Column, other_away: Column, body: Callable[[Column, Column, Column, Column], Column]
) -> Column:
    """body of compare for home and other_home, away and other_away, home and other_away, away and other_home; compare stands once in the plan, which is long."""
    pairs = F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in ((home, other_home), (away, other_away), (home, other_away), (away, other_home))])
    return bind(F.transform(pairs, lambda p: compare(p["a"], p["b"])), lambda s: body(*[F.get(s, F.lit(i)) for i in range(4)]))


def minutes_apart(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(F.unix_micros(a) - F.unix_micros(b)) / 60e6, F.lit(9999.0))


def by_names(rows: DataFrame, name: str, value: Column, names: tuple[str, ...] = ("home", "away", "f_home", "f_away")) -> DataFrame:
    """rows with the column value of their names under name: names come again with each house and capture, so each distinct four is compared once."""
    each = once(rows.select(*names).distinct(), name, value)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in names]
    return rows.alias("r").join(each.alias("d"), reduce(lambda a, b: a & b, same)).select("r.*", f"d.{name}")


def named_pairs(left: DataFrame, right: DataFrame, name: str, value: Column, least: float, other: tuple[str, str] = ("f_home", "f_away")) -> DataFrame:
    """(day, home, away, other, name): distinct names of left(day, home, away) with those of right(day, other) of their day, where value is least or more.

    Houses and captures repeat the names of a game, so the names of a day are far fewer than its rows; each four is compared once, whatever
    the days on which it stands. Rows are joined to what is left.
    """
    names = ("home", "away", *other)
    days = left.select("day", "home", "away").distinct().join(right.select("day", *other).distinct(), "day")
    return by_names(days, name, value, names).where(F.col(name) >= least)


def with_pairs(left: DataFrame, pairs: DataFrame, right: DataFrame, other: tuple[str, str] = ("f_home", "f_away")) -> DataFrame:
    """left joined by day and names with pairs of named_pairs, and by theirs with right."""
    meet = lambda a, b, columns: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])
    rows = left.alias("l").join(pairs.alias("p"), meet("l", "p", ("day", "home", "away")))
    score = [c for c in pairs.columns if c not in ("day", "home", "away", *other)]
    near = rows.select("l.*", *[f"p.{c}" for c in (*other, *score)])
    return near.alias("n").join(right.alias("r"), meet("n", "r", ("day", *other))).select("n.*", *[f"r.{c}" for c in right.columns if c not in ("day", *other)])


def to_fixtures(events: DataFrame, fixtures: DataFrame) -> DataFrame:
    """events(event, day, kickoff, home, away, league) with the best fixture(fixture, ...) of the day, or null.

    A day's fixtures are few; the day and the minutes apart cut candidates before names are compared.
    """
    f = fixtures.select("day", F.col("fixture"), F.col("kickoff").alias("f_kickoff"), F.col("home").alias("f_home"), F.col("away").alias("f_away"), F.col("league").alias("f_league"))
    near = events.join(f, "day").where((minutes_apart(F.col("kickoff"), F.col("f_kickoff")) <= MINUTES) & ~leagues_conflict(F.col("league"), F.col("f_league")))
    scored = near.withColumn("score", pair_score(F.col("home"), F.col("away"), F.col("f_home"), F.col("f_away"))).where(F.col("score") >= PAIR_SCORE)
    best = scored.groupBy("event").agg(F.max_by(F.struct("fixture", "score"), F.struct("score", -minutes_apart(F.col("kickoff"), F.col("f_kickoff")), "fixture")).alias("b"))
    return events.join(best, "event", "left").select(*events.columns, "b.fixture", "b.score")


def to_ids(names: DataFrame, known: DataFrame, block: str) -> DataFrame:
    """names(name, block) to known(name, block, id): exact first, else the best similar name of the block."""
    exact = names.join(known.select("name", block, "id"), ["name", block], "left")
    rest = exact.where("id IS NULL").drop("id")
    k = known.select(block, F.col("name").alias("k_name"), F.col("id").alias("k_id"))
    fuzzy = rest.join(k, block).withColumn("score", token_set_ratio(F.col("name"), F.col("k_name"))).where(F.col("score") >= NAME_SCORE)
    best = fuzzy.groupBy("name", block).agg(F.max_by("k_id", F.struct("score", F.col("k_name"))).alias("id"))
    return exact.where("id IS NOT NULL").unionByName(rest.join(best, ["name", block], "left").select(*exact.columns))


def to_results(instruments: DataFrame, results: DataFrame, field: str) -> DataFrame:
    """instruments(key, day, home, away) with the result of the day: with the field first, manual first, then by score."""
    r = results.select("day", F.col("home").alias("r_home"), F.col("away").alias("r_away"), "manual", F.col(field).alias("result"))
    score = F.least(token_set_ratio(F.col("home"), F.col("r_home")), token_set_ratio(F.col("away"), F.col("r_away")))
    near = with_pairs(instruments, named_pairs(instruments, r, "score", score, RESULT_SCORE, ("r_home", "r_away")), r, ("r_home", "r_away"))
    order = Window.partitionBy("key").orderBy(F.col("result").isNull(), F.desc("manual"), F.desc("score"), "r_home", "r_away")
    best = near.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("key", "result", "score")
    return instruments.join(best, "key", "left")
