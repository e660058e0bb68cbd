"""Identities that hold two real games: found by clusters of names, split by evidence, carried through records, settlements and ticks.

Names are those of norm_team. Within a fixture each distinct pair of names is compared with each other one once; those are the
spellings of some houses, however many records there are. What is known of a fixture is one row, which its records meet by fixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.names import side_hit
from larkspur.operators.fixtures import reassigned_scores, reassignment
from larkspur.operators.identity import cut, unify
from larkspur.operators.matching import by_names, four

#: Fixed value: how alike each side must be for two pairs of names to be one game.
SIDE_LEAST = 55

#: What a record is known by besides its game.
KEY = ["house", "market", "line", "side"]


def same_game(home: Column, away: Column, other_home: Column, other_away: Column) -> Column:
    """Whether both sides are alike, straight or crossed."""
    return four(lambda a, b: side_hit(a, b) >= SIDE_LEAST, home, away, other_home, other_away, lambda hh, aa, ha, ah: (hh & aa) | (ha & ah))


def _named(records: DataFrame) -> DataFrame:
    """(fixture, names, names_id, own_home, own_away), a row for each fixture that has names: the one thing of the records that is kept.

    own_home and own_away are the most frequent names of records that were matched by both sides; the least of equally frequent ones.
    """
    named = records.where("fixture IS NOT NULL AND home != '' AND away != ''")
    counted = named.groupBy("fixture", "home", "away").agg(F.count(F.when(F.col("method") == "pair", 1)).alias("pairs") if "method" in records.columns else F.lit(0).cast("long").alias("pairs"))
    name = F.struct("home", "away")
    own = F.min_by(F.when(F.col("pairs") > 0, name), F.when(F.col("pairs") > 0, F.struct(-F.col("pairs"), "home", "away")))
    out = counted.groupBy("fixture").agg(F.sort_array(F.collect_list(name)).alias("names"), own.alias("own"))
    return cut(out.select("fixture", "names", F.sha2(F.to_json("names"), 256).alias("names_id"), F.col("own.home").alias("own_home"), F.col("own.away").alias("own_away")))


def _clustered(named: DataFrame) -> DataFrame:
    """(names_id, home, away, first) of each distinct set of names: names with the same first ones are spellings of one game.

    Fixtures of the same teams and houses have the same names, so each distinct set is clustered once.
    """
    sets = named.groupBy("names_id").agg(F.min("names").alias("names")).select("names_id", F.explode("names").alias("n"))
    pairs = cut(sets.select("names_id", "n.home", "n.away", F.to_json(F.struct("names_id", "n.home", "n.away")).alias("node")))
    other = pairs.select("names_id", F.col("home").alias("f_home"), F.col("away").alias("f_away"), F.col("node").alias("f_node"))
    near = pairs.join(other, "names_id").where("node < f_node")
    alike = by_names(near, "alike", same_game(*[F.col(c) for c in ("home", "away", "f_home", "f_away")]))
    parts = unify(alike.where("alike").select(F.col("node").alias("a"), F.col("f_node").alias("b")))
    known = pairs.join(parts, "node", "left").withColumn("first", F.from_json(F.coalesce("component", "node"), "names_id string, home string, away string"))
    return known.select("names_id", "home", "away", "first")


def name_clusters(records: DataFrame) -> DataFrame:
    """(fixture, home, away, component) of each fixture's distinct pairs of names: pairs of one component are spellings of one game.

    Records without fixture or without a name of either side say nothing.
    """
    whole = _named(records)
    clusters = _clustered(whole).groupBy("names_id").agg(F.collect_list(F.struct("home", "away", "first")).alias("c"))
    out = whole.select("fixture", "names_id").join(clusters, "names_id").select("fixture", F.explode("c").alias("c"))
    return out.select("fixture", "c.home", "c.away", F.to_json(F.struct("fixture", F.col("c.first.home").alias("home"), F.col("c.first.away").alias("away"))).alias("component"))


def impure(records: DataFrame) -> DataFrame:
    """(fixture, clusters) of fixtures that hold more than one game."""
    return name_clusters(records).groupBy("fixture").agg(F.countDistinct("component").alias("clusters")).where("clusters > 1")


def _judged(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """(fixture, new_fixture, new_kickoff, scores) of impure fixtures; scores(home, away, own, new) has each of their names."""
    named = _named(records)
    wrong = _clustered(named).groupBy("names_id").agg(F.countDistinct("first").alias("n")).where("n > 1").select("names_id")
    known = named.join(wrong, "names_id").drop("names_id").join(evidence, "fixture", "left")
    sides = ("own_home", "own_away", "new_home", "new_away")
    cases = known.select("names", *sides).distinct()  # of the same names again and again
    each = reassigned_scores(cases.select("names", *sides, F.explode("names").alias("n")).select("names", *sides, "n.home", "n.away"))
    scored = each.groupBy("names", *sides).agg(F.collect_list(F.struct("home", "away", "s.own", "s.new")).alias("scores"))
    same = F.col("k.names") == F.col("d.names")
    for c in sides:
        same &= F.col(f"k.{c}").eqNullSafe(F.col(f"d.{c}"))
    return known.alias("k").join(scored.alias("d"), same).select("k.fixture", "k.new_fixture", "k.new_kickoff", "d.scores")


def split(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """records(game, KEY, fixture, home, away, method, kickoff, status, result, close_odd, ...) with their games put right.

    evidence(fixture, new_fixture, new_home, new_away, new_kickoff) names the other game of a fixture. A record of an impure fixture
    is kept where its names are the owner's, moved where they are the other game's and its kickoff is near enough, and else put in
    quarantine under its day and names. What left was settled by the wrong game's result, so it is open or closed again.

    Records are read twice, for the names of fixtures and for their verdicts, and meet these by fixture alone: records that are
    dealt out by fixture are not shuffled again.
    """
    known = _judged(records, evidence).withColumnRenamed("new_fixture", "_fixture")
    judged = records.join(known, "fixture", "left")
    mine = F.get(F.filter("scores", lambda s: (s["home"] == F.col("home")) & (s["away"] == F.col("away"))), F.lit(0))
    verdict = reassignment(*[F.col(c) for c in ("home", "away", "kickoff", "new_kickoff")], *[F.coalesce(mine[c], F.lit(0.0)) for c in ("own", "new")])
    judged = judged.withColumn("verdict", F.when(F.col("scores").isNull(), "pure").otherwise(verdict)).drop("scores", "new_kickoff")
    moved, gone = F.col("verdict") == "move", ~F.col("verdict").isin("pure", "keep")
    alone = F.concat_ws("|", F.coalesce(F.to_date("kickoff").cast("string"), F.lit("?")), F.coalesce("home", F.lit("")), F.coalesce("away", F.lit("")))
    reset = gone & (F.col("status") == "settled")
    return judged.withColumns({
        "moved_from": F.when(gone, F.col("game")),
        "game": F.when(moved, F.concat(F.lit("sofa:"), F.col("_fixture").cast("string"))).when(gone, alone).otherwise(F.col("game")),
        "fixture": F.when(moved, F.col("_fixture")).when(gone, F.lit(None)).otherwise(F.col("fixture")),
        "method": F.when(moved, "migrated_evidence").when(gone, "quarantined").otherwise(F.col("method")),
        "result": F.when(reset, F.lit(None)).otherwise(F.col("result")),
        "status": F.when(reset, F.when(F.coalesce("close_odd", F.lit(0.0)) != 0, "closed").otherwise("open")).otherwise(F.col("status")),
        "reset": F.coalesce(reset, F.lit(False)),
    }).drop("_fixture")


def targets(rows: DataFrame, records: DataFrame) -> DataFrame:
    """rows(game, KEY, ...) with price_game and line_game: where split's records that left took their prices and their moves of the main line; null: nowhere.

    A price goes with its record. A move of the main line is of a house's market: it goes where all records that left went, and stays
    if they went to several games. All that left a game is one row, so rows are dealt out by game once.
    """
    left = records.where("moved_from IS NOT NULL").select("moved_from", *KEY, "game").repartition("moved_from")
    price = left.groupBy("moved_from", *KEY).agg(F.min("game").alias("to"), F.max("game").alias("most"))
    by = price.groupBy("moved_from", "house", "market").agg(F.collect_list(F.struct("line", "side", "to")).alias("prices"), F.min("to").alias("to"), F.max("most").alias("most"))
    part = F.struct("house", "market", "prices", F.when(F.col("to") == F.col("most"), F.col("to")).alias("line"))
    gone = by.groupBy(F.col("moved_from").alias("game")).agg(F.collect_list(part).alias("_gone"))
    met = rows.join(gone, "game", "left").withColumn("_part", F.get(F.filter("_gone", lambda g: (g["house"] == F.col("house")) & (g["market"] == F.col("market"))), F.lit(0)))
    mine = F.get(F.filter("_part.prices", lambda p: (p["line"] == F.col("line")) & (p["side"] == F.col("side"))), F.lit(0))
    return met.withColumns({"price_game": mine["to"], "line_game": F.col("_part.line")}).select(*rows.columns, "price_game", "line_game")


def retargeted(ticks: DataFrame, records: DataFrame) -> DataFrame:
    """ticks(game, KEY, kind, ...) under the games that split's records went to."""
    to = F.when(F.col("kind") == "line_move", F.col("line_game")).otherwise(F.col("price_game"))
    return targets(ticks, records).withColumns({"game": F.coalesce(to, F.col("game")), "retargeted": to.isNotNull()}).select(*ticks.columns, "retargeted")
