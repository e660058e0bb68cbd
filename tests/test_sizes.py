"""Plans and figures that must not grow faster than the input."""

import datetime
import random

from pyspark.sql import functions as F

from larkspur import plans
from larkspur.operators import identity, repair


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rungs_are_exploded_without_a_join(spark, sf):
    assert "Join" not in plan(plans.QUERIES["sql_ladder_explode"](spark, sf))


def test_rivals_are_counted_not_paired(spark):
    rng = random.Random(7)
    start = datetime.datetime(2024, 3, 1, 22)
    rows = [(k, start + datetime.timedelta(seconds=rng.choice([0, 60, 1500, 1501, 90, rng.randint(0, 14400)]))) for k in range(300)] + [(900, None)]
    frame = spark.createDataFrame(rows, "game long, kickoff timestamp").withColumn("day", F.to_date("kickoff"))
    days = {r.game: (r.day, r.kickoff) for r in frame.collect()}
    near = lambda a, b: days[a][0] is not None and days[a][0] == days[b][0] and a != b and abs(days[a][1] - days[b][1]) <= datetime.timedelta(minutes=25)
    out = identity.slot_rivals(frame, "day", "kickoff", "game", 25)
    assert {r.game: r.rivals for r in out.collect()} == {a: sum(near(a, b) for b in days) for a in days}
    shared = [line for line in plan(out).splitlines() if "Join" in line and "_day" in line]
    assert shared and all("_us" in line or "slot" in line for line in shared)  # rows of a day never meet by the day alone


def names_compared(frame):
    """Operators of the plan that hold a comparison of names, and whether each reads distinct rows."""
    lines = frame._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [i for i, line in enumerate(lines) if "bit_count" in line.lower()]
    return [any("Aggregate" in line for line in lines[i + 1 : i + 4]) for i in at]


def test_names_of_rows_are_compared_once(spark, sf):
    for name in ("reassign_evidence", "same_game_edges", "board_game_edges"):
        seen = names_compared(plans.QUERIES[name](spark, sf))
        assert seen and any(seen), name


def test_prices_are_of_means_not_of_parts(spark, sf):
    lines = plans.QUERIES["fair_odds"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explodes = [i for i, line in enumerate(lines) if "Generate explode" in line]
    assert explodes and any("Aggregate" in line for line in lines[explodes[-1] :])


def test_families_are_counted_after_the_shuffle(spark, sf):
    text = plan(plans.QUERIES["family_pick_rank"](spark, sf))
    assert "Aggregate" not in text[text.rindex("Exchange") :] and "SortAggregate" not in text


def test_sets_of_names_are_clustered_once(spark):
    spellings = [("harbour celtic", "quarry albion"), ("harbour", "albion quarry"), ("ajax", "porto"), ("porto", "ajax fc")]
    rows = [(f, h, a) for f in range(40) for h, a in spellings[: 2 + f % 3]] + [(90, "", "x"), (None, "a", "b"), (91, "x", "y")]
    out = repair.name_clusters(spark.createDataFrame(rows, "fixture long, home string, away string")).collect()
    assert len(out) == len({(r.fixture, r.home, r.away) for r in out}) == sum(2 + f % 3 for f in range(40)) + 1
    parts = {}
    for r in out:
        parts.setdefault(r.fixture, set()).add(r.component)
    assert all(len(parts[f]) == (1 if f % 3 == 0 else 2) for f in range(40)) and len(parts[91]) == 1
    assert len(set.union(*parts.values())) == sum(map(len, parts.values()))  # no two fixtures share one
