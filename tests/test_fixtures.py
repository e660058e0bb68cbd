"""Identity operators on small tables: tiers and guards, pins, groups, re-assignment."""

import datetime

from pyspark.sql import functions as F

from larkspur.functions import names
from larkspur.operators import fixtures as fx
from larkspur.operators import matching

DAY = datetime.date(2024, 5, 4)
EVENT = "event int, day date, kickoff timestamp, home string, away string, league string"
FIXTURE = "fixture int, day date, kickoff timestamp, home string, away string, league string"
GAME = "game long, day date, kickoff timestamp, home string, away string, fixture int, n int"


def at(hour, minute=0, day=DAY):
    return datetime.datetime(day.year, day.month, day.day, hour, minute)


def test_tiers_and_guards(spark):
    fixtures = spark.createDataFrame(
        [
            (1, DAY, at(15), "grasshoppers zurich", "young boys bern", "sui"), (2, DAY, at(15, 10), "sporting ridgeway", "real mapleton", None),
            (3, DAY, at(18), "orchard rangers f", "willow vale f", None), (4, DAY, at(20), "quarry albion", "harbour celtic", "eng"), (5, DAY, at(22), "lonely hearts", "meadow lane", None),
        ],
        FIXTURE,
    )
    events = spark.createDataFrame(
        [
            (1, DAY, at(15, 20), "young boys", "grasshoppers", "sui"),  # crossed, words held
            (2, DAY, at(15), "sporting kansas", "real", None),  # weak words only
            (3, DAY, at(18), "orchard rangers", "willow vale", None),  # not the women's game
            (4, DAY, at(20), "quarry albion", "harbour celtic", "esp"),  # another league
            (5, DAY, at(23), "lonely hearts", "meadow lane", None),  # an hour off
            (6, DAY, at(20), "quarry albion", "harbour celtic", "eng"), (7, DAY, at(21, 40), "lonely hearts", "meadow", "xx"), (8, DAY, None, "lonely hearts", "meadow lane", None),
        ],
        EVENT,
    )
    got = {r.event: (r.fixture, r.method, r.confidence, r.home) for r in fx.resolved(events, fixtures).collect()}
    assert got[1][:2] == (1, "pair") and got[1][3] == "grasshoppers zurich"
    assert got[6][:2] == (4, "pair") and got[6][2] == 95 and got[7][0] == 5
    for event in (2, 3, 4, 5, 8):
        assert got[event][:3] == (None, "unmatched", 40), event


def test_flags_and_sides(spark):
    c = lambda x: F.lit(x)
    row = spark.range(1).select(
        names.flags(c("willow vale f u20")), names.pair_flags(c("a f"), c("b")) == names.pair_flags(c("b"), c("a f")), names.side_hit(c("sporting cristal"), c("sporting kansas city")),
        names.side_hit_strong(c("sporting cristal"), c("sporting kansas city")) < 50, names.side_hit_strong(c("real united"), c("real")), fx.assigned_side(c("harbour"), c("quarry albion"), c("harbour celtic")),
    ).first()
    assert tuple(row) == ("f u20", True, 92.0, True, 0.0, "away")


def test_pins(spark):
    schema = "house string, event int, raw_home string, raw_away string, fixture int, method string, day date, home string, away string, confidence int"
    answers = spark.createDataFrame(
        [
            ("h", 1, "ajax", "porto", None, "unmatched", DAY, "ajax", "porto", 40), ("h", 2, "ajax", "porto", 9, "pair", DAY, "ajax x", "porto x", 95),
            ("h", 3, "other", "names", None, "unmatched", DAY, "other", "names", 40), ("h", 4, "ajax", "porto", None, "unmatched", DAY, "ajax", "porto", 40), ("h", 6, "a", "b", 3, "pair", DAY, "a", "b", 90),
        ],
        schema,
    )
    before = DAY - datetime.timedelta(days=1)
    pins = spark.createDataFrame([("h", 1, 7, DAY, "ajax", "porto", 90), ("h", 2, None, before, "ajax", "porto", 40), ("h", 3, 8, DAY, "ajax", "porto", 90), ("h", 4, None, before, "ajax", "porto", 41), ("h", 5, 5, DAY, "x", "y", 90)], "house string, event int, fixture int, day date, home string, away string, confidence int")
    out = fx.pinned(answers, pins).cache()
    got = {r.event: (r.fixture, r.method, r.day) for r in out.collect()}
    assert got == {1: (7, "house_map", DAY), 2: (9, "pair", DAY), 3: (None, "unmatched", DAY), 4: (None, "house_map_legacy", before), 6: (3, "pair", DAY)}
    assert {(r.event, r.fixture) for r in fx.next_pins(out, pins).collect()} == {(1, 7), (2, 9), (3, None), (4, None), (5, 5), (6, 3)}


def games(spark):
    late, early = DAY, DAY + datetime.timedelta(days=1)
    return spark.createDataFrame(
        [
            (1, late, at(23), "harbour celtic", "quarry albion", None, 5), (2, early, at(0, 0, early), "quarry albion", "harbour celtic", 70, 2), (3, early, at(21, 0, early), "quarry albion", "harbour celtic", None, 9),
            (4, late, at(23), "harbour celtic f", "quarry albion f", None, 1), (5, late, None, "quarry albion", "harbour celtic", 71, 1), (6, late, at(12), "", "x", None, 1), (7, late, at(9), "willow vale", "orchard", None, 3), (8, late, at(9), "vale willow", "orchard", None, 4),
        ],
        GAME,
    )


def test_games_are_unified_under_guards(spark):
    got = {r.game: r.canonical for r in fx.fixed_point(games(spark)).collect()}
    assert got[1] in (2, 5) and got[2] == 2 and got[5] == 5  # never two fixtures in one
    assert got[4] == 4 and got[6] == 6 and got[7] == got[8] == 8
    assert got[3] != 2  # 21 hours apart
    both = fx.groups(games(spark), fx.board_edges(games(spark)))
    assert {r.canonical for r in both.where("game IN (7, 8)").collect()} == {8}


def test_margin_and_reassignment(spark):
    fixtures = spark.createDataFrame([(1, DAY, "harbour celtic", "quarry albion"), (2, DAY, "harbour celtic ii", "quarry albion ii"), (3, DAY, "ajax", "porto")], "fixture int, day date, home string, away string")
    rows = spark.createDataFrame([(1, DAY, "porto", "ajax"), (2, DAY, "harbour celtic", "quarry albion"), (3, DAY, "nobody", "else")], "key int, day date, home string, away string")
    assert {r.key: r.fixture for r in fx.by_margin(rows, fixtures).collect()} == {1: 3, 2: None, 3: None}
    cases = spark.createDataFrame(
        [(1, "ajax", "porto", at(9), "ajax", "porto", "x", "y", at(9)), (2, "ajax", "porto", at(9), "x", "y", "ajax", "porto", at(10)), (3, "ajax", "porto", at(9), "x", "y", "ajax", "porto", at(23)), (4, "ajax", "", None, "x", "y", "ajax", "porto", at(1)), (5, "ajax", "porto", None, None, None, "ajax", "porto", at(1))],
        "key int, home string, away string, kickoff timestamp, own_home string, own_away string, new_home string, new_away string, new_kickoff timestamp",
    )
    assert {r.key: r.verdict for r in fx.reassigned(cases).collect()} == {1: "keep", 2: "move", 3: "quarantine", 4: "quarantine", 5: "move"}


def test_names_are_compared_once_and_rows_stay(spark):
    rows = spark.createDataFrame([(1, "ajax", "porto", "porto", "ajax"), (2, "ajax", "porto", "porto", "ajax"), (3, None, "porto", "porto", None), (4, None, None, None, None), (5, "ajax", "x", "ajar", "x")], "id int, home string, away string, f_home string, f_away string")
    score = matching.pair_score(*[F.coalesce(F.col(c), F.lit("")) for c in ("home", "away", "f_home", "f_away")])
    got = {r.id: r.score for r in matching.by_names(rows, "score", score).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1] == got[2] == 100 and got[3] == got[4] == 0 and got[5] == 75
