import datetime
import math

from larkspur.operators import models


def games(spark):
    return spark.createDataFrame([("L", 1, 2), ("L", 1, 9)], "league string, home_id int, away_id int")


def test_shots_shrink_to_the_league(spark):
    teams = spark.createDataFrame([("L", 1, 6.0, 4.0, 5.0, 5.0), ("L", 2, 5.0, 5.0, 4.0, 6.0)], "league string, team int, for_home double, against_home double, for_away double, against_away double")
    leagues = spark.createDataFrame([("L", 5.0, 4.0)], "league string, home double, away double")
    rows = models.shots(games(spark), teams, leagues, 0.5).collect()
    assert [(r.away_id, r.mu) for r in rows] == [(2, 9.5)]


def test_cards_have_a_floor(spark):
    teams = spark.createDataFrame([("L", 1, 0.0, 0.0, 0.0, 0.0), ("L", 2, 0.0, 0.0, 0.0, 0.0)], "league string, team int, h_given double, h_taken double, a_given double, a_taken double")
    assert models.cards(games(spark), teams, 1.0, 1.0).first().mu == 0.5


def test_corners_fall_back_on_the_season(spark):
    teams = spark.createDataFrame(
        [("L", 1, 6.0, 4.0, 5.0, 5.0, None, None), ("L", 2, 5.0, 5.0, 4.0, 6.0, 3.0, 7.0)],
        "league string, team int, for_home double, against_home double, for_away double, against_away double, recent_for double, recent_against double",
    )
    leagues = spark.createDataFrame([("L", 10.0)], "league string, total double")
    w = [0.0, 0.25, 0.25, 0.25, 0.25, 0.0]
    home, away = (6 + 6 + 6 + 7) / 4, (4 + 4 + 3 + 4) / 4
    assert math.isclose(models.corners(games(spark), teams, leagues, w, w, 0.2).first().mu, 0.8 * (home + away) + 2.0)


def test_foul_forms_need_games(spark):
    day = datetime.date(2026, 1, 1)
    rows = [("L", day + datetime.timedelta(days=i), i, 1, 2, 10 + i, 8) for i in range(4)]
    matches = spark.createDataFrame(rows, "league string, date date, match_id int, home_id int, away_id int, home_n int, away_n int")
    forms, totals = models.foul_forms(matches, 8.0)
    weights = [0.5 ** (k / 8) for k in range(4)]
    expected = sum(w * x for w, x in zip(weights, [13, 12, 11, 10], strict=True)) / sum(weights)
    got = {r.team: (r.given, r.taken) for r in forms.collect()}
    assert math.isclose(got[1][0], expected) and math.isclose(got[2][0], 8.0) and totals.count() == 0


def test_candidate_crosswalk(spark):
    g = spark.createDataFrame([("goals", "Serie A", 1, 2), ("goals", "X", 1, 2)], "market string, league string, home_id int, away_id int")
    pairs = spark.createDataFrame([("goals", "br", 1, 2, 2.5, 0.1, 1.0, 5.0)], "market string, competition string, home_id int, away_id int, mu_raw double, a double, b double, phi double")
    walk = spark.createDataFrame([("Serie A", "br")], "league string, competition string")
    assert [round(r.mu, 9) for r in models.candidate(g, pairs, walk).collect()] == [2.6]
