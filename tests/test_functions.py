import datetime
import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import names, prob, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_probabilities_sum_to_one(spark):
    p = one(spark, prob.ou_probs(lambda k: prob.poisson_cdf(k, F.lit(9.0)), F.lit(9.0), F.lit(8.0)))
    assert math.isclose(p.over + p.under + p.push, 1.0) and p.push > 0
    half = one(spark, prob.ou_probs(lambda k: prob.poisson_cdf(k, F.lit(9.0)), F.lit(9.0), F.lit(8.5)))
    assert half.push == 0 and math.isclose(half.under, 0.455652604322419, abs_tol=1e-12)
    assert tuple(one(spark, prob.ou_probs(lambda k: prob.poisson_cdf(k, F.lit(0.0)), F.lit(0.0), F.lit(2.5)))) == (0.0, 1.0, 0.0)


def test_fair_odd_has_no_value(spark):
    p = prob.ou_probs(lambda k: prob.negbin_size_cdf(k, F.lit(10.0), F.lit(4.0)), F.lit(10.0), F.lit(10.0))
    ev = prob.expected_value(p["over"], prob.fair_odd(p["over"], p["push"]), p["push"])
    assert abs(one(spark, ev)) < 1e-12


def test_implied_mean(spark):
    fair = (1 / 1.92) / (1 / 1.92 + 1 / 1.88)
    assert abs(one(spark, prob.solve_mu(F.lit(10.0), F.lit(fair))) - 10.127) < 0.02


@pytest.mark.parametrize(("price", "odd"), [(150, 2.5), (-200, 1.5), (100, 2.0), (50, None)])
def test_american(spark, price, odd):
    assert one(spark, prob.american_to_decimal(F.lit(price))) == odd


@pytest.mark.parametrize(("name", "key"), [("Ceará CE", "ceara"), ("Londrina-PR", "londrina"), ("France", "france"), ("Guayaquil City F.C.", "guayaquil city"), ("FC", "fc"), (None, "")])
def test_team_names(spark, name, key):
    assert one(spark, names.norm_team(F.lit(name).cast("string"))) == key


def test_aliases_come_before_the_state(spark):
    assert one(spark, names.norm_team(F.lit("CRB"), {"crb": "crb al", "cap pi": "atletico piauiense"})) == "crb al"
    assert one(spark, names.norm_team(F.lit("CAP PI"), {"crb": "crb al", "cap pi": "atletico piauiense"})) == "atletico piauiense"


def test_token_set_ratio(spark):
    ratio = lambda a, b: one(spark, names.token_set_ratio(F.lit(a), F.lit(b)))
    assert ratio("sao paulo", "paulo sao fc") == 100.0
    assert ratio("", "x") == 0.0
    assert math.isclose(ratio("abcd", "abxd"), 75.0)


@pytest.mark.parametrize("text", ["2026-07-14T10:00:00Z", "2026-07-14T10:00:00+00:00", "2026-07-14 07:00:00-0300", "1784023200", "1784023200000", "/Date(1784023200000)/"])
def test_instants(spark, text):
    assert one(spark, times.parse_instant(F.lit(text)).cast("string")) == "2026-07-14 10:00:00"


def test_naive_and_unreadable_instants(spark):
    assert one(spark, times.parse_instant(F.lit("2026-07-14_0700"), "-03:00").cast("string")) == "2026-07-14 10:00:00"
    assert one(spark, times.parse_instant(F.lit("soon"))) is None


def test_null_rules_differ(spark):
    none, now = F.lit(None).cast("timestamp"), F.lit(datetime.datetime(2026, 1, 1))
    assert one(spark, times.pre_kickoff(none, now)) is True
    assert one(spark, times.prematch(none, now)) is False
    assert one(spark, times.prematch(now, none)) is True
    assert one(spark, times.freezes(now, none)) is False


def test_leagues(spark):
    assert one(spark, names.league_class(F.lit("Brasileirão Série B"))) == "br-b"
    assert one(spark, names.league_class(F.lit("CONMEBOL Libertadores"))) == "liberta"
    assert one(spark, names.league_class(F.lit("Unknown"))) is None
