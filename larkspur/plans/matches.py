"""Queries of fuzzy joins. Fixtures are the orders, six a day; house events are the events, four a day, each about one of the fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import names
from larkspur.operators import fixtures as fx
from larkspur.operators import matching
from larkspur.plans.boards import dealt, dealt_sql
from larkspur.plans.registry import query, table
from larkspur.plans.similar import known

TEAMS = [
    "harbour celtic", "harbour", "quarry albion", "albion quarry", "willow vale", "willow vale f", "orchard rangers", "orchard rangers u20", "sporting ridgeway", "sporting oakridge", "real mapleton",
    "mapleton", "lonely hearts", "meadow lane", "meadows", "grasshoppers zurich", "young boys bern", "young boys", "eastfield rovers", "eastfeld rovers", "", "inter sport", "nacional",
]
CLASSES = ["epl", "ucl", None]
N = len(TEAMS)
_MINUTES = [0, 10, 30, 55, None]

#: (fixture, day, kickoff, home, away, league, r): fixture r of the numbering by keys; and events about fixture r.
FIXTURES = f"""SELECT fixture, day, day + hour * INTERVAL 1 HOUR AS kickoff, home, away, league FROM (SELECT o_orderkey AS fixture, DATE '2000-01-01' + CAST(o_orderkey // 6 AS INTEGER) AS day, 12 + (o_orderkey % 6) // 2 AS hour,
  {dealt_sql(TEAMS, 'o_orderkey')} AS home, {dealt_sql(TEAMS, '(o_orderkey * 5 + 2)')} AS away, {dealt_sql(CLASSES, '(o_orderkey // 2)')} AS league FROM orders)"""
_R = "(event_id // 4 * 6 + event_id % 4)"
EVENTS = f"""SELECT event, day, day + hour * INTERVAL 1 HOUR + late * INTERVAL 1 MINUTE AS kickoff, CASE WHEN crossed THEN y ELSE x END AS home, CASE WHEN crossed THEN x ELSE y END AS away, league FROM (
  SELECT event_id AS event, DATE '2000-01-01' + CAST(event_id // 4 AS INTEGER) AS day, 12 + ({_R} % 6) // 2 AS hour, {dealt_sql(_MINUTES, 'event_id')}::BIGINT AS late, event_id % 3 = 0 AS crossed,
  {dealt_sql(TEAMS, f'({_R} + event_id % 2)')} AS x, {dealt_sql(TEAMS, f'({_R} * 5 + 2 + event_id // 2 % 2)')} AS y, {dealt_sql(CLASSES, f'({_R} // 2 + event_id // 9 % 3)')} AS league FROM events)"""


def _at(key: Column, a_day: int) -> Column:
    return F.date_add(F.lit("2000-01-01").cast("date"), F.floor(key / a_day).cast("int"))


def _hour(day: Column, r: Column) -> Column:
    return day.cast("timestamp") + F.make_dt_interval(hours=(F.lit(12) + F.floor((r % 6) / 2)).cast("int"))


def board_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = _at(k, 6)
    return table(spark, sf_dir, "orders").select(
        k.alias("fixture"), day.alias("day"), _hour(day, k).alias("kickoff"), dealt(TEAMS, k).alias("home"), dealt(TEAMS, k * 5 + 2).alias("away"), dealt(CLASSES, F.floor(k / 2)).alias("league"))


def house_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    r, day = F.floor(i / 4) * 6 + i % 4, _at(i, 4)
    late = F.get(F.array(*[F.lit(m).cast("int") for m in _MINUTES]), (i % len(_MINUTES)).cast("int"))
    x, y = dealt(TEAMS, r + i % 2), dealt(TEAMS, r * 5 + 2 + F.floor(i / 2) % 2)
    return table(spark, sf_dir, "events").select(
        i.alias("event"), day.alias("day"), (_hour(day, r) + F.make_dt_interval(mins=late)).alias("kickoff"), F.when(i % 3 == 0, y).otherwise(x).alias("home"), F.when(i % 3 == 0, x).otherwise(y).alias("away"),
        dealt(CLASSES, F.floor(r / 2) + F.floor(i / 9) % 3).alias("league"))


def _found(events: str, league: str) -> str:
    """SQL twin of the tiers over a relation of events."""
    return f"""SELECT event, arg_max(fixture, (score, rank, -m, fixture)) AS fixture, max(score) AS score, arg_max(method, (score, rank, -m, fixture)) AS method, arg_max(strong, (score, rank, -m, fixture)) AS strong FROM (
  SELECT event, fixture, m, strong, unnest([{{'score': greatest(pair, (rh + ra) / 2) + greatest(0.0, 40 - m), 'rank': 0, 'method': 'pair', 'holds': m <= {fx.PAIR_MINUTES} AND ((pair >= {fx.PAIR_LEAST} AND (strong >= {fx.SIDE_LEAST} OR pair >= {fx.PAIR_SURE})) OR sided)}},
    {{'score': strong + greatest(0.0, 25 - m) + CASE WHEN league = f_league THEN 5.0 ELSE 0.0 END, 'rank': -1, 'method': 'one_side', 'holds': m <= {fx.ONE_MINUTES} AND strong >= {fx.ONE_LEAST} AND second >= {fx.ONE_SECOND} AND rivals = 0}},
    {{'score': 80 + strong * 0.2::DOUBLE + greatest(0.0, 20 - m), 'rank': -2, 'method': 'slot_unique', 'holds': m <= {fx.SLOT_MINUTES} AND strong >= {fx.SLOT_LEAST} AND second >= {fx.SLOT_SECOND} AND slot = 1}}], recursive := true)
  FROM (SELECT z.*, (SELECT count(*) FROM {league} g WHERE g.event = z.event AND g.fixture <> z.fixture AND abs(epoch_us(g.f_kickoff) - epoch_us(z.f_kickoff)) <= {fx.ONE_MINUTES} * 60000000::BIGINT AND greatest(g.rh, g.ra) >= {fx.ONE_LEAST - 2}) AS rivals,
    (SELECT count(*) FROM {league} g WHERE g.event = z.event AND abs(epoch_us(g.f_kickoff) - epoch_us(z.f_kickoff)) <= {fx.SLOT_MINUTES} * 60000000::BIGINT) AS slot FROM {league} z)
  WHERE coalesce(league = f_league, true) AND flags = f_flags) WHERE holds AND event IN (SELECT event FROM ({events})) GROUP BY event"""


def _seen(condition: str) -> str:
    best = "list_max([{'strong': hh.strong, 'second': aa.hit}, {'strong': ha.strong, 'second': ah.hit}, {'strong': ah.strong, 'second': ha.hit}, {'strong': aa.strong, 'second': hh.hit}])"
    return f"""SELECT *, best.strong AS strong, best.second AS second FROM (SELECT e.event, f.fixture, f.kickoff AS f_kickoff, e.league, f.league AS f_league, abs(epoch_us(e.kickoff) - epoch_us(f.kickoff)) / 60e6::DOUBLE AS m,
    greatest(least(hh.ratio, aa.ratio), least(ha.ratio, ah.ratio)) AS pair, greatest(hh.hit, ha.hit) AS rh, greatest(ah.hit, aa.hit) AS ra, {best} AS best,
    (hh.strong >= {fx.SIDE_LEAST} AND aa.strong >= {fx.SIDE_LEAST}) OR (ha.strong >= {fx.SIDE_LEAST} AND ah.strong >= {fx.SIDE_LEAST}) AS sided, list_sort([hh.fa, aa.fa]) AS flags, list_sort([hh.fb, aa.fb]) AS f_flags
  FROM ev e JOIN fi f ON e.day = f.day AND abs(epoch_us(e.kickoff) - epoch_us(f.kickoff)) <= {(fx.PAIR_MINUTES + fx.ONE_MINUTES)} * 60000000::BIGINT {condition}
  JOIN k hh ON hh.a = e.home AND hh.b = f.home JOIN k ha ON ha.a = e.home AND ha.b = f.away JOIN k ah ON ah.a = e.away AND ah.b = f.home JOIN k aa ON aa.a = e.away AND aa.b = f.away)"""


_TIERS = f"""WITH {known(TEAMS)}, ev AS ({EVENTS}), fi AS ({FIXTURES}), near1 AS MATERIALIZED ({_seen('AND e.league = f.league')}), near2 AS MATERIALIZED ({_seen('')}),
  one AS MATERIALIZED ({_found('SELECT event FROM ev', 'near1')}), two AS ({_found('SELECT event FROM ev WHERE event NOT IN (SELECT event FROM one)', 'near2')}), found AS MATERIALIZED (SELECT * FROM one UNION ALL SELECT * FROM two)"""


@query(f"{_TIERS} SELECT event, fixture, round(score, 6) AS score, method FROM found")
def event_fixture_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sides, one sure side, or the only fixture of a slot, under marks and leagues."""
    return fx.matched(house_events(spark, sf_dir), board_fixtures(spark, sf_dir)).select("event", "fixture", F.round("score", 6).alias("score"), "method")


@query(f"""{_TIERS} SELECT e.event, d.fixture, coalesce(method, 'unmatched') AS method, CAST(coalesce(f.day, e.day) AS VARCHAR) AS day, coalesce(f.kickoff, e.kickoff) AS kickoff, coalesce(f.home, e.home) AS home, coalesce(f.away, e.away) AS away, coalesce(f.league, e.league) AS league,
  CASE WHEN d.fixture IS NOT NULL THEN least(CASE method WHEN 'pair' THEN 95 WHEN 'one_side' THEN 85 ELSE 70 END, CAST(trunc(CASE WHEN method = 'one_side' THEN strong ELSE score END) AS INTEGER)) WHEN e.home <> '' AND e.away <> '' THEN 40 ELSE 0 END AS confidence
  FROM ev e LEFT JOIN found d ON d.event = e.event LEFT JOIN fi f ON f.fixture = d.fixture""")
def resolve_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event under its fixture's identity, or its own."""
    out = fx.resolved(house_events(spark, sf_dir), board_fixtures(spark, sf_dir))
    return out.withColumns({"day": F.col("day").cast("string"), "kickoff": F.col("kickoff").cast("timestamp_ntz")})


def _pair(h: str, a: str, x: str, y: str, name: str = "score") -> tuple[str, str]:
    """SQL for pair_score of four names, and the joins with k that it needs."""
    one = lambda p, q, n: f" LEFT JOIN k {name}{n} ON {name}{n}.a = {p} AND {name}{n}.b = {q}"
    r = lambda n: f"{name}{n}.ratio"
    return f"greatest(least({r(1)}, {r(2)}), least({r(3)}, {r(4)}))", one(h, x, 1) + one(a, y, 2) + one(h, y, 3) + one(a, x, 4)


_PIN, _PIN_JOINS = _pair("e.home", "e.away", "p.home", "p.away")
_PINS = f"SELECT event, day - CAST(event % 2 AS INTEGER) AS day, CASE WHEN event % 5 > 1 THEN event END AS fixture, {dealt_sql(TEAMS, '(event // 4 * 6 + event % 4)')} AS home, {dealt_sql(TEAMS, '((event // 4 * 6 + event % 4) * 5 + 2)')} AS away, 90 AS confidence FROM ({EVENTS}) WHERE event % 7 > 0"


@query(f"""WITH {known(TEAMS)}, e AS (SELECT *, CASE WHEN event % 4 > 0 THEN event + 1 END AS found FROM ({EVENTS})), x AS (SELECT e.*, p.fixture AS p_fixture, p.day AS p_day, p.home AS p_home, p.away AS p_away, coalesce({_PIN} >= {fx.PIN_LEAST}, false) AS holds
  FROM e LEFT JOIN ({_PINS}) p ON p.event = e.event {_PIN_JOINS}), y AS (SELECT *, holds AND p_fixture IS NOT NULL AS fixed, holds AND p_fixture IS NULL AND found IS NULL AS legacy FROM x)
  SELECT event, CASE WHEN fixed THEN p_fixture ELSE found END AS fixture, CASE WHEN fixed THEN 'house_map' WHEN legacy THEN 'house_map_legacy' ELSE 'pair' END AS method, CAST(CASE WHEN fixed OR legacy THEN p_day ELSE day END AS VARCHAR) AS day, CASE WHEN fixed OR legacy THEN p_home ELSE home END AS home,
  CASE WHEN fixed OR legacy THEN p_away ELSE away END AS away, CASE WHEN fixed OR legacy THEN 90 ELSE 50 END AS confidence FROM y""")
def house_map_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier answers hold while the names are alike."""
    e, i = house_events(spark, sf_dir), F.col("event")
    r = F.floor(i / 4) * 6 + i % 4
    answers = e.select(F.lit("h").alias("house"), "event", F.col("home").alias("raw_home"), F.col("away").alias("raw_away"), F.when(i % 4 > 0, i + 1).alias("fixture"), F.lit("pair").alias("method"), "day", "home", "away", F.lit(50).alias("confidence"))
    pins = e.where(i % 7 > 0).select(F.lit("h").alias("house"), "event", F.when(i % 5 > 1, i).alias("fixture"), F.date_sub("day", (i % 2).cast("int")).alias("day"), dealt(TEAMS, r).alias("home"), dealt(TEAMS, r * 5 + 2).alias("away"), F.lit(90).alias("confidence"))
    return fx.pinned(answers, pins).select("event", "fixture", "method", F.col("day").cast("string").alias("day"), "home", "away", "confidence")


@query(f"""WITH {known(TEAMS)}, n AS (SELECT DISTINCT {dealt_sql(TEAMS, 'event_id')} AS name, event_id % 4 AS block FROM events), d AS (SELECT name, block, min(id) AS id FROM (SELECT {dealt_sql(TEAMS, '(c_custkey * c_custkey)')} AS name, c_custkey % 4 AS block, c_custkey AS id FROM customer) GROUP BY ALL)
  SELECT n.name, n.block, coalesce(x.id, (SELECT arg_max(d.id, (k.ratio, d.name)) FROM d JOIN k ON k.a = n.name AND k.b = d.name WHERE d.block = n.block AND k.ratio >= {matching.NAME_SCORE})) AS id FROM n LEFT JOIN d x ON x.name = n.name AND x.block = n.block""")
def team_model_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of houses to a model's teams: equal, else the most alike of the league."""
    i, c = F.col("event_id"), F.col("c_custkey")
    wanted = table(spark, sf_dir, "events").select(dealt(TEAMS, i).alias("name"), (i % 4).alias("block")).distinct()
    there = table(spark, sf_dir, "customer").groupBy(dealt(TEAMS, c * c).alias("name"), (c % 4).alias("block")).agg(F.min("c_custkey").alias("id"))
    return matching.to_ids(wanted, there, "block").select("name", "block", "id")


@query(f"""WITH {known(TEAMS)}, c AS (SELECT e.event AS key, CASE WHEN f.fixture % 3 > 0 THEN f.fixture % 12 END::DOUBLE AS result, f.fixture % 2 AS manual, least(h.ratio, a.ratio) AS score, f.home, f.away FROM ({EVENTS}) e JOIN ({FIXTURES}) f ON f.day = e.day
  JOIN k h ON h.a = e.home AND h.b = f.home JOIN k a ON a.a = e.away AND a.b = f.away), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY result IS NULL, manual DESC, score DESC, home, away) AS k FROM c WHERE score >= {matching.RESULT_SCORE})
  SELECT e.event AS key, b.result, round(b.score, 6) AS score FROM ({EVENTS}) e LEFT JOIN b ON b.key = e.event AND b.k = 1""")
def settle_fuzzy_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's result of each instrument by names: known first, by hand first, most alike first."""
    k = F.col("fixture")
    results = board_fixtures(spark, sf_dir).select("day", "home", "away", (k % 2).alias("manual"), F.when(k % 3 > 0, k % 12).cast("double").alias("corners"))
    out = matching.to_results(house_events(spark, sf_dir).withColumnRenamed("event", "key"), results, "corners")
    return out.select("key", "result", F.round("score", 6).alias("score"))


_MARGIN, _MARGIN_JOINS = _pair("e.home", "e.away", "f.home", "f.away")


@query(f"""WITH {known(TEAMS)}, c AS (SELECT e.event, f.fixture, {_MARGIN} AS score FROM ({EVENTS}) e JOIN ({FIXTURES}) f ON f.day = e.day {_MARGIN_JOINS}),
  b AS (SELECT *, row_number() OVER w AS place, coalesce(lead(score) OVER w, 0) AS next FROM c WINDOW w AS (PARTITION BY event ORDER BY score DESC, fixture))
  SELECT e.event, b.fixture, round(b.score, 6) AS score FROM ({EVENTS}) e LEFT JOIN b ON b.event = e.event AND place = 1 AND b.score >= {fx.MARGIN_LEAST} AND b.score - next >= {fx.MARGIN}""")
def unique_within_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a kickoff: the fixture of the day that beats the runner-up clearly."""
    rows = house_events(spark, sf_dir).select(F.col("event").alias("key"), "day", "home", "away")
    return fx.by_margin(rows, board_fixtures(spark, sf_dir)).select(F.col("key").alias("event"), "fixture", F.round("score", 6).alias("score"))


_OWN, _OWN_JOINS = _pair("home", "away", "own_home", "own_away", "u")
_NEW, _NEW_JOINS = _pair("home", "away", "new_home", "new_away", "v")
_CASES = f"""SELECT c_custkey AS key, {dealt_sql(TEAMS, 'c_custkey')} AS home, {dealt_sql(TEAMS, '(c_custkey // 2)')} AS away, {dealt_sql(TEAMS, '(c_custkey + c_custkey % 3)')} AS own_home, {dealt_sql(TEAMS, '(c_custkey // 2 + c_custkey % 2)')} AS own_away,
  {dealt_sql(TEAMS, '(c_custkey + c_custkey % 5)')} AS new_home, {dealt_sql(TEAMS, '(c_custkey // 2 + c_custkey % 4)')} AS new_away, CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 30 END AS apart FROM customer"""


@query(f"""WITH {known(TEAMS)}, x AS (SELECT c.*, coalesce({_OWN}, 0) AS own, coalesce({_NEW}, 0) AS new FROM ({_CASES}) c {_OWN_JOINS} {_NEW_JOINS})
  SELECT key, round(own, 6) AS own_score, round(new, 6) AS new_score, CASE WHEN home = '' OR away = '' THEN 'quarantine' WHEN own >= {fx.MOVE_LEAST} AND own >= new + {fx.MOVE_MARGIN} THEN 'keep'
  WHEN new >= {fx.MOVE_LEAST} AND new >= own + {fx.MOVE_MARGIN} AND apart <= {fx.MOVE_HOURS} THEN 'move' ELSE 'quarantine' END AS verdict FROM x""")
def reassign_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may belong to another game: what their names say of both."""
    c = F.col("c_custkey")
    half = F.floor(c / 2)
    noon = F.lit("2024-01-01 12:00:00").cast("timestamp")
    rows = table(spark, sf_dir, "customer").select(
        c.alias("key"), dealt(TEAMS, c).alias("home"), dealt(TEAMS, half).alias("away"), noon.alias("kickoff"), dealt(TEAMS, c + c % 3).alias("own_home"), dealt(TEAMS, half + c % 2).alias("own_away"),
        dealt(TEAMS, c + c % 5).alias("new_home"), dealt(TEAMS, half + c % 4).alias("new_away"), F.when(c % 6 > 0, noon + F.make_dt_interval(hours=(c % 30).cast("int"))).alias("new_kickoff"))
    return fx.reassigned(rows).select("key", F.round("own_score", 6).alias("own_score"), F.round("new_score", 6).alias("new_score"), "verdict")


@query(f"""WITH {known(TEAMS)}, x AS (SELECT DISTINCT home, away, {dealt_sql(TEAMS, '(o_orderkey + 1)')} AS team FROM (SELECT o_orderkey, {dealt_sql(TEAMS, 'o_orderkey')} AS home, {dealt_sql(TEAMS, '(o_custkey)')} AS away FROM orders))
  SELECT home, away, team, round(h.hit, 6) AS hit, round(h.strong, 6) AS strong, round(greatest(least(h.ratio, s.ratio), least(s.ratio, h.ratio)), 6) AS score, CASE WHEN h.hit >= 68 AND h.hit >= a.hit THEN 'home' WHEN a.hit >= 68 AND a.hit > h.hit THEN 'away' END AS side, h.fb = h.fa AS same_marks
  FROM x JOIN k h ON h.a = team AND h.b = home JOIN k a ON a.a = team AND a.b = away JOIN k s ON s.a = team AND s.b = away""")
def side_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a team's name says of the two sides of a game."""
    k, (team, home, away) = F.col("o_orderkey"), (F.col(c) for c in ("team", "home", "away"))
    rows = table(spark, sf_dir, "orders").select(dealt(TEAMS, k).alias("home"), dealt(TEAMS, F.col("o_custkey")).alias("away"), dealt(TEAMS, k + 1).alias("team")).distinct()
    return rows.select(
        "home", "away", "team", F.round(names.side_hit(team, home), 6).alias("hit"), F.round(names.side_hit_strong(team, home), 6).alias("strong"), F.round(matching.pair_score(team, team, home, away), 6).alias("score"),
        fx.assigned_side(team, home, away).alias("side"), (names.flags(team) == names.flags(home)).alias("same_marks"))


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games that come in twos of like names at one time, some crossed, some with a fixture."""
    k = F.col("o_orderkey")
    day, half = _at(k, 6), F.floor(k / 2)
    x, y = dealt(TEAMS, half + F.when(k % 7 == 0, 1).otherwise(0)), dealt(TEAMS, half * 5 + 2)
    return table(spark, sf_dir, "orders").select(
        k.alias("game"), day.alias("day"), F.when(k % 10 != 0, _hour(day, k)).alias("kickoff"), F.when(k % 4 == 3, y).otherwise(x).alias("home"), F.when(k % 4 == 3, x).otherwise(y).alias("away"),
        F.when(k % 3 == 0, F.floor(k / 6)).alias("fixture"), (k % 5).cast("int").alias("n"))


_GAMES = f"""SELECT game, day, CASE WHEN game % 10 > 0 THEN day + (12 + (game % 6) // 2) * INTERVAL 1 HOUR END AS kickoff, CASE WHEN game % 4 = 3 THEN y ELSE x END AS home, CASE WHEN game % 4 = 3 THEN x ELSE y END AS away, CASE WHEN game % 3 = 0 THEN game // 6 END AS fixture FROM (
  SELECT o_orderkey AS game, DATE '2000-01-01' + CAST(o_orderkey // 6 AS INTEGER) AS day, {dealt_sql(TEAMS, '(o_orderkey // 2 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END)')} AS x, {dealt_sql(TEAMS, '(o_orderkey // 2 * 5 + 2)')} AS y FROM orders)"""
_APART = "abs(epoch_us(x.kickoff) - epoch_us(y.kickoff)) / 60e6"
_NEAR = f"FROM g x JOIN g y ON x.game < y.game AND y.day BETWEEN x.day - 1 AND x.day + 1 AND x.home <> '' AND x.away <> '' AND y.home <> '' AND y.away <> ''"
_FOUR = "JOIN k hh ON hh.a = x.home AND hh.b = y.home JOIN k aa ON aa.a = x.away AND aa.b = y.away JOIN k ha ON ha.a = x.home AND ha.b = y.away JOIN k ah ON ah.a = x.away AND ah.b = y.home"


@query(f"""WITH {known(TEAMS)}, g AS ({_GAMES}), p AS (SELECT x.game AS a, y.game AS b, least(hh.ratio, aa.ratio) AS straight, least(ah.ratio, ha.ratio) AS crossed, hh.fa = hh.fb AND aa.fa = aa.fb AS m1, ah.fa = ah.fb AND ha.fa = ha.fb AS m2 {_NEAR} {_FOUR}
  WHERE NOT (x.fixture IS NOT NULL AND y.fixture IS NOT NULL) AND coalesce({_APART}, 0) <= {fx.UNIFY_MINUTES}) SELECT a, b, round(greatest(straight, crossed), 6) AS score FROM p WHERE greatest(straight, crossed) >= {fx.UNIFY_LEAST} AND CASE WHEN straight >= crossed THEN m1 ELSE m2 END""")
def same_game_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of games that are one."""
    return fx.same_game_edges(_games(spark, sf_dir)).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH {known(TEAMS)}, g AS ({_GAMES}), p AS (SELECT x.game AS a, y.game AS b, x.day = y.day AS day, {_APART} AS apart, greatest(least(hh.ratio, aa.ratio), least(ha.ratio, ah.ratio)) AS score, x.fixture AS f, y.fixture AS g {_NEAR} {_FOUR})
  SELECT a, b, round(score, 6) AS score FROM p WHERE (f IS NULL AND g IS NULL AND ((day AND ((apart = 0 AND score >= 75) OR score >= 88)) OR (NOT day AND score >= 88 AND apart <= 75))) OR ((f IS NULL) <> (g IS NULL) AND day AND ((apart = 0 AND score >= 75) OR score >= 95)) OR f = g""")
def board_game_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a board shows as one game."""
    return fx.board_edges(_games(spark, sf_dir)).select("a", "b", F.round("score", 6).alias("score"))
