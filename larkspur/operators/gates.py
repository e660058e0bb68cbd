"""Data-quality gates: each gives rows of (gate, subject, reason); no rows means that it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.metrics import collapsed


def _reasons(rows: DataFrame, gate: str, subject, reason) -> DataFrame:
    return rows.select(F.lit(gate).alias("gate"), subject.cast("string").alias("subject"), reason.alias("reason"))


def promotion_block(now: DataFrame, before: DataFrame) -> DataFrame:
    """Markets of 8 events or more of which less than 35 % are left."""
    bad = collapsed(now, before, ["market"], 8, 0.35)
    return _reasons(bad, "market_collapse", F.col("market"), F.concat_ws(" -> ", F.col("before").cast("string"), F.col("now").cast("string")))


def baseline(now: DataFrame, before: DataFrame, keys: list[str], least: int = 1, share: float = 0.5) -> DataFrame:
    bad = collapsed(now, before, keys, least, share)
    return _reasons(bad, "baseline_" + "_".join(keys), F.concat_ws("|", *keys), F.concat_ws(" -> ", F.col("before").cast("string"), F.col("now").cast("string")))


def status(rows: DataFrame) -> DataFrame:
    """Houses that failed, or that say they succeeded with no events."""
    bad = rows.where(~F.coalesce("ok", F.lit(False)) | (F.coalesce("n_events", F.lit(0)) == 0))
    return _reasons(bad, "status", F.col("house"), F.when(F.coalesce("ok", F.lit(False)), "empty").otherwise(F.coalesce("error_class", F.lit("failed"))))


def fixture_coverage(games: DataFrame, least: float = 0.6) -> DataFrame:
    """One row if fewer games than the share have a fixture."""
    part = games.agg((F.count("fixture") / F.count("*")).alias("share"), F.count("*").alias("n"))
    return _reasons(part.where((F.col("n") > 0) & (F.col("share") < least)), "fixture_coverage", F.lit("board"), F.round("share", 4).cast("string"))


def flag_audit(flags: DataFrame, lines: DataFrame) -> DataFrame:
    """Flags on lines with a negative margin, of three-way markets, or of games that have begun."""
    joined = flags.join(lines, ["game", "market", "house"]).where(F.abs(F.col("flag_line") - F.col("line")) <= 1e-9)
    reason = F.when(1 / F.col("over") + 1 / F.col("under") - 1 < 0, "negative_margin").when(F.col("three_way"), "three_way").when(F.col("begun"), "past_game")
    return _reasons(joined.withColumn("why", reason).where("why IS NOT NULL"), "flag_audit", F.concat_ws("|", "game", "market", "house"), F.col("why"))


def purity(pairs: DataFrame) -> DataFrame:
    """Fixtures whose raw names fall in more than one cluster: pairs(fixture, component)."""
    bad = pairs.groupBy("fixture").agg(F.countDistinct("component").alias("n")).where("n > 1")
    return _reasons(bad, "identity_purity", F.col("fixture"), F.col("n").cast("string"))


def manifest(artifacts: DataFrame, now: str, most_age_minutes: int = 360, most_spread_minutes: int = 45, shrink: float = 0.02) -> DataFrame:
    """artifacts(name, ts, valid_count, before): too old, too far apart, or shrunk."""
    minutes = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 60e6
    spread = artifacts.agg(minutes(F.max("ts"), F.min("ts")).alias("spread"))
    old = artifacts.where(minutes(F.lit(now).cast("timestamp"), F.col("ts")) > most_age_minutes)
    small = artifacts.where(F.col("valid_count") < F.col("before") * (1 - shrink))
    return (
        _reasons(old, "manifest_age", F.col("name"), F.col("ts").cast("string"))
        .union(_reasons(spread.where(F.col("spread") > most_spread_minutes), "manifest_spread", F.lit("all"), F.col("spread").cast("string")))
        .union(_reasons(small, "manifest_shrink", F.col("name"), F.concat_ws(" -> ", F.col("before").cast("string"), F.col("valid_count").cast("string"))))
    )


#: The least base and the share that must be left, by what is counted; houses that may die alone.
BASE = {"house": 8, "market": 8, "pair": 5}
LEFT, TOLERATED_HOUSES = 0.35, 1
#: Hours of a pointer, percents of games with a fixture on the board and among games of value, and from how many games on.
POINTER_HOURS, BOARD_PERCENT, VALUE_PERCENT, BOARD_LEAST, VALUE_LEAST = 12.0, 15.0, 70.0, 10, 3


def coverage_collapse(now: DataFrame, before: DataFrame) -> DataFrame:
    """Lines(game, house, market, instrument) of two boards: houses and markets that lost most of their games, pairs most of their instruments.

    A house that collapsed alone is tolerated: neither it nor its pairs say anything. With more of them each one does.
    """
    games = lambda d, keys: d.groupBy(*keys).agg(F.countDistinct("game").alias("n"))
    change = F.concat_ws(" -> ", F.col("before").cast("string"), F.col("now").cast("string"))
    dead = collapsed(games(now, ["house"]), games(before, ["house"]), ["house"], BASE["house"], LEFT)
    alone = F.broadcast(dead.agg((F.count("*") <= TOLERATED_HOUSES).alias("alone")))  # one row
    judged = dead.join(alone, F.lit(True))
    markets = collapsed(games(now, ["market"]), games(before, ["market"]), ["market"], BASE["market"], LEFT)
    parts = lambda d: d.groupBy("house", "market").agg(F.countDistinct("game", "instrument").alias("n"))
    pairs = collapsed(parts(now), parts(before), ["house", "market"], BASE["pair"], LEFT).join(judged.where("alone").select("house"), "house", "left_anti")
    return (
        _reasons(judged.where("NOT alone"), "house_collapse", F.col("house"), change)
        .union(_reasons(markets, "market_collapse", F.col("market"), change))
        .union(_reasons(pairs, "pair_collapse", F.concat_ws("|", "house", "market"), change))
    )


def fixture_health(games: DataFrame, pointer: DataFrame) -> DataFrame:
    """games(game, fixture, valued) and the one row of pointer(valid, age_hours): is the fixture source sound, fresh and wide enough.

    A pointer without a row is one whose status is absent.
    """
    percent = lambda c: 100.0 * F.count_if(c & F.col("fixture").isNotNull()) / F.count_if(c)
    board = games.agg(F.count("*").alias("n"), percent(F.lit(True)).alias("pct"), F.count_if("valued").alias("n_value"), percent(F.col("valued")).alias("pct_value"))
    share = lambda c: F.format_string("%.1f%%", c)
    low = board.where((F.col("n") >= BOARD_LEAST) & (F.col("pct") < BOARD_PERCENT))
    low_value = board.where((F.col("n_value") >= VALUE_LEAST) & (F.col("pct_value") < VALUE_PERCENT))
    state = pointer.agg(F.count("*").alias("n"), F.bool_and("valid").alias("valid"), F.max("age_hours").alias("age"))
    source = F.lit("fixtures")
    old = F.when(F.col("age").isNull(), "no time").when(F.col("age") > POINTER_HOURS, F.format_string("%.1f hours old", "age"))
    return (
        _reasons(state.where("n = 0"), "fixture_source", source, F.lit("absent"))
        .union(_reasons(state.where("n > 0 AND NOT coalesce(valid, false)"), "fixture_source", source, F.lit("invalid")))
        .union(_reasons(state.withColumn("why", old).where("n > 0 AND why IS NOT NULL"), "fixture_source", source, F.col("why")))
        .union(_reasons(low, "fixture_board", F.lit("board"), share("pct")))
        .union(_reasons(low_value, "fixture_value", F.lit("board"), share("pct_value")))
    )


#: Minutes of a board that warn and that are bad, percent of fixtures and share of one market that warn, failed houses that are bad.
WARN_MINUTES, BAD_MINUTES, WARN_PERCENT, ONE_MARKET, FAILED_BAD = 90, 120, 40.0, 0.7, 3


def warnings(houses: DataFrame, board: DataFrame, markets: DataFrame, history: DataFrame) -> DataFrame:
    """(level, kind, subject) of what an operator should know: failed houses, an old or thin board, one market above all, no history yet.

    houses(house, ok); one row of board(age_minutes, games, fixture_percent), markets(market, games), one row of history(settled, valid).
    """
    failed = houses.where("NOT coalesce(ok, false)").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("house")), ", ").alias("who")).where("n > 0")
    row = lambda d, level, kind, subject: d.select(level.alias("level"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"))
    old = board.where(F.col("age_minutes") > WARN_MINUTES)
    thin = board.where((F.coalesce("fixture_percent", F.lit(100.0)) < WARN_PERCENT) & (F.col("games") >= 10))
    top = markets.agg(F.max_by("market", F.struct("games", "market")).alias("market"), F.max("games").alias("most"), F.count("*").alias("n")).join(F.broadcast(board.select(F.col("games").alias("all"))), F.lit(True))
    return (
        row(failed, F.when(F.col("n") < FAILED_BAD, "warn").otherwise("bad"), "failed_houses", F.col("who"))
        .union(row(old, F.when(F.col("age_minutes") > BAD_MINUTES, "bad").otherwise("warn"), "old_board", F.col("age_minutes")))
        .union(row(thin, F.lit("warn"), "few_fixtures", F.col("fixture_percent")))
        .union(row(top.where((F.col("n") >= 2) & (F.col("most") >= F.greatest("all", F.lit(1)) * ONE_MARKET)), F.lit("info"), "one_market", F.col("market")))
        .union(row(history.where("settled > 0 AND valid = 0"), F.lit("info"), "no_history", F.col("settled")))
    )
