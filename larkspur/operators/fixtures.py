"""Whose game is it: events matched to fixtures in tiers, pins of earlier answers, games grouped and unified.

Names are those of norm_team. Candidates meet by civil day and by minutes before names are compared, so work grows with
the games that begin at about the same time, not with the square of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.names import HELD, flags, leagues_conflict, pair_flags, strip_weak, token_set_ratio, tokens
from larkspur.functions.prob import bind, once
from larkspur.operators.identity import cut, unify
from larkspur.operators.matching import by_names, four, minutes_apart, named_pairs, pair_score, with_pairs

#: Minutes and scores of the tiers, and the most confidence that each gives.
PAIR_MINUTES, PAIR_LEAST, PAIR_SURE, SIDE_LEAST = 45, 72, 88, 70
ONE_MINUTES, ONE_LEAST, ONE_SECOND = 25, 86, 65
SLOT_MINUTES, SLOT_LEAST, SLOT_SECOND = 20, 75, 55
CAPS = {"pair": 95, "one_side": 85, "slot_unique": 70}
PIN_LEAST = 80
UNIFY_LEAST, UNIFY_MINUTES = 90, 75
MARGIN_LEAST, MARGIN = 88, 8
MOVE_LEAST, MOVE_MARGIN, MOVE_HOURS = 80, 5, 12


def _hit(a: Column, b: Column, ratio: Column) -> Column:
    """side_hit from a ratio that is known."""
    held = F.exists(tokens(a), lambda x: F.exists(tokens(b), lambda y: x.contains(y) | y.contains(x)))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(held, F.greatest(ratio, F.lit(HELD))).otherwise(ratio)


def _evidence() -> Column:
    """struct of what the names of home, away and f_home, f_away say; each pair of names is compared once."""
    pairs = {"hh": ("home", "f_home"), "ha": ("home", "f_away"), "ah": ("away", "f_home"), "aa": ("away", "f_away")}

    def hit(x: Column, y: Column) -> Column:
        return bind(token_set_ratio(x, y), lambda r: F.struct(r.alias("ratio"), _hit(x, y, r).alias("hit")))

    def one(a: str, b: str) -> Column:
        x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
        strong = bind(strip_weak(x), lambda s: bind(strip_weak(y), lambda t: hit(s, t)["hit"]))
        return F.struct(hit(x, y).alias("plain"), strong.alias("strong"))

    def told(e: Column) -> Column:
        ratio, plain, strong = (lambda k: e[k]["plain"]["ratio"]), (lambda k: e[k]["plain"]["hit"]), (lambda k: e[k]["strong"])
        # the side that is sure, and what the other side says
        combos = F.array(*[F.struct(strong(k).alias("strong"), plain(o).alias("second")) for k, o in (("hh", "aa"), ("ha", "ah"), ("ah", "ha"), ("aa", "hh"))])
        both = ((strong("hh") >= SIDE_LEAST) & (strong("aa") >= SIDE_LEAST)) | ((strong("ha") >= SIDE_LEAST) & (strong("ah") >= SIDE_LEAST))
        return F.struct(
            F.greatest(F.least(ratio("hh"), ratio("aa")), F.least(ratio("ha"), ratio("ah"))).alias("pair"),
            F.greatest(plain("hh"), plain("ha")).alias("rh"), F.greatest(plain("ah"), plain("aa")).alias("ra"),
            F.array_max(combos).alias("best"), both.alias("both"),
        )

    return bind(F.struct(*[one(a, b).alias(k) for k, (a, b) in pairs.items()]), told)


def matched(events: DataFrame, fixtures: DataFrame) -> DataFrame:
    """events(event, day, kickoff, home, away, league) to (event, fixture, score, method, strong), unmatched ones left out.

    An event whose league is known looks among the day's fixtures of that league first, then among all; leagues that differ and marks of
    women's, second or youth sides that differ never match. Both looks are one pass: a pair of names is compared once, and what the first
    look finds outranks what the second one does.
    """
    f = fixtures.select("day", "fixture", F.col("kickoff").alias("f_kickoff"), F.col("home").alias("f_home"), F.col("away").alias("f_away"), F.col("league").alias("f_league"))
    near = events.select("event", "day", "kickoff", "home", "away", "league").join(f, "day").withColumn("minutes", minutes_apart(F.col("kickoff"), F.col("f_kickoff"))).where(F.col("minutes") <= PAIR_MINUTES + ONE_MINUTES)
    own = F.coalesce(F.col("league") == F.col("f_league"), F.lit(False))
    seen = by_names(near.withColumn("own", own), "e", _evidence()).select("*", "e.pair", "e.rh", "e.ra", "e.both", "e.best.strong", "e.best.second").drop("e")
    rows = seen.withColumn("pool", F.collect_list(F.struct("fixture", "f_kickoff", "own", F.greatest("rh", "ra").alias("hit"))).over(Window.partitionBy("event")))
    within = lambda g, m: F.abs(F.unix_micros(g["f_kickoff"]) - F.unix_micros("f_kickoff")) <= m * 60_000_000
    m, strong = F.col("minutes"), F.col("strong")
    sure = (F.col("pair") >= PAIR_LEAST) & ((strong >= SIDE_LEAST) | (F.col("pair") >= PAIR_SURE))
    bonus = F.when(F.col("own"), 5.0).otherwise(0.0)

    def options(pool: Column, look: int) -> list[Column]:
        rivals = F.exists(pool, lambda g: (g["fixture"] != F.col("fixture")) & within(g, ONE_MINUTES) & (g["hit"] >= ONE_LEAST - 2))
        alone = F.size(F.filter(pool, lambda g: within(g, SLOT_MINUTES))) == 1
        tiers = [
            ("pair", (m <= PAIR_MINUTES) & (sure | F.col("both")), F.greatest(F.col("pair"), (F.col("rh") + F.col("ra")) / 2) + F.greatest(F.lit(0.0), 40 - m)),
            ("one_side", (m <= ONE_MINUTES) & (strong >= ONE_LEAST) & (F.col("second") >= ONE_SECOND) & ~rivals, strong + F.greatest(F.lit(0.0), 25 - m) + bonus),
            ("slot_unique", (m <= SLOT_MINUTES) & (strong >= SLOT_LEAST) & (F.col("second") >= SLOT_SECOND) & alone, 80 + strong * 0.2 + F.greatest(F.lit(0.0), 20 - m)),
        ]
        allowed = F.col("own") if look else F.lit(True)
        return [F.when(allowed & holds, F.struct(F.lit(look).alias("look"), score.alias("score"), F.lit(-k).alias("rank"), F.lit(name).alias("method"))) for k, (name, holds, score) in enumerate(tiers)]

    every = F.array_compact(F.array(*options(F.filter("pool", lambda g: g["own"]), 1), *options(F.col("pool"), 0)))
    guarded = rows.where(~leagues_conflict(F.col("league"), F.col("f_league")) & (pair_flags(F.col("home"), F.col("away")) == pair_flags(F.col("f_home"), F.col("f_away"))))
    scored = guarded.withColumn("o", F.array_max(every)).where("o IS NOT NULL")
    best = scored.groupBy("event").agg(F.max_by(F.struct("fixture", "o.score", "o.method", "strong"), F.struct(F.col("o.look"), F.col("o.score"), F.col("o.rank"), -F.col("minutes"), "fixture")).alias("b"))
    return best.select("event", "b.fixture", "b.score", "b.method", "b.strong")


def resolved(events: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Every event with its fixture's identity, or its own: fixture, method, day, kickoff, home, away, league, confidence."""
    f = fixtures.select("fixture", *[F.col(c).alias(f"f_{c}") for c in ("day", "kickoff", "home", "away", "league")])
    both = events.join(matched(events, fixtures).join(f, "fixture"), "event", "left")
    cap = F.lit(90)
    for name, most in CAPS.items():
        cap = F.when(F.col("method") == name, most).otherwise(cap)
    base = F.when(F.col("method") == "one_side", F.col("strong")).otherwise(F.col("score")).cast("int")
    named = (F.coalesce("home", F.lit("")) != "") & (F.coalesce("away", F.lit("")) != "")
    confidence = F.when(F.col("fixture").isNotNull(), F.least(cap, base)).when(named, 40).otherwise(0)
    own = [F.coalesce(f"f_{c}", c).alias(c) for c in ("day", "kickoff", "home", "away", "league")]
    return both.select("event", "fixture", F.coalesce("method", F.lit("unmatched")).alias("method"), *own, confidence.alias("confidence"))


def pinned(answers: DataFrame, pins: DataFrame) -> DataFrame:
    """answers(house, event, raw_home, raw_away, ...) of resolved() with the pins(house, event, fixture, day, home, away, confidence) of earlier runs.

    A pin holds while the names are still alike. One with a fixture wins; one without keeps day and names, unless a fixture is
    found now, which takes its place.
    """
    p = pins.select("house", "event", *[F.col(c).alias(f"p_{c}") for c in ("fixture", "day", "home", "away", "confidence")], F.lit(True).alias("p"))
    both = answers.join(p, ["house", "event"], "left")
    alike = F.when(F.col("p"), pair_score(F.col("raw_home"), F.col("raw_away"), F.col("p_home"), F.col("p_away")) >= PIN_LEAST)
    both = once(both, "holds", F.coalesce(alike, F.lit(False)))
    fixed = F.col("holds") & F.col("p_fixture").isNotNull()
    legacy = F.col("holds") & F.col("p_fixture").isNull() & F.col("fixture").isNull()
    pick = lambda c: F.when(fixed | legacy, F.col(f"p_{c}")).otherwise(F.col(c)).alias(c)
    method = F.when(fixed, "house_map").when(legacy, "house_map_legacy").otherwise(F.col("method")).alias("method")
    return both.select("house", "event", "raw_home", "raw_away", pick("fixture"), method, *map(pick, ("day", "home", "away", "confidence")))


def next_pins(answers: DataFrame, pins: DataFrame) -> DataFrame:
    """pins after a run: the answers' own, and those of events that did not come."""
    mine = answers.where("day IS NOT NULL").select("house", "event", "fixture", "day", "home", "away", "confidence")
    return mine.unionByName(pins.select(*mine.columns).join(mine.select("house", "event"), ["house", "event"], "left_anti"))


def _near(games: DataFrame) -> DataFrame:
    """Pairs of games(game, day, kickoff, home, away, fixture, n) on the same or the next day, x before y, names not empty."""
    named = games.where("home != '' AND away != ''")
    x = named.select(F.struct(*games.columns).alias("x"), F.explode(F.array("day", F.date_add("day", 1), F.date_sub("day", 1))).alias("day"))
    y = named.select(F.struct(*games.columns).alias("y"), "day")
    return x.join(y, "day").where("x.game < y.game").drop("day")


def _named(pairs: DataFrame, *more: Column) -> DataFrame:
    """Pairs of _near as (a, b, home, away, f_home, f_away) and more, for by_names: the names of a game come again with each house and season."""
    names = [F.col(f"{g}.{c}").alias(f"{n}{c}") for g, n in (("x", ""), ("y", "f_")) for c in ("home", "away")]
    return pairs.select(F.col("x.game").alias("a"), F.col("y.game").alias("b"), *names, *more)


def same_game_edges(games: DataFrame) -> DataFrame:
    """(a, b, score): pairs of one game by names, marks of each side, days one apart at most and kickoffs, never of two fixtures."""
    apart = F.abs(F.unix_micros("x.kickoff") - F.unix_micros("y.kickoff")) / 60e6
    pairs = _near(games).where(~(F.col("x.fixture").isNotNull() & F.col("y.fixture").isNotNull()) & (F.coalesce(apart, F.lit(0.0)) <= UNIFY_MINUTES))
    same = lambda a, b: (flags(F.col(a)) == flags(F.col("f_home"))) & (flags(F.col(b)) == flags(F.col("f_away")))
    sides = four(token_set_ratio, *[F.col(c) for c in ("home", "away", "f_home", "f_away")], lambda hh, aa, ha, ah: F.struct(F.least(hh, aa).alias("straight"), F.least(ah, ha).alias("crossed")))
    marks = lambda s: F.when(s["straight"] >= s["crossed"], same("home", "away")).otherwise(same("away", "home"))
    scored = by_names(_named(pairs), "s", bind(sides, lambda s: F.when(marks(s), F.greatest(s["straight"], s["crossed"]))))
    return scored.where(F.col("s") >= UNIFY_LEAST).select("a", "b", F.col("s").alias("score"))


def board_edges(rows: DataFrame) -> DataFrame:
    """(a, b, score) of rows that a board shows as one game: one fixture; or names at 75 at one time, 88 within a day or 75 minutes of it."""
    apart = F.abs(F.unix_micros("x.kickoff") - F.unix_micros("y.kickoff")) / 60e6
    day, score = F.col("x.day") == F.col("y.day"), F.col("score")
    free = F.col("x.fixture").isNull() & F.col("y.fixture").isNull()
    one_free = F.col("x.fixture").isNull() != F.col("y.fixture").isNull()
    # the least score that will do, if any does
    alike = F.when(day & (apart == 0), 75.0).when(day | (apart <= 75), 88.0)
    stuck = F.when(day, F.when(apart == 0, 75.0).otherwise(95.0))
    one = F.coalesce(F.col("x.fixture") == F.col("y.fixture"), F.lit(False))
    # names are compared only where they can decide
    open_pairs = _near(rows).where(one | (F.col("x.fixture").isNull() | F.col("y.fixture").isNull()) & (day | (free & F.coalesce(apart <= 75, F.lit(False)))))
    least = F.when(one, F.lit(0.0)).when(free, alike).when(one_free, stuck)
    scored = by_names(_named(open_pairs, least.alias("least")), "score", pair_score(*[F.col(c) for c in ("home", "away", "f_home", "f_away")]))
    return scored.where(score >= F.col("least")).select("a", "b", "score")


def groups(games: DataFrame, edges: DataFrame) -> DataFrame:
    """(game, canonical): games joined by edges(a, b, score), never two fixtures in one group.

    Games without fixture take the fixture of the best neighbour that has one, round by round; then edges join games of one fixture, or
    of none. The canonical game has a fixture if one has, then the most records, then the least id.
    """
    own = games.select("game", F.col("fixture").cast("string").alias("label"))
    edges = cut(edges.select("a", "b", "score"))  # they are read in every round
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    labels = cut(own)
    while True:
        offers = both.join(labels.where("label IS NOT NULL").withColumnRenamed("game", "b"), "b").groupBy("a").agg(F.max_by("label", F.struct("score", "label")).alias("offer"))
        step = cut(labels.join(offers, labels.game == offers.a, "left").select("game", F.coalesce("label", "offer").alias("label"), (F.col("label").isNull() & F.col("offer").isNotNull()).alias("new")))
        labels = step.select("game", "label")
        if step.where("new").isEmpty():
            break
    side = lambda n: labels.select(F.col("game").alias(n), F.col("label").alias(f"{n}_label"))
    kept = edges.join(side("a"), "a").join(side("b"), "b").where("a_label <=> b_label").select("a", "b")
    parts = games.join(unify(kept).withColumnRenamed("node", "game"), "game", "left").withColumn("component", F.coalesce("component", "game"))
    rank = F.struct(F.col("fixture").isNull(), -F.coalesce("n", F.lit(0)), "game")
    return parts.select("game", F.min_by("game", rank).over(Window.partitionBy("component")).alias("canonical"))


def unified(games: DataFrame) -> DataFrame:
    return groups(games, same_game_edges(games))


def rekeyed(records: DataFrame, alias: DataFrame) -> DataFrame:
    """records(game, ...) under their canonical games; what then shares a key is merged by history.merge_records."""
    return records.join(alias.withColumnRenamed("canonical", "_to"), "game", "left").withColumn("game", F.coalesce("_to", "game")).drop("_to")


def fixed_point(games: DataFrame, most: int = 3) -> DataFrame:
    """(game, canonical) after unifying until nothing moves, most times at most: a merged game has the names of its canonical one."""
    alias, now = games.select("game", F.col("game").alias("canonical")), games
    for _ in range(most):
        step = cut(unified(now))
        if step.where("game != canonical").isEmpty():
            break
        alias = cut(rekeyed(alias.withColumnsRenamed({"game": "origin", "canonical": "game"}), step).select(F.col("origin").alias("game"), F.col("game").alias("canonical")))
        sums = rekeyed(now.select("game", "n"), step).groupBy("game").agg(F.sum("n").alias("n"))
        now = cut(now.drop("n").join(sums, "game").select(*games.columns))
    return alias


def by_margin(rows: DataFrame, fixtures: DataFrame) -> DataFrame:
    """rows(key, day, home, away) with the fixture of the day that beats the runner-up clearly, whatever its kickoff; else null."""
    f = fixtures.select("day", "fixture", F.col("home").alias("f_home"), F.col("away").alias("f_away"))
    # a runner-up so far below the least score leaves margin enough, so it need not be there
    pairs = named_pairs(rows, f, "score", pair_score(F.col("home"), F.col("away"), F.col("f_home"), F.col("f_away")), MARGIN_LEAST - MARGIN)
    scored = with_pairs(rows, pairs, f)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "fixture")
    top = scored.withColumns({"_k": F.row_number().over(order), "_next": F.coalesce(F.lead("score").over(order), F.lit(0.0))}).where("_k = 1")
    best = top.where((F.col("score") >= MARGIN_LEAST) & (F.col("score") - F.col("_next") >= MARGIN)).select("key", "fixture", "score")
    return rows.join(best, "key", "left")


def reassigned_scores(rows: DataFrame, name: str = "s") -> DataFrame:
    """rows(home, away, own_home, own_away, new_home, new_away) with how like its names are the owner's and the other game's: name(own, new)."""
    scores = F.struct(
        F.coalesce(pair_score(F.col("home"), F.col("away"), F.col("own_home"), F.col("own_away")), F.lit(0.0)).alias("own"),
        F.coalesce(pair_score(F.col("home"), F.col("away"), F.col("new_home"), F.col("new_away")), F.lit(0.0)).alias("new"),
    )
    return by_names(rows, name, scores, ("home", "away", "own_home", "own_away", "new_home", "new_away"))


def reassignment(home: Column, away: Column, kickoff: Column, new_kickoff: Column, own: Column, new: Column) -> Column:
    """keep, move or quarantine."""
    in_time = new_kickoff.isNotNull() & F.coalesce(F.abs(F.unix_micros(kickoff) - F.unix_micros(new_kickoff)) <= MOVE_HOURS * 3_600_000_000, F.lit(True))
    unnamed = (F.coalesce(home, F.lit("")) == "") | (F.coalesce(away, F.lit("")) == "")
    return (
        F.when(unnamed, "quarantine")
        .when((own >= MOVE_LEAST) & (own >= new + MOVE_MARGIN), "keep")
        .when((new >= MOVE_LEAST) & (new >= own + MOVE_MARGIN) & in_time, "move")
        .otherwise("quarantine")
    )


def reassigned(rows: DataFrame) -> DataFrame:
    """rows(key, home, away, kickoff, own_home, own_away, new_home, new_away, new_kickoff) with verdict keep, move or quarantine."""
    own, new = F.col("s.own"), F.col("s.new")
    verdict = reassignment(*[F.col(c) for c in ("home", "away", "kickoff", "new_kickoff")], own, new)
    return reassigned_scores(rows).select(*rows.columns, verdict.alias("verdict"), own.alias("own_score"), new.alias("new_score"))


def assigned_side(team: Column, home: Column, away: Column) -> Column:
    """home or away, whichever name the team's is more like at 68 or more; home at ties."""
    from larkspur.functions.names import side_hit

    return bind(F.struct(side_hit(team, home).alias("h"), side_hit(team, away).alias("a")), lambda s: F.when((s["h"] >= 68) & (s["h"] >= s["a"]), "home").when((s["a"] >= 68) & (s["a"] > s["h"]), "away"))
