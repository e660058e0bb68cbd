"""Keys, market names, error classes and the states that a board shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.names import plain
from larkspur.functions.prob import bind

#: Model codes of a league as (pattern that must be there, pattern that must not, (cards, fouls, shots, corners)), first match wins.
LEAGUE_MODELS = (
    ("(?=.*(brasileir|brazil serie))(?=.*(serie b|- b))", None, ("B", "BR-B", None, "BR-B")),
    ("brasileir|brazil serie", "serie b", ("A", "BR-A", "BR", "BR-A")),
    ("premier league|(?=.*premier)(?=.*ingl)", None, ("PL", "PL", "PL", "PL")),
    ("laliga|la liga|(?=.*primera)(?=.*espan)", None, ("LL", "LL", "LL", "LL")),
    ("(?=.*serie a)(?=.*ital)", None, ("SA", "SA", "SA", "SA")),
    ("bundesliga", "2", ("BU", "BU", "BU", "BU")),
    ("ligue 1", None, ("L1", "L1", "L1", "L1")),
    ("chin|csl", None, (None, None, None, "CSL")),
    ("bolivi", None, (None, None, None, "BOL")),
    ("equador|ecuad|ligapro", None, (None, None, None, "ECU")),
    ("norueg|eliteserien", None, (None, None, None, "NOR")),
)
#: Market names without accents, as they end, and the market.
MARKET_NAMES = {
    "cartoes": "Cartões", "faltas": "Faltas", "chutes": "Finalizações", "finalizacoes": "Finalizações", "chutes no gol": "Chutes no gol",
    "escanteios": "Escanteios", "impedimentos": "Impedimentos", "laterais": "Laterais", "tiros de meta": "Tiros de meta", "desarmes": "Desarmes",
}
#: Classes of failures as (class, pattern), in the order in which they are tried.
ERRORS = (("Timeout", "timeout"), ("HTTP429", "429|rate"), ("Geo", "403|401|geo|blocked|forbidden"), ("Auth", "auth|token|jwt"), ("Parse", "parse|json|empty"))


def league_models(league: Column) -> Column:
    """struct(cards, fouls, shots, corners) of model codes; null for an unknown league."""
    text = plain(league)
    out = None
    for must, never, codes in LEAGUE_MODELS:
        holds = text.rlike(must) & ~text.rlike(never) if never else text.rlike(must)
        value = F.struct(*[F.lit(c).cast("string").alias(n) for c, n in zip(codes, ("cards", "fouls", "shots", "corners"), strict=True)])
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out


def market_name(raw: Column) -> Column:
    """The market whose name the text is, or ends in after a space; what stands before ``total de`` goes."""
    text = F.regexp_replace(plain(F.trim(raw)), r"^.*?total de\s+", "")
    out = None
    for name, market in MARKET_NAMES.items():
        holds = (text == name) | text.endswith(f" {name}")
        out = F.when(holds, market) if out is None else out.when(holds, market)
    return out


def team_market(raw: Column) -> Column:
    """struct(market, team) of ``<team> Total de <market>``; null if it is not of that form."""
    stats = "|".join(sorted(("cartoes", "cartões", "faltas", "chutes", "escanteios", "impedimentos", "laterais", "tiros de meta", "chutes no gol"), key=len, reverse=True))
    pattern = rf"(?i)^(.+?)\s+total de\s+({stats})$"
    text = F.trim(raw)
    value = F.struct(market_name(F.regexp_extract(text, pattern, 2)).alias("market"), F.trim(F.regexp_extract(text, pattern, 1)).alias("team"))
    return F.when(text.rlike(pattern), value)


def three_way(name: Column) -> Column:
    """Whether a market has a third outcome."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[ _-]", "").rlike("3vias|3way|tresvias|trêsvias|3caminhos")


def error_class(message: Column) -> Column:
    """Null for no error; Other where no pattern fits."""
    out = F.when(message.isNull(), F.lit(None).cast("string"))
    for name, pattern in ERRORS:
        out = out.when(F.lower(message).rlike(pattern), name)
    return out.otherwise("Other")


def history_key(house: Column, day: Column, home: Column, away: Column, market: Column, line: Column, side: Column, fixture: Column) -> Column:
    """``house|sofa:fixture|market|line|side``, or with day and names where there is no fixture."""
    way = F.when(F.lower(side).isin("over", "mais"), "over").otherwise("under")
    known = F.coalesce(fixture, F.lit("")) != ""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.when(known, F.concat_ws("|", text(house), F.concat(F.lit("sofa:"), fixture), text(market), text(line), way)).otherwise(
        F.concat_ws("|", *map(text, (house, day, home, away, market, line)), way)
    )


def parsed_key(key: Column) -> Column:
    """struct(house, fixture, day, home, away, market, line, side, format) of a history key."""
    fields = ("house", "fixture", "day", "home", "away", "market", "line", "side")
    none = F.lit(None).cast("string")

    def at(p: Column, form: str, **places: int) -> Column:
        return F.struct(*[(F.get(p, places[f]) if f in places else none).alias(f) for f in fields], F.lit(form).alias("format"))

    def of(p: Column) -> Column:
        sofa = F.coalesce(F.get(p, 1).startswith("sofa:"), F.lit(False))
        fixed = at(p, "sofa", house=0, fixture=1, market=2, line=3, side=4).withField("fixture", F.regexp_replace(F.get(p, 1), "^sofa:", ""))
        return (
            F.when((F.size(p) >= 5) & sofa, fixed)
            .when(F.size(p) >= 7, at(p, "legacy", house=0, day=1, home=2, away=3, market=4, line=5, side=6))
            .otherwise(at(p, "unknown", house=0))
        )

    return bind(F.split(key, r"\|"), of)


def line_key(value: Column) -> Column:
    """A line as text: whole numbers without a point; what is no number stays as it is."""
    number = value.try_cast("double")
    return F.when(number.isNull(), value).when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))


def team_key(key: Column) -> Column:
    """struct(league, id) of ``league|id``, cut at the last bar."""
    return F.struct(F.regexp_extract(key, r"^(.*)\|([^|]*)$", 1).alias("league"), F.regexp_extract(key, r"^(.*)\|([^|]*)$", 2).alias("id"))


def without_unit(name: Column) -> Column:
    """A name without ``(Corners)``, ``(Bookings)`` or ``(Cards)`` at its end."""
    return F.trim(F.regexp_replace(name, r"(?i)\s*\((corners|bookings|cards)\)\s*$", ""))


def without_echo(name: Column) -> Column:
    """A name of three parts or more between `` - `` whose last two are the same, without the last."""
    parts = F.split(name, " - ")
    return F.when((F.size(parts) >= 3) & (F.element_at(parts, -1) == F.try_element_at(parts, F.lit(-2))), F.array_join(F.slice(parts, 1, F.size(parts) - 1), " - ")).otherwise(name)


def game_state(text: Column, now: Column) -> Column:
    """upcoming, started (up to three hours), finished or unknown, from ``dd/mm HH:MM`` in civil time as now is.

    The year rolls on only where the game would lie more than 180 days back.
    """
    part = lambda i: F.regexp_extract(F.trim(text), r"^(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{2})", i).try_cast("int")
    at = lambda year: F.try_make_timestamp_ntz(year, part(2), part(1), part(3), part(4), F.lit(0))
    seconds = lambda t: F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(t.cast("timestamp"))
    this, following = at(F.year(now)), at(F.year(now) + 1)
    kick = F.when(seconds(this) > 180 * 86400, F.coalesce(following, this)).otherwise(this)
    return bind(seconds(kick) / 3600.0, lambda h: F.when(h.isNull(), "unknown").when(h < 0, "upcoming").when(h <= 3, "started").otherwise("finished"))


def age_minutes(ts: Column, now: Column) -> Column:
    """Whole minutes since ts, 0 at least."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 60e6)).cast("long")


def epoch_minute(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 60e6).cast("long")


def days_apart(a: Column, b: Column) -> Column:
    """Whole days between two days as text; 99 if one does not read."""
    return F.coalesce(F.abs(F.datediff(a.try_cast("date"), b.try_cast("date"))), F.lit(99))


def drift_percent(open_odd: Column, last_odd: Column) -> Column:
    return F.when(open_odd > 0, (last_odd / open_odd - 1) * 100)


def drift_band(change: Column) -> Column:
    """up, down or flat, at 0.05 either way."""
    return F.when(change >= 0.05, "up").when(change <= -0.05, "down").otherwise("flat")


def confidence(houses: Column, fixture: Column, board_age: Column, to_kickoff: Column, actionable: Column) -> Column:
    """0 to 100 by houses, a known fixture, the board's age and the minutes to kickoff; 49 at most if it cannot be acted on, 69 without fixture."""
    known = F.coalesce(fixture, F.lit(False))
    base = (
        F.when(houses >= 4, 35).when(houses == 3, 28).when(houses == 2, 18).otherwise(6)
        + F.when(known, 30).otherwise(5)
        + F.when(board_age <= 90, 20).when(board_age <= 180, 12).when(board_age <= 300, 5).otherwise(0)
    )
    idle = to_kickoff.isNull() | (to_kickoff <= 0) | board_age.isNull() | (board_age > 120) | ~F.coalesce(actionable, F.lit(True))
    near = F.when(to_kickoff.between(15, 1440), 15).when(to_kickoff < 15, 6).when(to_kickoff <= 2880, 10).otherwise(0)
    full = F.least(F.lit(100), base + near)
    return F.when(idle, F.least(base, F.lit(49))).when(known, full).otherwise(F.least(full, F.lit(69)))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 70, "alta").when(score >= 50, "média").otherwise("baixa")


def freshness(board_age: Column) -> Column:
    """struct(band, stale) by the board's age in minutes."""
    band = F.when(board_age.isNull(), "unk").when(board_age <= 10, "fresh").when(board_age <= 60, "mid").otherwise("old")
    return F.struct(band.alias("band"), F.coalesce(board_age > 120, F.lit(True)).alias("stale"))
