"""Market names as houses write them, to markets of a match and of a team: a table of rules for each way of writing.

``colon`` houses describe a market in words and put a team before a colon; ``exact`` houses have fixed names, with a team at the end or
before a dash; ``plural`` houses have fixed names, plural forms among them, with a team on either side; ``coded`` houses number
markets and sides; ``selected`` houses list selections with handicaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.names import plain

#: Fixed values: (market, one of each of these groups must be in the name, none of these), the first that fits; the plural ``laterais`` is added.
COLON_MATCH = (
    ("Cartões", (("cart",), ("total",)), ()),
    ("Faltas", (("falta",), ("total", "partida")), ()),
    ("Finalizações", (("chute", "finaliza", "remate"), ("total",)), ("gol",)),
    ("Chutes no gol", (("chute",), ("gol",), ("total",)), ()),
    ("Impedimentos", (("impedi",), ("total",)), ()),
    ("Laterais", (("lateral", "laterais", "arremesso"), ("total",)), ()),
    ("Tiros de meta", (("tiro de meta",), ("total",)), ()),
    ("Escanteios", (("escanteio", "canto"), ("total", "mais")), ()),
)
#: What is no total of a match, and what is none of a team.
COLON_REFUSED = ("tempo", "jogador", "primeiro", "antes", ":", " equipe com ")
COLON_TEAM_REFUSED = ("tempo", "jogador", "1º", "2º", "primeiro")
#: Fixed values: (market, pattern of what stands after a team's colon), the first that fits.
COLON_TEAM = (
    ("Chutes no gol", r"chutes? *(no|a) *gol"), ("Finalizações", r"finaliza"), ("Finalizações", r"\bchutes?\b"), ("Faltas", r"\bfaltas?\b"), ("Cartões", r"\bcart(oes|ões)\b"),
    ("Escanteios", r"escanteio|canto"), ("Impedimentos", r"impedi"), ("Laterais", r"latera(l|is)|arremesso"), ("Tiros de meta", r"tiro de meta"), ("Desarmes", r"desarme"),
)

#: Statistics by their names without accents, for the houses with fixed names.
STATISTICS = {
    "cartoes": "Cartões", "faltas": "Faltas", "escanteios": "Escanteios", "finalizacoes": "Finalizações", "chutes": "Finalizações", "chutes no gol": "Chutes no gol",
    "impedimentos": "Impedimentos", "arremessos laterais": "Laterais", "laterais": "Laterais", "tiros de meta": "Tiros de meta", "desarmes": "Desarmes",
}
#: Names that stand without ``total de`` after a team's dash alone; what is no team; the plural house's own names.
DASH_ONLY = {"chutes a gol": "Chutes no gol", "cantos": "Escanteios"}
EXACT_REFUSED = r"vermelh|[12] ?[ºo°] ?tempo|minuto|asiatic|impar|jogador|goleiro"
PLURAL_MATCH = {
    "total cartoes": "Cartões", "total de cartoes": "Cartões", "total de faltas": "Faltas", "total faltas": "Faltas", "total de finalizacoes": "Finalizações", "total de chutes": "Finalizações",
    "total chutes": "Finalizações", "totais chutes": "Finalizações", "total de remates": "Finalizações", "total de chutes no gol": "Chutes no gol", "total de chutes a gol": "Chutes no gol",
    "totais chutes a gol": "Chutes no gol", "totais chutes no gol": "Chutes no gol", "total de impedimentos": "Impedimentos", "total de laterais": "Laterais", "total de arremessos laterais": "Laterais",
    "total de tiros de meta": "Tiros de meta", "total de escanteios": "Escanteios", "total escanteios": "Escanteios", "total de desarmes": "Desarmes", "total desarmes": "Desarmes",
}
PLURAL_STATISTICS = STATISTICS | {"remates": "Finalizações", "chutes a gol": "Chutes no gol"}
PLURAL_REFUSED = (
    "jogador", "tecnico", "substituto", "cometidas", "1º tempo", "2º tempo", "1° tempo", "1ª tempo", "2ª tempo", "handicap", "impar", "/par", "exatos", "exato", "vermelho", "primeira", "primeiro",
    "ultima", "ultimo", "ambas", "corrida", "escala", "1x2", "chance", "inclui",
)


def _has(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= text.contains(w)
    return out


def _looked_up(text: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[text]


def _team(market: Column, team: Column) -> Column:
    """struct(market, team) where both are known."""
    return F.when(market.isNotNull() & (team != ""), F.struct(market.alias("market"), team.alias("team")))


def colon_match(name: Column) -> Column:
    text = F.lower(F.coalesce(name, F.lit("")))
    out = F.when(_has(text, COLON_REFUSED) | text.startswith("equipe "), None)
    for market, groups, none in COLON_MATCH:
        fits = ~_has(text, none)
        for words in groups:
            fits &= _has(text, words)
        out = out.when(fits, market)
    return out


def colon_team(name: Column) -> Column:
    shape = r"^\s*([^:]{2,50}?)\s*:\s*(.+?)\s*$"
    rest = F.regexp_extract(name, shape, 2)
    text = F.lower(rest)
    market = F.when(_has(text, COLON_TEAM_REFUSED) | (rest == ""), None)
    for one, pattern in COLON_TEAM:
        market = market.when(text.rlike(pattern), one)
    return _team(market, F.trim(F.regexp_extract(name, shape, 1)))


def exact_match(name: Column) -> Column:
    text = plain(F.trim(name))
    return F.when(~text.rlike("[;&]") & text.startswith("total de "), _looked_up(F.regexp_replace(text, "^total de ", ""), STATISTICS))


def exact_team(name: Column) -> Column:
    """``Total de STATISTIC Team`` or ``Team - STATISTIC``, with or without ``total de``."""
    whole = F.trim(name)
    stats = "|".join(sorted(STATISTICS, key=lambda s: (-len(s), s)))
    low, shape, dash = plain(whole), rf"^total de ({stats}) (.+)$", r"^([^,;]{2,40}?)\s+[-–—]\s+(.+)$"
    # folding keeps the length of a text, so the team is its end as it is written
    behind = F.substring(whole, F.length(whole) - F.length(F.regexp_extract(low, shape, 2)) + 1, F.length(whole))
    team, rest = F.trim(F.regexp_extract(whole, dash, 1)), plain(F.trim(F.regexp_extract(whole, dash, 2)))
    told = F.coalesce(_looked_up(F.regexp_replace(rest, "^total de ", ""), STATISTICS), _looked_up(rest, DASH_ONLY))
    refused = low.rlike("[;&]") | exact_match(name).isNotNull()
    first = _team(F.when(~plain(behind).rlike(EXACT_REFUSED), _looked_up(F.regexp_extract(low, shape, 1), STATISTICS)), F.trim(behind))
    second = _team(F.when(~plain(team).rlike(EXACT_REFUSED) & ~rest.rlike(EXACT_REFUSED), told), team)
    return F.when(refused, None).when(low.rlike(shape), first).otherwise(second)


def plural_match(name: Column) -> Column:
    text = plain(F.trim(name))
    return F.when(~_has(text, PLURAL_REFUSED) & ~text.contains(" - "), _looked_up(text, PLURAL_MATCH))


def plural_team(name: Column) -> Column:
    """``Team total STATISTIC`` or ``Total STATISTIC Team``, with or without ``de``."""
    whole = F.trim(name)
    stats = "|".join(sorted(PLURAL_STATISTICS, key=lambda s: (-len(s), s)))
    low, left, right = plain(whole), rf"^(.+?)\s+total\s+(?:de\s+)?({stats})$", rf"^total\s+(?:de\s+)?({stats})\s+(.{{2,}})$"
    before = F.trim(F.substring(whole, F.lit(1), F.length(F.regexp_extract(low, left, 1))))
    behind = F.trim(F.substring(whole, F.length(whole) - F.length(F.regexp_extract(low, right, 2)) + 1, F.length(whole)))
    refused = _has(low, PLURAL_REFUSED) | _looked_up(low, PLURAL_MATCH).isNotNull()
    return F.when(refused, None).when(low.rlike(left), _team(_looked_up(F.regexp_extract(low, left, 2), PLURAL_STATISTICS), before)).when(low.rlike(right), _team(_looked_up(F.regexp_extract(low, right, 1), PLURAL_STATISTICS), behind))


def _complete(sold: DataFrame, by: list[str]) -> DataFrame:
    """sold(by, line, side, odd, seq) to complete pairs; the last price of a side counts, the higher of two at once."""
    last = lambda side: F.max_by(F.when(F.col("side") == side, F.col("odd")), F.when(F.col("side") == side, F.struct("seq", "odd")))
    return sold.groupBy(*by, "line").agg(last("over").alias("over"), last("under").alias("under")).where("over IS NOT NULL AND under IS NOT NULL")


def coded_pairs(odds: DataFrame, codes: DataFrame, by: list[str]) -> DataFrame:
    """odds(by, market_id, pos, h, coef, lock, seq) with codes(market_id, market, team, over_pos, under_pos) to (by, market, team, line, over, under).

    Locked odds, those of 1 or less and those without a line are left out. A code list is a house's own and short.
    """
    joined = odds.join(F.broadcast(codes), "market_id").where("NOT coalesce(lock, false) AND coef > 1 AND h IS NOT NULL")
    side = F.when(F.col("pos") == F.col("over_pos"), "over").when(F.col("pos") == F.col("under_pos"), "under")
    sold = joined.select(*by, "market", "team", F.col("h").cast("double").alias("line"), side.alias("side"), F.round("coef", 2).alias("odd"), "seq").where("side IS NOT NULL")
    return _complete(sold, [*by, "market", "team"])


def selected_pairs(selections: DataFrame, by: list[str]) -> DataFrame:
    """selections(by, market, name, handicap, price, seq) to (by, market, line, over, under): names that begin with mais or menos."""
    side = F.when(F.col("name").rlike(r"(?i)^\s*mais"), "over").when(F.col("name").rlike(r"(?i)^\s*menos"), "under")
    sold = selections.where("handicap IS NOT NULL AND coalesce(price, 0) != 0").select(*by, F.trim("market").alias("market"), F.col("handicap").alias("line"), side.alias("side"), F.col("price").alias("odd"), "seq")
    return _complete(sold.where("side IS NOT NULL"), [*by, "market"])


def three_results(selections: DataFrame, by: list[str]) -> DataFrame:
    """selections(by, place, market, name, price, seq) to (by, home, draw, away) of the first final result, by place, that has all three."""
    price = lambda n: F.max_by(F.when(F.col("name") == n, F.col("price")), F.when(F.col("name") == n, F.struct("seq", "price")))
    told = selections.where(F.col("market").startswith("Resultado Final")).groupBy(*by, "place").agg(price("1").alias("home"), price("X").alias("draw"), price("2").alias("away"))
    whole = told.where("home IS NOT NULL AND draw IS NOT NULL AND away IS NOT NULL")
    return whole.groupBy(*by).agg(F.min_by(F.struct("home", "draw", "away"), "place").alias("r")).select(*by, "r.*")
