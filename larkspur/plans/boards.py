"""Queries of keys, names and board states: texts are dealt to the rows of orders by their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import keys, names
from larkspur.plans.registry import query, table

LEAGUE_TEXTS = [
    "Brasileirão Série A", "Brasileirao Serie B", "Brazil Serie A", "Premier League", "Premier Inglaterra", "LaLiga 2", "Primera Espanha", "Itália Serie A",
    "Bundesliga", "2. Bundesliga", "Ligue 1", "China CSL", "Bolivia Liga", "LigaPro Equador", "Eliteserien", "Outra Liga",
]
MARKET_TEXTS = [
    "Total de Cartões", "Flamengo Total de chutes", "Escanteios", "Total de Chutes no gol", "Gols", "Time X Total de Faltas", "laterais", "Total de tiros de meta",
    "Impedimentos", "Sporting Total de Laterais", "3-Vias Mais/Menos", "Total 3 way",
]
ERROR_TEXTS = ["Read timeout after 30s", "HTTP 429 slow down", "403 Forbidden", "bad token", "JSON empty body", "connection reset", None]
NAME_TEXTS = ["Arsenal (Corners)", "Leeds - Home - Home", "Ajax (Cards)", "Total - Over - Under", "Porto", "Benfica b f", "Brasil u20", "Sporting Kansas City", "real union"]
START_TEXTS = ["01/02 10:00", "31/01 23:30", "31/01 20:00", "15/07 12:00", "31/12 12:00", "30/02 12:00", "soon", None, "1/2 9:05"]
NOW = "2024-02-01 00:00:00"


def dealt(texts: list, by: Column) -> Column:
    return F.get(F.array(*[F.lit(t).cast("string") for t in texts]), (by % len(texts)).cast("int"))


def dealt_sql(texts: list, by: str) -> str:
    listed = ", ".join("NULL" if t is None else f"'{t}'" for t in texts)
    return f"[{listed}][{by} % {len(texts)} + 1]"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").cast("string").alias("day"))


O = "SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders"  # noqa: E741
_PLAIN = lambda x: f"translate(lower(coalesce({x}, '')), '{names.ACCENTED}', '{names.PLAIN}')"


def _league_sql() -> str:
    def has(*parts: str) -> str:
        return " AND ".join("(" + " OR ".join(f"l LIKE '%{p}%'" for p in part.split("|")) + ")" for part in parts)

    rules = [
        (has("brasileir|brazil serie", "serie b|- b"), "B,BR-B,,BR-B"),
        (has("brasileir|brazil serie") + " AND l NOT LIKE '%serie b%'", "A,BR-A,BR,BR-A"),
        (f"{has('premier league')} OR ({has('premier', 'ingl')})", "PL,PL,PL,PL"),
        (f"{has('laliga|la liga')} OR ({has('primera', 'espan')})", "LL,LL,LL,LL"),
        (has("serie a", "ital"), "SA,SA,SA,SA"), (has("bundesliga") + " AND l NOT LIKE '%2%'", "BU,BU,BU,BU"), (has("ligue 1"), "L1,L1,L1,L1"),
        (has("chin|csl"), ",,,CSL"), (has("bolivi"), ",,,BOL"), (has("equador|ecuad|ligapro"), ",,,ECU"), (has("norueg|eliteserien"), ",,,NOR"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + " END"


@query(f"SELECT league, codes, count(*) AS n FROM (SELECT league, {_league_sql()} AS codes FROM (SELECT league, {_PLAIN('league')} AS l FROM (SELECT {dealt_sql(LEAGUE_TEXTS, 'id')} AS league FROM ({O})))) GROUP BY ALL")
def league_model_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).select(dealt(LEAGUE_TEXTS, F.col("id")).alias("league")).withColumn("m", keys.league_models(F.col("league")))
    codes = F.when(F.col("m").isNotNull(), F.array_join(F.array(*[F.coalesce(F.col(f"m.{x}"), F.lit("")) for x in ("cards", "fouls", "shots", "corners")]), ","))
    return rows.groupBy("league", codes.alias("codes")).agg(F.count("*").alias("n"))


def _market_sql(raw: str) -> str:
    t = f"regexp_replace({_PLAIN(f'trim({raw})')}, '^.*?total de\\s+', '')"
    return "CASE " + " ".join(f"WHEN {t} = '{n}' OR {t} LIKE '% {n}' THEN '{m}'" for n, m in keys.MARKET_NAMES.items()) + " END"


@query(f"SELECT raw, {_market_sql('raw')} AS market, regexp_matches(replace(replace(lower(raw), ' ', ''), '-', ''), '3vias|3way') AS three, count(*) AS n FROM (SELECT {dealt_sql(MARKET_TEXTS, 'id')} AS raw FROM ({O})) GROUP BY ALL")
def market_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).select(dealt(MARKET_TEXTS, F.col("id")).alias("raw"))
    return rows.groupBy("raw", keys.market_name(F.col("raw")).alias("market"), keys.three_way(F.col("raw")).alias("three")).agg(F.count("*").alias("n"))


@query(f"""SELECT raw, {_market_sql("regexp_extract(raw, '(?i)total de (.*)$', 1)")} AS market, regexp_extract(raw, '(?i)^(.+?)\\s+total de', 1) AS team, count(*) AS n FROM (SELECT {dealt_sql(MARKET_TEXTS, 'cust')} AS raw FROM ({O}))
  WHERE regexp_matches(raw, '(?i)^.+\\s+total de\\s+') GROUP BY ALL""")
def team_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).select(dealt(MARKET_TEXTS, F.col("cust")).alias("raw")).withColumn("m", keys.team_market(F.col("raw"))).where("m IS NOT NULL")
    return rows.groupBy("raw", "m.market", "m.team").agg(F.count("*").alias("n"))


@query(f"""SELECT message, CASE WHEN message IS NULL THEN NULL WHEN regexp_matches(lower(message), 'timeout') THEN 'Timeout' WHEN regexp_matches(lower(message), '429|rate') THEN 'HTTP429'
  WHEN regexp_matches(lower(message), '403|401|geo|blocked|forbidden') THEN 'Geo' WHEN regexp_matches(lower(message), 'auth|token|jwt') THEN 'Auth' WHEN regexp_matches(lower(message), 'parse|json|empty') THEN 'Parse' ELSE 'Other' END AS class,
  count(*) AS n FROM (SELECT {dealt_sql(ERROR_TEXTS, 'id')} AS message FROM ({O})) GROUP BY ALL""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).select(dealt(ERROR_TEXTS, F.col("id")).alias("message"))
    return rows.groupBy("message", keys.error_class(F.col("message")).alias("class")).agg(F.count("*").alias("n"))


_KEY = "house || '|' || CASE WHEN fixture <> '' THEN 'sofa:' || fixture ELSE day || '|h' || cust || '|a' || id END || '|Gols|' || line || '|' || side"


@query(f"""SELECT id, {_KEY} AS key, house, CASE WHEN fixture <> '' THEN fixture END AS fixture, CASE WHEN fixture = '' THEN day END AS day, line, side, CASE WHEN fixture <> '' THEN 'sofa' ELSE 'legacy' END AS format
  FROM (SELECT id, cust, day, 'c' || cust % 7 AS house, CASE WHEN id % 3 = 0 THEN '' ELSE CAST(id AS VARCHAR) END AS fixture, CASE WHEN id % 4 = 0 THEN CAST(id % 9 AS VARCHAR) ELSE (id % 9) || '.5' END AS line, CASE WHEN id % 2 = 0 THEN 'over' ELSE 'under' END AS side FROM ({O}))""")
def history_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys made from their parts, with lines as text, and read again."""
    rows = orders(spark, sf_dir).select(
        "id", "day", F.concat(F.lit("h"), "cust").alias("home"), F.concat(F.lit("a"), "id").alias("away"), F.concat(F.lit("c"), F.col("cust") % 7).alias("house"),
        F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("fixture"),
        keys.line_key(F.when(F.col("id") % 4 == 0, F.col("id") % 9).otherwise(F.col("id") % 9 + 0.5).cast("double").cast("string")).alias("line"),
        F.when(F.col("id") % 2 == 0, "Mais").otherwise("Menos").alias("side"),
    )
    made = rows.select("id", keys.history_key(F.col("house"), F.col("day"), F.col("home"), F.col("away"), F.lit("Gols"), F.col("line"), F.col("side"), F.col("fixture")).alias("key"))
    return made.withColumn("k", keys.parsed_key(F.col("key"))).select("id", "key", "k.house", "k.fixture", "k.day", "k.line", "k.side", "k.format")


@query(f"""SELECT raw, CASE WHEN regexp_matches(raw, '\\(') THEN regexp_extract(raw, '^(.*) \\(', 1) WHEN raw = 'Leeds - Home - Home' THEN 'Leeds - Home' ELSE raw END AS clean,
  array_to_string(list_sort([x FOR x IN string_split(lower(raw), ' ') IF list_contains({names.FLAGS}, x)]), ' ') AS flags,
  array_to_string([x FOR x IN string_split(lower(raw), ' ') IF NOT list_contains({names.WEAK}, x)], ' ') AS strong, count(*) AS n FROM (SELECT {dealt_sql(NAME_TEXTS, 'id')} AS raw FROM ({O})) GROUP BY ALL""")
def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    rows = orders(spark, sf_dir).select(dealt(NAME_TEXTS, F.col("id")).alias("raw"))
    clean = keys.without_echo(keys.without_unit(raw))
    return rows.groupBy("raw", clean.alias("clean"), names.flags(F.lower(raw)).alias("flags"), names.strip_weak(F.lower(raw)).alias("strong")).agg(F.count("*").alias("n"))


@query(f"""SELECT text, CASE WHEN k IS NULL THEN 'unknown' WHEN h < 0 THEN 'upcoming' WHEN h <= 3 THEN 'started' ELSE 'finished' END AS state, count(*) AS n FROM (SELECT text, k, epoch(TIMESTAMP '{NOW}' - k) / 3600 AS h FROM (
  SELECT text, CASE WHEN epoch(TIMESTAMP '{NOW}' - k0) > 180 * 86400 THEN k0 + INTERVAL 1 YEAR ELSE k0 END AS k FROM (
  SELECT text, CASE WHEN regexp_matches(text, '^[0-9]') THEN try_strptime('2024/' || text, '%Y/%d/%m %H:%M') END AS k0 FROM (SELECT {dealt_sql(START_TEXTS, 'id')} AS text FROM ({O}))))) GROUP BY ALL""")
def game_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).select(dealt(START_TEXTS, F.col("id")).alias("text"))
    return rows.groupBy("text", keys.game_state(F.col("text"), F.lit(NOW).cast("timestamp_ntz")).alias("state")).agg(F.count("*").alias("n"))


_BOARD = f"SELECT id, cust % 5 AS houses, id % 3 > 0 AS fixture, CASE WHEN id % 11 = 0 THEN NULL ELSE id % 400 END AS age, CASE WHEN id % 13 = 0 THEN NULL ELSE id % 4000 - 100 END AS ko, id % 17 <> 0 AS act FROM ({O})"


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return orders(spark, sf_dir).select("id", (F.col("cust") % 5).alias("houses"), (i % 3 > 0).alias("fixture"), F.when(i % 11 != 0, i % 400).alias("age"), F.when(i % 13 != 0, i % 4000 - 100).alias("ko"), (i % 17 != 0).alias("act"))


@query(f"""SELECT id, score, CASE WHEN score >= 70 THEN 'alta' WHEN score >= 50 THEN 'média' ELSE 'baixa' END AS label FROM (SELECT id, CASE WHEN ko IS NULL OR ko <= 0 OR age IS NULL OR age > 120 OR NOT act THEN least(s, 49) WHEN fixture THEN least(100, s + b) ELSE least(100, s + b, 69) END AS score
  FROM (SELECT *, CASE WHEN houses >= 4 THEN 35 WHEN houses = 3 THEN 28 WHEN houses = 2 THEN 18 ELSE 6 END + CASE WHEN fixture THEN 30 ELSE 5 END + CASE WHEN age <= 90 THEN 20 WHEN age <= 180 THEN 12 WHEN age <= 300 THEN 5 ELSE 0 END AS s,
  CASE WHEN ko >= 15 AND ko <= 1440 THEN 15 WHEN ko < 15 THEN 6 WHEN ko <= 2880 THEN 10 ELSE 0 END AS b FROM ({_BOARD})))""")
def signal_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = keys.confidence(F.col("houses"), F.col("fixture"), F.col("age"), F.col("ko"), F.col("act"))
    return board(spark, sf_dir).select("id", score.alias("score")).withColumn("label", keys.confidence_label(F.col("score")))


@query(f"SELECT CASE WHEN age IS NULL THEN 'unk' WHEN age <= 10 THEN 'fresh' WHEN age <= 60 THEN 'mid' ELSE 'old' END AS band, coalesce(age > 120, true) AS stale, count(*) AS n FROM ({_BOARD}) GROUP BY ALL")
def freshness_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board(spark, sf_dir).withColumn("f", keys.freshness(F.col("age"))).groupBy("f.band", "f.stale").agg(F.count("*").alias("n"))


_E = "SELECT event_id AS id, user_id AS game, event_type AS house, ts, round(1.02 + value / 100 + 1e-7, 2) AS odd FROM events"


@query(f"""SELECT game, house, round(100 * (last_odd / open_odd - 1), 6) AS drift, CASE WHEN last_odd - open_odd >= 0.05 THEN 'up' WHEN last_odd - open_odd <= -0.05 THEN 'down' ELSE 'flat' END AS band, age, minute
  FROM (SELECT game, house, arg_min(odd, (ts, id)) AS open_odd, arg_max(odd, (ts, id)) AS last_odd, CAST(greatest(0, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 60e6)) AS BIGINT) AS age, CAST(floor(epoch_us(min(ts)) / 60e6) AS BIGINT) AS minute FROM ({_E}) GROUP BY ALL)""")
def drift_and_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("game"), F.col("event_type").alias("house"), F.col("ts").cast("timestamp").alias("ts"), F.round(1.02 + F.col("value") / 100 + 1e-7, 2).alias("odd"))
    at = F.struct("ts", "id")
    g = rows.groupBy("game", "house").agg(F.min_by("odd", at).alias("a"), F.max_by("odd", at).alias("b"), F.max("ts").alias("last"), F.min("ts").alias("first"))
    return g.select(
        "game", "house", F.round(keys.drift_percent(F.col("a"), F.col("b")), 6).alias("drift"), keys.drift_band(F.col("b") - F.col("a")).alias("band"),
        keys.age_minutes(F.col("last"), F.lit(NOW).cast("timestamp")).alias("age"), keys.epoch_minute(F.col("first")).alias("minute"))


@query(f"SELECT id, 'L' || cust % 3 || '|' || id % 5 AS league, CAST(id AS VARCHAR) AS team, CASE WHEN id % 10 = 0 THEN 99 ELSE abs(CAST(day AS DATE) - DATE '2024-02-01') END AS days FROM ({O})")
def team_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).withColumn("key", F.concat_ws("|", F.concat(F.lit("L"), F.col("cust") % 3), F.col("id") % 5, "id")).withColumn("k", keys.team_key(F.col("key")))
    return rows.select("id", "k.league", F.col("k.id").alias("team"), keys.days_apart(F.when(F.col("id") % 10 == 0, "?").otherwise(F.col("day")), F.lit("2024-02-01")).alias("days"))
