"""Queries of times, leagues, month files, calibration, logs by month, documents, and of flags as a board raises them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import names, prob, times
from larkspur.operators import feeds, history, ladder
from larkspur.operators.matching import by_names
from larkspur.plans.boards import dealt, dealt_sql
from larkspur.plans.events import _GRADED, T, _graded, timed
from larkspur.plans.prices import _K, L, M, _ou, _pois, ladders, models
from larkspur.plans.registry import query, scratch, table
from larkspur.sources import sinks, snapshots


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate <= TIMESTAMP '1995-06-01 06:00:00')")
def close_mode_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that start within some hours from now; one whose start does not read passes."""
    now = F.lit("1995-03-01 00:00:00").cast("timestamp")
    start = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").where(feeds.in_window(start, now, 92 * 24 + 6)).select(F.col("o_orderkey").alias("id"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 9 = 8 THEN NULL WHEN event_id % 9 IN (5, 6) THEN date_trunc('minute', ts) WHEN event_id % 9 = 7 THEN date_trunc('day', ts)::TIMESTAMP WHEN event_id % 9 IN (1, 2) THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END AS at,
  CASE WHEN event_id % 9 <> 8 THEN CAST(CAST(CASE WHEN event_id % 9 = 7 THEN date_trunc('day', ts)::TIMESTAMP ELSE ts END - INTERVAL 3 HOUR AS DATE) AS VARCHAR) END AS day FROM events""")
def instants_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instant in nine ways: seconds, milliseconds, /Date(ms)/, ISO with Z or an offset, without seconds, with an underscore, a date, and none."""
    i, at = F.col("event_id") % 9, F.col("ts").cast("timestamp")
    us = F.unix_micros(at)
    pattern = lambda p, t=at: F.date_format(t, p)
    west = at - F.expr("INTERVAL 3 HOURS")
    forms = [
        F.floor(us / 1_000_000).cast("string"), F.floor(us / 1000).cast("string"), F.concat(F.lit("/Date("), F.floor(us / 1000), F.lit(")/")), F.concat(pattern("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")),
        F.concat(pattern("yyyy-MM-dd'T'HH:mm:ss", west), F.lit("-03:00")), F.concat(pattern("yyyy-MM-dd HH:mm"), F.lit("Z")), pattern("yyyy-MM-dd_HHmm"), pattern("yyyy-MM-dd"), F.lit("soon"),
    ]
    text = F.get(F.array(*forms), i.cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), times.parse_instant(text).alias("t"))
    return rows.select("id", F.col("t").cast("timestamp_ntz").alias("at"), times.civil_date(F.col("t")).cast("string").alias("day"))


#: League names and the class of each, as the table of classes says.
LEAGUES = [
    ("CONMEBOL Sul-Americana", "sula"), ("Copa Libertadores", "liberta"), ("Major League Soccer", "mls"), ("México - Liga MX", "mx"), ("Brasileirão Série B", "br-b"), ("Brasil Série C", "br-c"), ("Brasileirão Série A", "br-a"),
    ("Copa do Mundo FIFA", "wc"), ("Copa do Brasil", "br-cdb"), ("Inglaterra Premier League", "epl"), ("Espanha LaLiga", "laliga"), ("UEFA Champions League", "ucl"), ("Suécia Allsvenskan", "allsv"), ("Uruguai Primera", "uy"),
    ("Equador LigaPro", "ec"), ("China CSL", "csl"), ("Russia Premier", "ru"), ("Noruega Eliteserien", None), ("", None), (None, None),
]


@query(f"SELECT o_orderkey AS id, {dealt_sql([c for _, c in LEAGUES], 'o_custkey')} AS class, coalesce({dealt_sql([c for _, c in LEAGUES], 'o_custkey')} <> {dealt_sql([c for _, c in LEAGUES], 'o_orderkey')}, false) AS conflict FROM orders")
def league_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of a league's name, and whether two leagues cannot be one."""
    texts = [t for t, _ in LEAGUES]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), names.league_class(dealt(texts, F.col("o_custkey"))).alias("class"), names.league_class(dealt(texts, F.col("o_orderkey"))).alias("other"))
    return rows.select("id", "class", names.leagues_conflict(F.col("class"), F.col("other")).alias("conflict"))


_MONTHS = """SELECT 'k' || o_custkey AS key, strftime(o_orderdate, '%Y-%m') AS month, min(o_orderdate)::TIMESTAMP AS open_ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open_odd, max(o_orderdate)::TIMESTAMP AS last_ts, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_odd,
  max(o_totalprice) AS max_odd, min(o_totalprice) AS min_odd, count(*) AS n_obs FROM orders GROUP BY ALL"""


@query(f"""SELECT key, arg_min(open_odd, (open_ts, month)) AS open_odd, arg_max(last_odd, (last_ts, month)) AS last_odd, max(max_odd) AS max_odd, min(min_odd) AS min_odd, sum(n_obs)::BIGINT AS n_obs, string_agg(month, ',' ORDER BY month) AS merged_from FROM ({_MONTHS}) GROUP BY key""")
def month_files_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the files of many months, read at once and merged by key."""
    path, at = scratch(spark, "keys"), F.struct("o_orderdate", "o_orderkey")
    price, day = F.col("o_totalprice"), F.col("o_orderdate").cast("timestamp")
    month = F.date_format("o_orderdate", "yyyy-MM")
    rows = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("k"), "o_custkey").alias("key"), month.alias("month")).agg(
        F.min(day).alias("open_ts"), F.min_by(price, at).alias("open_odd"), F.max(day).alias("last_ts"), F.max_by(price, at).alias("last_odd"), F.max(price).alias("max_odd"), F.min(price).alias("min_odd"), F.count("*").alias("n_obs"))
    notes = rows.select("month").distinct().select(F.lit("__main_lines__").alias("key"), "month")
    rows.unionByName(notes, allowMissingColumns=True).write.partitionBy("month").json(path)
    schema = "key string, open_ts timestamp, open_odd double, last_ts timestamp, last_odd double, max_odd double, min_odd double, n_obs long"
    read = snapshots.month_keys(spark, path, schema).withColumns({"source": F.col("month"), "n_moves": F.lit(0).cast("long"), "status": F.lit("open"), "result": F.lit(None).cast("long")})
    return history.merge_records(read, ["key"]).select("key", "open_odd", "last_odd", "max_odd", "min_odd", "n_obs", "merged_from")


@query("""SELECT competition, count(*) AS n, sum(h) AS h, sum(a) AS a, min(date) AS first FROM (SELECT 'c' || o_custkey % 5 AS competition, CASE WHEN o_orderkey % 11 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 30)::DOUBLE END AS h, (o_orderkey % 17)::DOUBLE AS a FROM orders)
  WHERE competition IN ('c1', 'c3') AND date IS NOT NULL AND h IS NOT NULL GROUP BY competition""")
def calibration_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that a model is fitted on, out of documents of all competitions."""
    path, k = scratch(spark, "matches"), F.col("o_orderkey")
    stats = F.struct(F.struct(F.when(k % 4 > 0, k % 30).cast("double").alias("h"), (k % 17).cast("double").alias("a")).alias("fouls"))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 5).alias("competition"), F.when(k % 11 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), k.alias("match_id"), F.struct(k.alias("id")).alias("home"), F.struct((k + 1).alias("id")).alias("away"), stats.alias("stats"))
    # a document holds the matches of a month
    rows.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.collect_list(F.struct(*rows.columns)).alias("matches")).select("matches").write.json(path)
    found = snapshots.calibration(spark, path, ["c1", "c3"], "fouls", lines=True)
    return found.groupBy("competition").agg(F.count("*").alias("n"), F.sum("h").alias("h"), F.sum("a").alias("a"), F.min("date").alias("first"))


@query(f"SELECT coalesce(strftime(CASE WHEN game % 4 > 0 THEN kickoff END, '%Y-%m'), 'unknown') AS month, house, 2 * count(*) AS n, round(2 * sum(odd), 4) AS total FROM ({T}) GROUP BY ALL")
def clv_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled rows appended twice by the month of kickoff, and read back by it."""
    path = scratch(spark, "clv")
    rows = timed(spark, sf_dir).select("house", "odd", F.when(F.col("game") % 4 > 0, F.col("kickoff")).alias("kickoff"))
    for _ in range(2):
        sinks.append_months(rows, path)
    read = spark.read.schema("house string, odd double, kickoff timestamp_ntz, month string").parquet(path)
    return read.groupBy("month", "house").agg(F.count("*").alias("n"), F.round(F.sum("odd"), 4).alias("total"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def view_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of a few rows as a document that a page loads, read back."""
    path = scratch(spark, "document")
    report = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    sinks.document(report, path, "REPORT", ["segment"])
    text = spark.read.option("wholetext", True).text(path)
    body = F.regexp_extract("value", r"(?s)^\s*window\.REPORT = (\[.*\]);\s*$", 1)
    return text.select(F.explode(F.from_json(body, "array<struct<segment: string, n: long, total: double>>")).alias("r")).select("r.*")


TYPES = ["Total de Escanteios", "Escanteios 3-Way", "Total", "Total 3 Vias", None]
_BOARD = f"""SELECT grp, a1, a2, a3, house, line, side, odd, round(chance * odd + p_push - 1, 6) AS ev, round(chance / (1 - p_push) - fair, 6) AS edge FROM (
  SELECT *, unnest([{{'side': 'over', 'odd': "over", 'chance': p_over, 'fair': (1 / "over") / (1 / "over" + 1 / "under")}}, {{'side': 'under', 'odd': "under", 'chance': p_under, 'fair': (1 / "under") / (1 / "over" + 1 / "under")}}], recursive := true) FROM (
  {_ou(f'SELECT l.*, m.mu, {_K} FROM ({L}) l JOIN ({M}) m USING (grp) WHERE a1 % 9 < 6 AND house <> 3 AND a2 % 5 IN (0, 2, 4) AND "over" > 1 AND "under" > 1 AND 1 / "over" + 1 / "under" - 1 BETWEEN -1e-9 AND 0.12 + 1e-9', _pois('k', 'mu'), _pois('k - 1', 'mu'))}))
  WHERE chance BETWEEN 0.15 AND 0.85 AND round(chance * odd + p_push - 1, 6) >= 0.05 AND round(chance / (1 - p_push) - fair, 6) >= 0.04"""


def _board_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-02-01 12:00:00").cast("timestamp")
    kickoff = F.when(F.col("a1") % 9 < 5, now + F.expr("INTERVAL 1 HOUR")).when(F.col("a1") % 9 > 5, now - F.expr("INTERVAL 1 HOUR"))
    rows = ladders(spark, sf_dir).withColumns({"kickoff": kickoff, "stale": F.col("house") == 3, "type_name": dealt(TYPES, F.col("a2"))}).join(models(spark, sf_dir), "grp")
    priced = by_names(rows, "p", prob.ou_from_sums(lambda k: prob.poisson_sums(k, F.col("mu")), F.col("mu"), F.col("line")), ("mu", "line"))
    return ladder.value_flags(priced, now)


@query(_BOARD)
def board_value_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of every line that a board may still flag: games to come, fresh houses, two-way markets."""
    return _board_flags(spark, sf_dir).select("grp", "a1", "a2", "a3", "house", "line", "side", "odd", "ev", "edge")


@query(f"SELECT house AS market, side, count(*) AS n FROM ({_BOARD}) GROUP BY ALL")
def board_flags_by_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many flags each market has."""
    return _board_flags(spark, sf_dir).groupBy(F.col("house").alias("market"), "side").agg(F.count("*").alias("n"))


@query(f"SELECT quality, count(*) AS n, round(100.0 * count(*) FILTER (n_moves > 0) / count(*), 6) AS moved FROM ({_GRADED}) GROUP BY quality")
def bank_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank's banner: records of each capture quality and how many of them moved."""
    return _graded(spark, sf_dir).groupBy("quality").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("n_moves") > 0) / F.count("*"), 6).alias("moved"))
