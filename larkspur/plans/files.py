"""Queries of feeds, readers and writers: each writes files as a house or a run would, and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import feeds
from larkspur.plans.boards import LEAGUE_TEXTS, O, _PLAIN, dealt, dealt_sql, orders
from larkspur.plans.ledger import B, ledger
from larkspur.plans.registry import query, scratch, table
from larkspur.sources import sinks, snapshots

HEADERS = ["Total de escanteios", "Corners", "Cartões", "Total Gols", "Gols 1º tempo", "Chutes ao gol", "Total shots", "Faltas", "Impedimentos", "Handicap Gols", "Outro"]
SELECTIONS = ["Over 2.5", "Mais de 3.5", "Under 2.5", "Menos de 3.5", "abaixo 1.5", "acima 1.5", "Over 2,25", "Exato 3", "Under"]
EVENT_NAMES = ["Ajax v Porto", "Ajax (E) v Porto (E)", "Virtual Cup", "Esoccer Live", "E-Sport One", "Porto v Leeds", "Simulada"]
NOON = "2024-02-01 12:00:00"


def _market_sql(raw: str) -> str:
    t = _PLAIN(raw)
    return f"CASE WHEN regexp_matches({t}, '{feeds.NOT_TOTALS}') THEN NULL " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{m}'" for m, p in feeds.MARKETS) + " END"


_SELECTED = f"""SELECT game, market, line, side, odd, id FROM (SELECT id, cust % 20 AS game, price AS odd, {_market_sql(dealt_sql(HEADERS, '(id // 9)'))} AS market, {_PLAIN(dealt_sql(SELECTIONS, 'id'))} AS s,
  CASE WHEN NOT contains({dealt_sql(SELECTIONS, 'id')}, ',') THEN TRY_CAST(regexp_extract({dealt_sql(SELECTIONS, 'id')}, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) END AS line,
  CASE WHEN regexp_matches(s, '\\b(over|mais|acima)\\b') THEN 'over' WHEN regexp_matches(s, '\\b(under|menos|abaixo)\\b') THEN 'under' END AS side FROM ({O})) WHERE market IS NOT NULL"""


@query(f"SELECT * FROM (SELECT game, market, line, arg_min(odd, id) FILTER (side = 'over') AS over, arg_min(odd, id) FILTER (side = 'under') AS under FROM ({_SELECTED}) GROUP BY ALL) WHERE over IS NOT NULL AND under IS NOT NULL AND line IS NOT NULL")
def feed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and selections of a house to complete pairs."""
    i, text = F.col("id"), F.col("text")
    rows = orders(spark, sf_dir).select("id", (F.col("cust") % 20).alias("game"), F.col("price").alias("odd"), dealt(HEADERS, F.floor(i / 9)).alias("header"), dealt(SELECTIONS, i).alias("text"))
    sold = rows.select("game", feeds.market_of(F.col("header")).alias("market"), feeds.line_of(text).alias("line"), feeds.side_of(text).alias("side"), "odd", F.col("id").alias("seq")).where("market IS NOT NULL")
    return feeds.pairs(sold, ["game", "market"])


_VIRTUAL = lambda x: f"NOT regexp_matches({_PLAIN(x)}, '{feeds.VIRTUAL.replace(chr(92) * 2, chr(92))}')"


@query(f"SELECT id, name FROM (SELECT CASE WHEN id % 10 = 3 THEN -id ELSE id END AS id, {dealt_sql(EVENT_NAMES, 'cust')} AS name FROM ({O})) WHERE {_VIRTUAL('name')} AND id >= 0")
def real_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without virtual games and negative ids."""
    i = F.col("id")
    rows = orders(spark, sf_dir).select(F.when(i % 10 == 3, -i).otherwise(i).alias("event_id"), dealt(EVENT_NAMES, F.col("cust")).alias("name"), F.lit("Liga").alias("league"))
    return feeds.real_events(rows).select(F.col("event_id").alias("id"), "name")


TIERS = ["brasileir", "premier", "serie a"]
_TIER = "CASE " + " ".join(f"WHEN regexp_matches({_PLAIN('league')}, '{t}') THEN {k}" for k, t in enumerate(TIERS)) + f" ELSE {len(TIERS)} END"


@query(f"SELECT id, tier FROM (SELECT id, {_TIER} AS tier, day FROM (SELECT id, {dealt_sql(LEAGUE_TEXTS, 'id')} AS league, CASE WHEN id % 7 > 0 THEN day END AS day FROM ({O}))) ORDER BY tier, day NULLS LAST, id LIMIT 60")
def event_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 events by tier of league, then start."""
    rows = orders(spark, sf_dir).select(F.col("id").alias("event_id"), dealt(LEAGUE_TEXTS, F.col("id")).alias("league"), F.when(F.col("id") % 7 > 0, F.col("day")).alias("day"))
    return feeds.first_events(rows, TIERS, "league", "day", 60).select(F.col("event_id").alias("id"), "tier")


_LINES = f"SELECT house, game, 'm' || (id // 16) % 3 AS market, line, arg_min(odd, id) FILTER (side = 'over') AS over, arg_min(odd, id) FILTER (side = 'under') AS under FROM ({B}) GROUP BY ALL"


@query(f"SELECT house, CAST(game AS VARCHAR) AS game, market, row_number() OVER (PARTITION BY house, game, market ORDER BY line) - 1 AS pos, line, over, under, TIMESTAMP '{NOON}' AS kickoff FROM ({_LINES}) WHERE over IS NOT NULL AND under IS NOT NULL")
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized events of every house, written as lines of JSON and read as ladders."""
    rows = ledger(spark, sf_dir).select("house", F.col("game").cast("string").alias("game"), F.concat(F.lit("m"), F.expr("id DIV 16") % 3).alias("market"), "line", "side", "odd", F.col("id").alias("seq"))
    events = feeds.documents(feeds.pairs(rows, ["house", "game", "market"]), ["house", "game"])
    path = scratch(spark, "snapshot")
    events.select(F.col("house").alias("casa"), F.col("game").alias("event_id"), F.lit("2024-02-01T09:00:00-03:00").alias("start"), "mercados").write.json(path)
    return snapshots.ladder_lines(snapshots.snapshot(spark, path)).select(F.col("casa").alias("house"), F.col("event_id").alias("game"), "market", "pos", "line", "over", "under", F.col("kickoff").cast("timestamp_ntz").alias("kickoff"))


@query("SELECT count(*) FILTER (o_orderkey % 6 > 0) AS objects, count(*) AS lines FROM orders")
def snapshot_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of a snapshot are objects; one in six is cut off."""
    path, k = scratch(spark, "lines"), F.col("o_orderkey")
    line = F.to_json(F.struct("o_orderkey", "o_orderpriority"))
    table(spark, sf_dir, "orders").select(F.when(k % 6 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return snapshots.valid_lines(spark, path)


@query(f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, house, count(*) AS n, round(sum(odd), 6) AS total FROM ({B}) WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY ALL")
def tick_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks appended by day; days before the cutoff are not read."""
    path = scratch(spark, "ticks")
    rows = ledger(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.lit("price").alias("kind"), F.col("house").alias("casa"), F.col("market").alias("mercado"), F.col("line").alias("linha"), F.col("side").alias("lado"), "odd")
    sinks.append_ticks(rows, path)
    return snapshots.tick_log(spark, path, "2024-01-05").groupBy(F.col("date").cast("string").alias("day"), F.col("casa").alias("house")).agg(F.count("*").alias("n"), F.round(F.sum("odd"), 6).alias("total"))


@query(f"SELECT house, count(*) FILTER (ok) AS good, count(*) AS runs, sum(n) AS n FROM (SELECT CAST(ts AS DATE) AS day, house, count(*) AS n, count(*) % 4 > 0 AS ok FROM ({B}) WHERE ts >= TIMESTAMP '2024-01-04' GROUP BY ALL) GROUP BY house")
def run_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a day with a map of houses, since a cutoff, one row a house."""
    path, n = scratch(spark, "runs"), F.count("*")
    each = ledger(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "house").agg(n.alias("n"), (n % 4 > 0).alias("ok"))
    runs = each.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("house", F.struct("ok", "n")))).alias("casas"), F.sum("n").alias("total"))
    runs.select(F.concat(F.col("day").cast("string"), F.lit("T00:00:00Z")).alias("ts"), "casas", "total").write.json(path)
    return snapshots.run_log(spark, path, "2024-01-04 00:00:00").groupBy("house").agg(F.count_if("ok").alias("good"), F.count("*").alias("runs"), F.sum("n").alias("n"))


@query("SELECT n_name AS name, n_regionkey AS region FROM nation")
def envelope_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a script document ``window.NAME = {...};``."""
    path = scratch(spark, "script")
    body = F.to_json(F.struct(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))).alias("rows")))
    table(spark, sf_dir, "nation").agg(body.alias("j")).select(F.concat(F.lit("window.BOARD = "), "j", F.lit(";"))).coalesce(1).write.text(path)
    return snapshots.envelope(spark, path, "rows array<struct<name: string, region: long>>").select(F.explode("rows").alias("r")).select("r.*")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, '2024-05-0' || (n_nationkey % 9 + 1) AS day, n_name AS home FROM nation")
def fixture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of fixtures in which some come twice; a civil day ends at three UTC."""
    path, k = scratch(spark, "fixtures"), F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.cast("string").alias("sofa_id"), F.col("n_name").alias("home"), F.concat(F.lit("2024-05-0"), k % 9 + 1, F.lit("T"), F.when(k % 2 == 0, "03:00:00Z").otherwise("23:00:00Z")).alias("start_utc"))
    rows.union(rows).agg(F.collect_list(F.struct(*rows.columns)).alias("fixtures")).coalesce(1).write.json(path)
    return snapshots.fixtures(spark, path).select(F.col("sofa_id").alias("id"), F.col("day").cast("string").alias("day"), "home")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 3 > 0 THEN (n_nationkey % 11)::DOUBLE END AS corners, 0 AS manual FROM nation
  UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 4 > 1 THEN (s_suppkey % 12)::DOUBLE END, 1 FROM supplier""")
def results_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic results in JSON and manual ones in CSV; what is no number is null."""
    path, n, s = scratch(spark, "results"), F.col("n_nationkey"), F.col("s_suppkey")
    auto = table(spark, sf_dir, "nation").select(n.cast("string").alias("id"), F.when(n % 3 > 0, (n % 11).cast("string")).otherwise("").alias("corners"))
    auto.agg(F.to_json(F.collect_list(F.struct("id", "corners")))).coalesce(1).write.text(f"{path}/auto")
    hand = table(spark, sf_dir, "supplier").select(s.cast("string").alias("id"), F.when(s % 4 == 0, "n/a").when(s % 4 > 1, (s % 12).cast("string")).alias("corners"))
    hand.write.option("header", True).csv(f"{path}/hand")
    return snapshots.results(spark, f"{path}/auto", f"{path}/hand", ["corners"]).select("id", "corners", F.col("manual").cast("int").alias("manual"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def month_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months written once, then again with new values of some keys: the other keys stay."""
    path, k = scratch(spark, "months"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("kickoff"))
    sinks.upsert_months(rows, path, keys=["id"])
    sinks.upsert_months(rows.where("id % 3 = 0").withColumn("price", F.col("price") + 1), path, keys=["id"])
    return spark.read.option("partitionColumnTypeInference.enabled", False).parquet(path).select("id", "price", F.date_format("kickoff", "yyyy-MM").alias("month"))


@query("SELECT c_custkey AS id, c_name AS name, (SELECT count(*) FROM customer) AS n, false AS stale, 1.5::DOUBLE AS age_hours FROM customer")
def publish_and_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generation and its pointer, and the rows that the pointer names; a close generation leaves the pointer of the full one alone."""
    folder = scratch(spark, "published")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    sinks.publish(rows, f"{folder}/gens", f"{folder}/latest.json", ["id", "name"], "2024-02-01T10:30:00Z")
    sinks.publish(rows.where("id = 1"), f"{folder}/gens", f"{folder}/latest.json", ["id", "name"], "2024-02-01T11:30:00Z", mode="close")
    found = snapshots.pointer(spark, f"{folder}/latest.json", NOON)
    return spark.read.schema("id long, name string").json(found["file"]).select("id", "name", F.lit(found["n"]).alias("n"), F.lit(found["stale"]).alias("stale"), F.lit(found["age_hours"]).alias("age_hours"))
