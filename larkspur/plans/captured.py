"""Queries of what houses send and what is published: nested dictionaries, tabs, guards, files and their manifest, parameters in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.boards import dealt, dealt_sql
from larkspur.plans.ledger import B, ledger
from larkspur.plans.registry import query, scratch, table
from larkspur.sources import artifacts, captures, nested, pages, sinks, tabs

_PEOPLE = "customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey"


@query(f"""SELECT id, name, depth, count(*) AS n FROM (SELECT c_custkey AS k, unnest([{{'id': CAST(r_regionkey + 1 AS VARCHAR), 'name': 'R ' || r_name, 'depth': 2}}, {{'id': CAST(100 + n_nationkey AS VARCHAR), 'name': CASE WHEN n_nationkey % 2 = 0 THEN 'en ' || n_name ELSE 'fr ' || n_name END, 'depth': 4}},
  {{'id': CAST(10000 + c_custkey AS VARCHAR), 'name': CASE WHEN c_custkey % 3 = 0 THEN 'again' ELSE c_name END, 'depth': CASE WHEN c_custkey % 3 = 0 THEN 8 ELSE 6 END}}], recursive := true) FROM {_PEOPLE}) GROUP BY ALL""")
def nested_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of ids at any depth of a document; a null name and an id of 0 say nothing, a later name counts."""
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    person = F.struct((F.col("c_custkey") + 10000).alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.struct((F.col("c_custkey") + 10000).alias("id"), F.lit("again").alias("name")))).alias("more"))
    local = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("en"), F.concat(F.lit("en "), "n_name"), F.lit("fr"), F.lit("x"))).otherwise(F.create_map(F.lit("fr"), F.concat(F.lit("fr "), "n_name")))
    nation = F.struct((F.col("n_nationkey") + 100).alias("id"), local.alias("localNames"), F.array(person, F.struct(F.lit(0).cast("bigint").alias("id"), F.lit("none").alias("name"), F.lit(None).cast("array<struct<id: bigint, name: string>>").alias("more"))).alias("people"))
    region = F.struct((F.col("r_regionkey") + 1).alias("id"), F.create_map(F.lit("pt-BR"), F.concat(F.lit("R "), "r_name"), F.lit("en"), F.lit("y")).alias("localNames"), F.array(nation).alias("nations"))
    docs = people.select(F.col("c_custkey").alias("k"), F.to_json(F.struct(F.array(region).alias("data"))).alias("j"))
    return nested.dictionary(docs, "k", "j").groupBy("id", "name", "depth").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS key, list_position(v, x) - 1 AS pos, CAST(x AS VARCHAR) AS value FROM (SELECT o_orderkey, v, unnest(v) AS x FROM (SELECT o_orderkey, [o_orderkey * 3, o_orderkey * 3 + 1, o_orderkey * 3 + 2] AS v FROM orders))")
def nested_ids_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids out of lists in lists, nulls left out."""
    k = F.col("o_orderkey") * 3
    text = F.concat(F.lit("["), k, F.lit(", [null, "), k + 1, F.lit(", []], [["), k + 2, F.lit("]], null]"))
    return nested.flat_values(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("j")), "o_orderkey", "j").select("key", F.col("pos").cast("long").alias("pos"), "value")


HOUSES = ["h0", "h1", "h2", "h3", "h4"]


@query("""SELECT house, n_data >= 3 AS ok, n_data AS n_events, n AS n_fetched, 'full' AS mode, CASE WHEN n >= 5 AND n_data = 0 THEN 'parse: none of ' || n || ' games fetched holds data; has the format changed?' END AS error,
  CASE WHEN n >= 5 AND n_data = 0 THEN 'Parse' END AS error_class, CASE WHEN n_data >= 3 THEN 0 ELSE 2 END AS exit_code
  FROM (SELECT 'h' || event_id % 5 AS house, count(*) AS n, count(*) FILTER (event_id % 5 <> 3 AND (event_id % 5 <> 4 OR event_id < 10)) AS n_data FROM events GROUP BY 1)""")
def capture_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each house from counts that its write took; one house's feed holds nothing that reads, another's hardly anything."""
    i, path = F.col("event_id"), scratch(spark, "captured")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("h"), i % 5).alias("house"), F.when((i % 5 != 3) & ((i % 5 != 4) | (i < 10)), F.col("value")).alias("value"))
    seen = captures.observed(rows, lambda d: d.write.json(path), "house", HOUSES, F.col("value").isNotNull())
    return captures.finished(spark, seen, 3)


@query("""SELECT 'manifest_hash' AS gate, CAST(n AS VARCHAR) AS subject, CASE n % 5 WHEN 1 THEN 'changed' WHEN 2 THEN 'absent' ELSE 'extra' END AS reason FROM (SELECT DISTINCT c_nationkey AS n FROM customer) WHERE n % 5 IN (1, 2, 3)
  UNION ALL SELECT 'manifest_hash', 'manifest.json', 'old'""")
def gate_artifact_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of customers by nation, published together; then some change, some go, some come."""
    folder = scratch(spark, "artifacts")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.to_json(F.struct("c_custkey", "c_name")).alias("value"))
    put = lambda part: part.repartition("nation").write.mode("append").partitionBy("nation").text(folder)
    put(rows.where("nation % 5 != 3"))
    artifacts.publish_manifest(spark, folder, "2024-02-01T04:00:00Z")
    put(rows.where("nation % 5 = 3"))
    for r in artifacts.scanned(spark, folder).where(F.regexp_extract("name", r"nation=(\d+)", 1).cast("int") % 5 < 3).select("name", (F.regexp_extract("name", r"nation=(\d+)", 1).cast("int") % 5).alias("rest")).collect():
        if r["rest"] == 1:
            sinks.put_text(spark, f"{folder}/{r['name']}", "other bytes")
        elif r["rest"] == 2:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['name']}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    found = artifacts.incoherent(spark, folder, "2024-02-01 12:00:00")
    return found.withColumn("subject", F.coalesce(F.nullif(F.regexp_extract("subject", r"nation=(\d+)", 1), F.lit("")), F.col("subject"))).distinct()


@query("""SELECT page_id, t AS team, league, page_id % 50 / 10 + t AS for_home, (page_id + t) % 7 / 4 AS for_away, 1 + page_id % 9 / 8 AS phi, page_id % 13 - 0.25 AS ybar, CAST(page_id % 4 AS BIGINT) AS lg
  FROM (SELECT page_id, unnest([1, 2, 3]) AS t, CASE WHEN page_id % 2 = 0 THEN 'PL' ELSE 'BR' END AS league FROM pages)""")
def page_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that stand among the scripts of a page: a table, an object and a number after a phrase."""
    k = F.col("page_id")
    league = F.when(k % 2 == 0, "PL").otherwise("BR")
    line = lambda t: F.concat_ws("\t", league, F.lit(str(t)), F.lit("Team, no number"), (k % 50 / 10 + t).cast("string"), ((k + t) % 7 / 4).cast("string"))
    script = F.concat(F.lit("<script>const T_DATA=`"), F.concat_ws("\n", *[line(t) for t in (1, 2, 3)]), F.lit("`;\nconst LG = {\"PL\": {\"y\": "), k % 4, F.lit("}, \"BR\": {\"y\": "), k % 4, F.lit("}};\nlet z = {};window._distPhi="), 1 + k % 9 / 8, F.lit(", calibDist = x; CAL = {y:"), k % 13 - 0.25, F.lit(", b:1}</script>"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), script).alias("html"))
    told = rows.select("page_id", "html", pages.number_after(F.col("html"), "window._distPhi=").alias("phi"), pages.number_after(F.col("html"), "CAL = {y:").alias("ybar"), pages.object_after(F.col("html"), "LG", "PL struct<y: long>")["PL"]["y"].alias("lg"))
    return pages.table_rows(told, "html", "T_DATA", [(0, "league", "string"), (1, "team", "int"), (3, "for_home", "double"), (4, "for_away", "double")], ["page_id", "phi", "ybar", "lg"])


RAW = ["Total de Cartões", "Total de Faltas", "Harbour FC Total de chutes", "Escanteios", "Chutes no gol", "Total de Gols", "Quarry Total de Escanteios", "Total de laterais"]
#: Complete pairs of a game's tabs: tab, place in it, name, line and prices.
_TABBED = f"""SELECT game, tab, row_number() OVER (PARTITION BY game, tab ORDER BY id) AS pos, {dealt_sql(RAW, 'id // 4')} AS raw, line, odd AS "over", odd + 0.123 AS "under" FROM (SELECT *, CAST(id % 4 AS INTEGER) AS tab FROM ({B})) WHERE id % 9 > 0"""
_CANON = "CASE raw " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tabs.MATCH_MARKETS.items()) + " END"
_TEAM = "CASE raw WHEN 'Harbour FC Total de chutes' THEN 'Finalizações' WHEN 'Quarry Total de Escanteios' THEN 'Escanteios' END"


def _tabbed(spark: SparkSession, sf_dir: str) -> str:
    path, i = scratch(spark, "tabs"), F.col("id")
    rows = ledger(spark, sf_dir).select("game", (i % 4).cast("int").alias("tab"), F.struct("id", dealt(RAW, F.floor(i / 4)).alias("market"), "line", F.col("odd").alias("over"), F.when(i % 9 > 0, F.col("odd") + 0.123).alias("under")).alias("r"))
    games = rows.groupBy("game", "tab").agg(F.sort_array(F.collect_list("r")).alias("rows")).groupBy("game").agg(*[F.first(F.when(F.col("tab") == k, F.col("rows")), True).alias(t) for k, t in enumerate(tabs.TABS)])
    name = F.concat(F.lit("home "), "game", F.when(F.col("game") % 3 == 0, " vs ").when(F.col("game") % 3 == 1, " vs. ").otherwise(" - "), F.lit("away "), "game")
    games.select(F.col("game").cast("string").alias("event_id"), name.alias("name"), F.struct(*tabs.TABS).alias("markets")).write.json(path)
    return path


@query(f"""SELECT CAST(game AS VARCHAR) AS event_id, market, team, line, round(arg_min("over", (tab, pos)), 2) AS "over", round(arg_min("under", (tab, pos)), 2) AS "under"
  FROM (SELECT *, coalesce({_CANON}, {_TEAM}) AS market, CASE WHEN {_CANON} IS NULL THEN CASE raw WHEN 'Harbour FC Total de chutes' THEN 'Harbour FC' ELSE 'Quarry' END END AS team FROM ({_TABBED})) WHERE market IS NOT NULL GROUP BY game, market, team, line""")
def tabbed_board_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board's lines of a snapshot in tabs: match and team lines, the first of a line."""
    return tabs.board_lines(spark, _tabbed(spark, sf_dir))


@query(f"""SELECT CAST(game AS VARCHAR) AS event_id, 'home ' || game AS home, 'away ' || game AS away, market, line, arg_max("over", (tab, pos)) AS "over", arg_max("under", (tab, pos)) AS "under" FROM (SELECT *, {_CANON} AS market FROM ({_TABBED})) WHERE market IS NOT NULL GROUP BY game, market, line""")
def tabbed_history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history's lines of the same snapshot: match lines alone, the last of a line, the teams' names apart."""
    return tabs.history_lines(spark, _tabbed(spark, sf_dir))
