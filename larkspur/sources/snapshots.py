"""Readers: normalized snapshots, pointers, fixtures, results, tick and run logs, script envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.times import civil_date, parse_instant
from larkspur.sources import sinks

#: Hours after which a full snapshot counts as stale.
STALE_HOURS = 2.0

_LINE = T.StructType([T.StructField("linha", T.DoubleType()), T.StructField("over", T.DoubleType()), T.StructField("under", T.DoubleType()), T.StructField("market_type_id", T.StringType()), T.StructField("market_type_name", T.StringType()), T.StructField("scope", T.StringType())])
SNAPSHOT = T.StructType([
    T.StructField("casa", T.StringType()), T.StructField("event_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("league", T.StringType()),
    T.StructField("start", T.StringType()), T.StructField("captured_at", T.StringType()),
    T.StructField("mercados", T.MapType(T.StringType(), T.ArrayType(_LINE))), T.StructField("mercados_time", T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(_LINE)))),
    T.StructField("_corrupt", T.StringType()),
])


def snapshot(spark: SparkSession, path: str | list[str], stale: bool = False) -> DataFrame:
    """House events with any market; malformed lines are left out, stale tags the whole snapshot."""
    rows = spark.read.schema(SNAPSHOT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    some = (F.coalesce(F.size("mercados"), F.lit(0)) > 0) | (F.coalesce(F.size("mercados_time"), F.lit(0)) > 0)
    return rows.where(F.col("_corrupt").isNull() & some).drop("_corrupt").withColumns({"stale": F.lit(stale), "kickoff": parse_instant(F.col("start")), "captured": parse_instant(F.col("captured_at"))})


def valid_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines that are objects, and all lines. The two are equal in a sound snapshot."""
    text = spark.read.text(path).where(F.trim("value") != "")
    return text.agg(F.count_if(F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")).alias("objects"), F.count("*").alias("lines"))


def ladder_lines(events: DataFrame) -> DataFrame:
    """Match lines, one row a line: house, event, market, line, over, under, position; the first of a line wins later."""
    each = events.select("casa", "event_id", "name", "league", "kickoff", "captured", "stale", F.explode("mercados").alias("market", "rows"))
    return each.select("*", F.posexplode("rows").alias("pos", "r")).select("casa", "event_id", "name", "league", "kickoff", "captured", "stale", "market", "pos", F.col("r.linha").alias("line"), "r.over", "r.under", "r.market_type_id", "r.market_type_name", "r.scope")


def team_lines(events: DataFrame) -> DataFrame:
    """Team totals, with the team."""
    each = events.select("casa", "event_id", "kickoff", F.explode("mercados_time").alias("market", "teams")).select("casa", "event_id", "kickoff", "market", F.explode("teams").alias("team", "rows"))
    return each.select("casa", "event_id", "kickoff", "market", "team", F.posexplode("rows").alias("pos", "r")).select("casa", "event_id", "kickoff", "market", "team", "pos", F.col("r.linha").alias("line"), "r.over", "r.under")


def pointer(spark: SparkSession, path: str, now: str, most_hours: float = STALE_HOURS) -> dict:
    """A pointer file with its age in hours and whether its target is stale."""
    row = spark.read.option("multiLine", True).json(path)
    at = parse_instant(F.col("at").cast("string"), "-03:00")
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at)) / 3.6e9)
    close = (F.col("mode") == "close") if "mode" in row.columns else F.lit(False)
    late = F.coalesce(age > most_hours, F.lit(True))
    found = row.select("file", F.col("n").cast("long").alias("n"), age.alias("age_hours"), (F.coalesce(close, F.lit(False)) | late).alias("stale"))
    return found.first().asDict()


def resolve(spark: SparkSession, path: str, now: str, most_hours: float | None = None, prefer_full: bool = True) -> dict | None:
    """The first sound pointer: the full one if preferred, then the latest of any kind; null if neither is.

    A pointer is sound if its target is there and holds as many whole lines as it says, more than none. With most_hours it must
    also have a time that reads, at most so long ago. ``stale`` says that a preferred full one was not found or is over two hours old.
    """
    names = sinks.pointers(path)
    for kind in (["full"] if prefer_full else []) + ["any"]:
        body = sinks._body(spark, names[kind])
        target = body.get("file")
        if not target or not sinks._exists(spark, target):
            continue
        held = valid_lines(spark, target).first()
        if held["objects"] != held["lines"] or held["objects"] != body.get("n") or not held["objects"]:
            continue
        at, moment = parse_instant(F.lit(str(body.get("at"))), "-03:00"), F.lit(now).cast("timestamp")
        hours = F.greatest(F.lit(0.0), (F.unix_micros(moment) - F.unix_micros(at)) / 3.6e9)
        age = spark.range(1).select(F.when(at.isNotNull(), hours).alias("age")).first()["age"]
        if most_hours is not None and (age is None or age > most_hours):
            continue
        stale = prefer_full and (kind == "any" or body.get("mode") == "close" or (age is not None and age > STALE_HOURS))
        return {**body, "pointer": kind, "age_hours": age, "stale": stale}
    return None


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """The fixture dimension of one JSON document with a list ``fixtures``; a fixture comes once."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("fixtures").alias("f")).select("f.*")
    return rows.dropDuplicates(["sofa_id"]).withColumns({"kickoff": parse_instant(F.col("start_utc")), "day": civil_date(parse_instant(F.col("start_utc")))})


def results(spark: SparkSession, json_path: str, csv_path: str, fields: list[str]) -> DataFrame:
    """Automatic and manual results; numbers that do not read are null, manual ones come with rank 1."""
    auto = spark.read.option("multiLine", True).json(json_path).withColumn("manual", F.lit(0))
    hand = spark.read.option("header", True).csv(csv_path).withColumn("manual", F.lit(1))
    rows = auto.select(*[F.col(c).cast("string") if c != "manual" else c for c in auto.columns]).unionByName(hand, allowMissingColumns=True)
    return rows.withColumns({f: (F.col(f) if f in rows.columns else F.lit(None)).try_cast("double") for f in fields})


def tick_log(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Ticks below path, partitioned by date; malformed lines are skipped, days before since are not read."""
    schema = "ts string, kind string, casa string, kickoff string, home string, away string, mercado string, linha double, lado string, odd double, sofa_id string, djogo string, gid string, linha_from double, linha_to double, date date"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("date") >= since) if since else rows


def run_log(spark: SparkSession, path: str, since: str) -> DataFrame:
    """Runs since a time, one row a house: run, house, ok, n."""
    schema = "ts string, casas map<string, struct<ok: boolean, n: long, n_markets: long>>, total long"
    rows = spark.read.schema(schema).json(path).withColumn("at", parse_instant(F.col("ts"), "-03:00")).where(F.col("at") >= F.lit(since).cast("timestamp"))
    return rows.select("at", F.explode("casas").alias("house", "s")).select("at", "house", "s.ok", "s.n", "s.n_markets")


def envelope(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The object of a ``window.NAME = {...};`` file."""
    text = spark.read.option("wholetext", True).text(path)
    body = F.regexp_extract("value", r"(?s)^\s*window\.\w+\s*=\s*(\{.*\})\s*;?\s*$", 1)
    return text.select(F.from_json(body, schema).alias("d")).select("d.*")


def month_keys(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of every month's files, with their month; keys that begin with two underscores are notes, and lines that do not read are left out."""
    rows = spark.read.schema(f"{schema}, month string").option("mode", "DROPMALFORMED").option("partitionColumnTypeInference.enabled", False).json(path)
    return rows.where(F.col("key").isNotNull() & ~F.col("key").startswith("__"))


def calibration(spark: SparkSession, path: str, competitions: list[str], stat: str, lines: bool = False) -> DataFrame:
    """(competition, date, match_id, home, away, h, a) of matches of some competitions that have a date and both sides of a statistic.

    A file is one document, or with lines one on each line.
    """
    side = f"{stat}: struct<h: double, a: double>"
    schema = f"array<struct<competition: string, date: string, match_id: long, home: struct<id: long>, away: struct<id: long>, stats: struct<{side}>>>"
    m = spark.read.schema(f"matches {schema}").option("multiLine", not lines).json(path).select(F.explode("matches").alias("m"))
    rows = m.select("m.competition", "m.date", F.coalesce("m.match_id", F.lit(0)).alias("match_id"), F.col("m.home.id").alias("home"), F.col("m.away.id").alias("away"), F.col(f"m.stats.{stat}.h").alias("h"), F.col(f"m.stats.{stat}.a").alias("a"))
    return rows.where(F.col("competition").isin(competitions) & (F.coalesce("date", F.lit("")) != "") & F.col("h").isNotNull() & F.col("a").isNotNull())
