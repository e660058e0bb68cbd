"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from larkspur.plans.events import E, T, timed
from larkspur.plans.registry import query, scratch
from larkspur.streaming import keyed, ticks


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/events.parquet")
    # a stream reads a folder: the table's own, or the one that holds its only file
    alone = all(f.endswith("/events.parquet") for f in known.inputFiles())
    source = spark.readStream.schema(known.schema)
    rows = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if alone else source.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("event_id").alias("id"), F.col("user_id").alias("game"), F.col("event_type").alias("house"), F.col("ts").cast("timestamp").alias("ts"), F.round(1.02 + F.col("value") / 100 + 1e-7, 2).alias("odd"))


@query(f"""SELECT * FROM (SELECT id, game, house, odd, lag(odd) OVER w AS previous, CASE WHEN lag(odd) OVER w IS NULL THEN 'open' WHEN abs(odd - lag(odd) OVER w) >= 0.01 - 1e-9 THEN 'price' END AS kind
  FROM ({E}) WINDOW w AS (PARTITION BY game, house ORDER BY ts, id)) WHERE kind IS NOT NULL""")
def stream_ticks_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.price_ticks(_stream(spark, sf_dir), scratch(spark, "stream")).select("id", "game", "house", "odd", "previous", "kind")


#: Rows come up to five hours late and in seven parts, one a micro-batch; the watermark waits six.
LATE, PARTS = "6 hours", 7
_LATE_E = f"SELECT * FROM ({T}) WHERE ts IS NOT NULL"
_ALIVE = "coalesce(ts < kickoff - INTERVAL 2 MINUTE, true)"
_MARK = "(SELECT max(ts) - INTERVAL 6 HOUR FROM events)"


def _after_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of the observations of a game with its kickoff writes, whose parts come in the order of arrival, not of time."""
    folder, state = scratch(spark, "parts"), scratch(spark, "keyed")
    rows = timed(spark, sf_dir).where("ts IS NOT NULL").select("id", "game", "house", F.col("ts").cast("timestamp").alias("ts"), "odd", F.when(F.col("game") % 5 > 0, F.col("kickoff").cast("timestamp")).alias("kickoff"))
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("id"), F.lit(5 * 3600)) * 1_000_000
    bounds = rows.agg(F.min(arrival).alias("a"), F.max(arrival).alias("b")).first()
    width = max(1, ((bounds.b or 0) - (bounds.a or 0)) // PARTS + 1)
    rows.withColumn("part", ((arrival - (bounds.a or 0)) / width).cast("int")).write.partitionBy("part").parquet(f"{folder}/staged")
    staged = spark.read.schema(StructType([*rows.schema, StructField("part", IntegerType())])).parquet(f"{folder}/staged")
    for part in range(PARTS):  # each is one micro-batch of as many files as it has, and the stream goes on from where it stopped
        staged.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
        out = keyed.run(keyed.instruments(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), LATE), state, ended=part == PARTS - 1)
    return out


_SIGHTED = f"SELECT game, house, id, ts, odd, CASE WHEN game % 5 > 0 THEN kickoff END AS kickoff FROM ({T})"


@query(f"""SELECT *, CASE WHEN closed THEN last_odd END AS close_odd FROM (SELECT game, house, arg_min(odd, (ts, id)) FILTER (alive) AS open_odd, min(ts) FILTER (alive) AS open_ts, arg_max(odd, (ts, id)) FILTER (alive) AS last_odd,
  max(ts) FILTER (alive) AS last_ts, max(odd) FILTER (alive) AS max_odd, min(odd) FILTER (alive) AS min_odd, count(*) AS n_obs, count(*) FILTER (alive AND abs(odd - prev) >= 0.01 - 1e-9) AS n_moves,
  coalesce(any_value(kickoff) - INTERVAL 2 MINUTE <= {_MARK}, false) AS closed
  FROM (SELECT *, lag(odd) OVER (PARTITION BY game, house, alive ORDER BY ts, id) AS prev FROM (SELECT *, {_ALIVE} AS alive FROM ({_SIGHTED}))) GROUP BY game, house)""")
def stream_state_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after seven micro-batches whose rows come out of order; lines close by timers, without a row of their own."""
    out = _after_parts(spark, sf_dir)
    stamps = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("open_ts", "last_ts")]
    return keyed.latest(out).select("game", "house", "open_odd", "last_odd", "max_odd", "min_odd", "n_obs", "n_moves", "closed", "close_odd", *stamps)


@query(f"""SELECT id, game, house, odd, previous, kind FROM (SELECT *, lag(odd) OVER w AS previous, CASE WHEN lag(odd) OVER w IS NULL THEN 'open' WHEN abs(odd - lag(odd) OVER w) >= 0.01 - 1e-9 THEN 'price' END AS kind
  FROM ({_SIGHTED}) WHERE {_ALIVE} WINDOW w AS (PARTITION BY game, house ORDER BY ts, id)) WHERE kind IS NOT NULL AND ts < date_trunc('millisecond', {_MARK})""")
def stream_ticks_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks in the order of time, each as soon as the watermark makes it final."""
    return keyed.final_ticks(_after_parts(spark, sf_dir)).select("id", "game", "house", "odd", "previous", "kind")
