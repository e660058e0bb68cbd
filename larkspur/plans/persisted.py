"""Queries of state that lives in files: publications, commits, merged batches, repeated settlement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import settlement
from larkspur.plans.events import E, observed
from larkspur.plans.registry import query, scratch, table
from larkspur.sources import sinks, snapshots
from larkspur.streaming import merge

NOON = "2024-02-01 12:00:00"
_SEGMENT = "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer"


@query(f"""SELECT 'full' AS step, id, 'full' AS pointer, false AS stale, 0 AS blocked FROM ({_SEGMENT})
  UNION ALL SELECT 'collapsed', id, 'full', false, (SELECT count(*) FROM (SELECT segment FROM ({_SEGMENT}) WHERE segment < 'F' GROUP BY segment HAVING count(*) >= 8)) FROM ({_SEGMENT})
  UNION ALL SELECT 'truncated', id, 'any', true, 0 FROM ({_SEGMENT}) WHERE id % 2 = 0""")
def publish_by_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers find after a full publication and two close ones, after one whose markets collapsed, and after the full target was cut off."""
    folder = scratch(spark, "published")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    put = lambda part, at, mode="full": sinks.publish(part, f"{folder}/gens", f"{folder}/latest.json", ["id", "segment"], f"2024-02-01T{at}:00Z", mode, 1, "segment")
    read = lambda step, body, blocked: spark.read.schema("id long").json(body["file"]).select(F.lit(step).alias("step"), "id", F.lit(body["pointer"]).alias("pointer"), F.lit(body["stale"]).alias("stale"), F.lit(blocked).alias("blocked"))
    find = lambda: snapshots.resolve(spark, f"{folder}/latest.json", NOON)
    put(rows, "10:30")
    put(rows.where("id % 2 = 0"), "10:40", "close")
    put(rows.where("id % 3 = 0"), "10:50", "close")
    out = read("full", find(), 0)
    body = put(rows.where("segment >= 'F'"), "11:00")
    out = out.unionByName(read("collapsed", find(), len(body["promotion_blocked"])))
    put(rows.where("id % 2 = 0"), "11:10", "close")
    # a pointer that promises more lines than its target holds is passed over
    sinks.put_text(spark, f"{folder}/latest.json", sinks.read_text(spark, f"{folder}/latest.json").replace('"n": ', '"n": 9'))
    return out.unionByName(read("truncated", find(), 0))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'base' END AS writer, 3::BIGINT AS version FROM orders")
def persist_conflict_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers that start from one version: the slower one ingests again into what the other one committed."""
    folder = scratch(spark, "commits")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("base").alias("writer"))
    sinks.persist(spark, folder, lambda base: rows)
    marked = lambda base, rest, name: base.withColumn("writer", F.when(F.col("id") % 3 == rest, name).otherwise(F.col("writer")))
    overtaken: list[int] = []

    def slow(base: DataFrame) -> DataFrame:
        if not overtaken:
            overtaken.append(sinks.persist(spark, folder, lambda now: marked(now, 1, "second")))
        return marked(base, 0, "first")

    version = sinks.persist(spark, folder, slow)
    return sinks.committed(spark, folder).select("id", "writer", F.lit(version).cast("long").alias("version"))


_SEEN = f"SELECT game, house, ts, max(odd) AS odd FROM ({E}) GROUP BY ALL"


@query(f"""SELECT game, house, arg_min(odd, ts) AS open_odd, arg_max(odd, ts) AS last_odd, max(odd) AS max_odd, min(odd) AS min_odd, count(*) AS n_obs, count(*) FILTER (abs(odd - prev) >= 0.01 - 1e-9) AS n_moves
  FROM (SELECT *, lag(odd) OVER (PARTITION BY game, house ORDER BY ts) AS prev FROM ({_SEEN})) GROUP BY ALL""")
def merge_late_and_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records merged from four batches: rows out of order, a third of them in two batches, and one batch delivered twice."""
    folder = scratch(spark, "merged")
    rows = observed(spark, sf_dir).select("id", "game", "house", F.col("ts").cast("timestamp").alias("ts"), "odd")
    part = F.pmod(F.floor(F.unix_micros("ts") / 9e11) + F.when(F.col("id") % 10 == 0, 1).otherwise(0), F.lit(4))
    parts = rows.withColumn("part", part)
    spread = parts.unionByName(parts.where("id % 3 = 0").withColumn("part", F.pmod(F.col("part") + 1, F.lit(4))))
    spread.write.partitionBy("part").parquet(f"{folder}/parts")
    for batch in (0, 1, 2, 2, 3):
        got = spark.read.schema(rows.schema).parquet(f"{folder}/parts/part={batch}")
        merge.merge_batch(got.select("game", "house", "ts", "odd"), batch, f"{folder}/state", "game long, house string")
    return merge.records(spark, f"{folder}/state", "game long, house string").select("game", "house", "open_odd", "last_odd", "max_odd", "min_odd", "n_obs", "n_moves")


#: Hours at which settlement runs.
RUNS = [0, 2, 5, 7, 13, 14, 20]
_RUN = "[" + ", ".join(map(str, RUNS)) + "][k + 1]"
_WHY = "CASE WHEN id % 4 = 0 AND k >= 3 THEN 'postponed' ELSE 'missing_result' END"
_DUE = f"(status <> 'pending_result' OR reason IS DISTINCT FROM {_WHY} OR {_RUN} - last_run >= 6)"


@query(f"""WITH RECURSIVE s AS (
  SELECT o_orderkey AS id, -1 AS k, CASE o_orderkey % 8 WHEN 0 THEN 'open' WHEN 1 THEN 'unavailable' ELSE 'closed' END AS status, NULL::DOUBLE AS result, NULL::VARCHAR AS reason, NULL::INT AS last_run, 0 AS attempts FROM orders
  UNION ALL
  SELECT id, k, CASE WHEN NOT tried THEN status WHEN known THEN 'settled' ELSE 'pending_result' END, CASE WHEN tried AND known THEN id % 11 ELSE result END,
    CASE WHEN NOT tried THEN reason WHEN known THEN NULL ELSE {_WHY} END, CASE WHEN tried AND (known OR {_DUE}) THEN {_RUN} ELSE last_run END, attempts + CASE WHEN tried AND (known OR {_DUE}) THEN 1 ELSE 0 END
  FROM (SELECT *, status IN ('closed', 'pending_result') OR (status = 'unavailable' AND id % 16 = 1) AS tried, k >= id % 13 AS known FROM (SELECT * REPLACE (k + 1 AS k) FROM s WHERE k < {len(RUNS) - 1}))
)
SELECT id, status, result, reason, last_run AS last_hour, attempts FROM s WHERE k = {len(RUNS) - 1}""")
def settle_with_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after seven runs of settlement, each committed before the next: results come late, reasons change, repeated failures are throttled."""
    folder, i = scratch(spark, "settled"), F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(i.alias("id"))
    status = F.when(F.col("id") % 8 == 0, "open").when(F.col("id") % 8 == 1, "unavailable").otherwise("closed")
    begun = orders.select(
        "id", status.alias("status"), F.lit(None).cast("double").alias("result"), F.lit(None).cast("string").alias("reason"),
        F.when(F.col("id") % 8 == 1, F.col("id") % 16 == 1).alias("retryable"), F.lit(None).cast("timestamp").alias("last_attempt"), F.lit(0).alias("attempts"))
    start = F.lit("2024-02-01 00:00:00").cast("timestamp")
    sinks.persist(spark, folder, lambda base: begun)
    for k, hour in enumerate(RUNS):
        found = orders.select("id", F.when(F.col("id") % 13 <= k, (F.col("id") % 11).cast("double")).alias("found"), F.when((F.col("id") % 4 == 0) & F.lit(k >= 3), "postponed").otherwise("missing_result").alias("why"))
        now = start + F.expr(f"INTERVAL {hour} HOURS")
        sinks.persist(spark, folder, lambda base: settlement.attempt(base, found, "id", now))  # noqa: B023
    hours = ((F.unix_timestamp("last_attempt") - F.unix_timestamp(start)) / 3600).cast("int")
    return sinks.committed(spark, folder).select("id", "status", "result", "reason", hours.alias("last_hour"), "attempts")
