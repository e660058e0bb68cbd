"""Batches of observations merged into records: late, repeated and redelivered rows change nothing that they should not.

Every batch writes below its own number, so a batch that is run again replaces what it wrote. An observation (key, time) counts once,
whatever batch brings it again. A key whose new rows are all later than its record is merged with it; only keys with late rows are
folded again from the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.history import MOVE, fold

RECORD = "open_odd double, open_ts timestamp, last_odd double, last_ts timestamp, max_odd double, min_odd double, n_obs long, n_moves long"
_NAMES = [f.split()[0] for f in RECORD.split(", ")]


def _read(spark: SparkSession, path: str, schema: str, before: int | None) -> DataFrame:
    """What batches below a number wrote; nothing before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.range(0).select(*[F.lit(None).cast(f.split(" ", 1)[1]).alias(f.split(" ", 1)[0]) for f in f"{schema}, batch long".split(", ")])
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def records(spark: SparkSession, folder: str, keys: str, before: int | None = None) -> DataFrame:
    """The newest record of each key; keys is the schema of the key."""
    names = [k.split()[0] for k in keys.split(", ")]
    rows = _read(spark, f"{folder}/records", f"{keys}, {RECORD}", before)
    return rows.groupBy(*names).agg(F.max_by(F.struct(*_NAMES), "batch").alias("r")).select(*names, "r.*")


def merge_batch(rows: DataFrame, batch: int, folder: str, keys: str) -> None:
    """Merge rows(key, ts, odd) as batch number ``batch`` into the log and the records below folder; of one key and time the highest odd counts."""
    spark, names = rows.sparkSession, [k.split()[0] for k in keys.split(", ")]
    # a batch keeps its session's time zone, so days of the log are those of that zone
    new = rows.where("ts IS NOT NULL AND odd IS NOT NULL").groupBy(*names, "ts").agg(F.max("odd").alias("odd")).withColumn("day", F.to_date("ts"))
    schema = f"{keys}, ts timestamp, odd double, day date"
    held = _read(spark, f"{folder}/log", schema, batch)
    same = [*[new[c].eqNullSafe(held[c]) for c in names], new["ts"] == held["ts"], new["day"] == held["day"]]
    condition = same[-1]
    for c in same[:-1]:
        condition &= c
    new.join(held, condition, "left_anti").write.mode("overwrite").partitionBy("day").parquet(f"{folder}/log/batch={batch}")
    log = _read(spark, f"{folder}/log", schema, batch + 1)
    fresh = _folded(log.where(F.col("batch") == batch), names)
    known = records(spark, folder, keys, batch)
    both = fresh.select(*names, F.struct(*_NAMES).alias("f")).join(known.select(*[F.col(c).alias(f"_{c}") for c in names], F.struct(*_NAMES).alias("r")), _equal(names), "left").drop(*[f"_{c}" for c in names])
    late = F.coalesce(F.col("r.last_ts") >= F.col("f.open_ts"), F.lit(False))
    merged = both.where(~late).select(*names, *_after())
    again = both.where(late).select(*[F.col(c).alias(f"_{c}") for c in names])
    refolded = _folded(log.join(again, _equal(names), "left_semi"), names)
    merged.unionByName(refolded).write.mode("overwrite").parquet(f"{folder}/records/batch={batch}")


def _equal(names: list[str]) -> Column:
    condition = F.lit(True)
    for c in names:
        condition &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return condition


def _folded(rows: DataFrame, names: list[str]) -> DataFrame:
    return fold(rows.withColumn("kickoff", F.lit(None).cast("timestamp")), names).select(*names, *_NAMES)


def _after() -> list[Column]:
    """The record r, where there is one, followed by the later fold f."""
    r, f = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"f.{c}"))
    step = F.coalesce((F.abs(f("open_odd") - r("last_odd")) >= MOVE - 1e-9).cast("long"), F.lit(0))
    total = lambda c: F.coalesce(r(c), F.lit(0)) + f(c)
    return [
        F.coalesce(r("open_odd"), f("open_odd")).alias("open_odd"), F.coalesce(r("open_ts"), f("open_ts")).alias("open_ts"), f("last_odd").alias("last_odd"), f("last_ts").alias("last_ts"),
        F.greatest(r("max_odd"), f("max_odd")).alias("max_odd"), F.least(r("min_odd"), f("min_odd")).alias("min_odd"), total("n_obs").alias("n_obs"), (total("n_moves") + step).alias("n_moves"),
    ]


def run(stream: DataFrame, folder: str, keys: str) -> None:
    """Merge a stream until its input ends."""
    stream.writeStream.foreachBatch(lambda rows, k: merge_batch(rows, k, folder, keys)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
