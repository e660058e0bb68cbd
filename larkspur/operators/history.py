"""Price history: ticks, state folds, freezing, merging of records, joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOVE = 0.01
STATUS = {"open": 0, "unavailable": 1, "closed": 2, "pending_result": 3, "settled": 4}


def ticks(rows: DataFrame, by: list[str], time: str, value: str, least: float = MOVE, order: tuple = ()) -> DataFrame:
    """Rows whose value differs by least or more from the one before; the first of a key is kind ``open``."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(time, *order))
    kind = F.when(before.isNull(), "open").when(F.abs(F.col(value) - before) >= least - 1e-9, "price")
    return rows.withColumns({"kind": kind, "previous": before}).where("kind IS NOT NULL")


def fold(rows: DataFrame, by: list[str], time: str = "ts", odd: str = "odd", order: tuple = ()) -> DataFrame:
    """Open, last, extremes and counts of each key. Rows after the deadline kickoff count, but change nothing else."""
    alive = F.coalesce(F.col(time) < F.col("kickoff") - F.expr("INTERVAL 45 SECONDS"), F.lit(True))
    at = F.struct(time, *order)
    marked = rows.withColumn("_alive", alive)
    move = F.abs(F.col(odd) - F.lag(odd).over(Window.partitionBy(*by, "_alive").orderBy(time, *order))) >= MOVE - 1e-9
    marked = marked.withColumn("_move", F.col("_alive") & F.coalesce(move, F.lit(False)))
    live = lambda c: F.when(F.col("_alive"), c)
    return marked.groupBy(*by).agg(
        F.min_by(live(F.col(odd)), live(at)).alias("open_odd"), F.min(live(F.col(time))).alias("open_ts"),
        F.max_by(live(F.col(odd)), live(at)).alias("last_odd"), F.max(live(F.col(time))).alias("last_ts"),
        F.max(live(F.col(odd))).alias("max_odd"), F.min(live(F.col(odd))).alias("min_odd"),
        F.count("*").alias("n_obs"), F.sum(F.col("_move").cast("long")).alias("n_moves"), F.max("kickoff").alias("kickoff"),
    )


def as_of_last(rows: DataFrame, deadlines: DataFrame, key: str, time: str, deadline: str) -> DataFrame:
    """The last row of each key strictly before its deadline, keys without one left out; aggregation, no sort."""
    before = rows.join(deadlines, key).where(F.col(time) < F.col(deadline))
    columns = [c for c in rows.columns if c != key]
    last = before.groupBy(key, deadline).agg(F.max_by(F.struct(*columns), F.struct(*[time, *[c for c in columns if c != time]])).alias("_last"))
    return last.select(key, deadline, "_last.*")


def merge_records(rows: DataFrame, by: list[str]) -> DataFrame:
    """Records of one key to one: earliest opening, latest last and close, extremes, sums, highest status."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("status")], F.lit(0))
    tie = F.struct("source")
    settled = F.when(F.col("status") == "settled", F.struct("last_ts", tie))
    return rows.groupBy(*by).agg(
        F.min_by("open_odd", F.struct(F.col("open_ts").isNull(), "open_ts", tie)).alias("open_odd"), F.min("open_ts").alias("open_ts"),
        F.max_by("last_odd", F.struct("last_ts", tie)).alias("last_odd"), F.max("last_ts").alias("last_ts"),
        F.max("max_odd").alias("max_odd"), F.min("min_odd").alias("min_odd"),
        F.sum("n_obs").alias("n_obs"), F.sum("n_moves").alias("n_moves"),
        F.max_by("status", F.struct(rank, "status")).alias("status"), F.max_by("result", settled).alias("result"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("merged_from"),
    )


def bucket_extremes(rows: DataFrame, by: list[str], time: str, odd: str, unit: str = "minute") -> DataFrame:
    """The series of a key by minute, hour or day: the highest odd of each bucket."""
    return rows.groupBy(*by, F.date_trunc(unit, time).alias("bucket")).agg(F.max(odd).alias("odd"))


def half_life_mean(rows: DataFrame, by: list[str], order: list, value: str, half_life: float, last: int, least: int) -> DataFrame:
    """Exponentially weighted mean of the last rows of a key; keys with fewer than least are left out."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    recent = rows.withColumn("_k", rank).where(F.col("_k") < last)
    weight = F.pow(F.lit(0.5), F.col("_k") / half_life)
    return recent.groupBy(*by).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)


def dedup_signature(rows: DataFrame, signature: list[str], fill: list[str]) -> DataFrame:
    """One row a signature; the columns in fill take their least value that is not null."""
    return rows.groupBy(*signature).agg(*[F.min(c).alias(c) for c in fill])
