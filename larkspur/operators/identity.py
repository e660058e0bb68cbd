"""Fixtures and games: rivals in a slot, top matches with a margin, and unification into components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by checkpoint() in the cluster's shared folder; a temporary one only in local mode."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(given or tempfile.mkdtemp(prefix="larkspur-"))
    return df.checkpoint()


def slot_rivals(rows: DataFrame, day: str, time: str, key: str, minutes: int) -> DataFrame:
    """How many other rows of the day lie within minutes of each row; keys are unique, rows without a day or a time have no rivals.

    Rows are counted, not paired: those up to the end of a row's span less those before its start. Running counts are taken within
    minutes of the day, and the counts of whole minutes are added up.
    """
    us, span = F.unix_micros(time), F.lit(minutes * MINUTE).cast("long")
    timed = rows.where(F.col(key).isNotNull()).select(key, F.col(day).alias("_day"), us.alias("_us")).where("_day IS NOT NULL AND _us IS NOT NULL")
    times = timed.groupBy("_day", "_us").agg(F.count("*").alias("_n"))
    point = lambda at, n, sign: F.struct(at.alias("at"), n.alias("n"), F.lit(sign).alias("sign"))
    none = F.lit(0).cast("long")
    points = times.select("_day", "_us", F.explode(F.array(point(F.col("_us"), F.col("_n"), 0), point(F.col("_us") + span, none, 1), point(F.col("_us") - span - 1, none, -1))).alias("p"))
    points = points.select("_day", "_us", "p.*").withColumn("slot", F.floor(F.col("at") / MINUTE))
    before = Window.partitionBy("_day").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = points.groupBy("_day", "slot").agg(F.sum("n").alias("n")).select("_day", "slot", F.coalesce(F.sum("n").over(before), none).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("_day", "slot").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = points.withColumn("upto", upto).where("sign != 0").join(slots, ["_day", "slot"])
    near = counted.groupBy("_day", "_us").agg((F.sum(F.col("sign") * (F.col("upto") + F.col("before"))) - 1).alias("rivals"))
    found = timed.join(near, ["_day", "_us"]).select(key, "rivals")
    return rows.select(key).join(found, key, "left").select(key, F.coalesce("rivals", none).alias("rivals"))


def unify(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, component): least reachable node, by propagation of labels with pointer jumps.

    Lineage is cut by checkpoint() in the cluster's shared folder; only a count reaches the driver each round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        new = cut(
            labels.join(seen, labels.node == seen.a).join(jump, "component")
            .select("node", F.least("component", "near", "higher").alias("new"), "component")
        )
        if new.where("new != component").isEmpty():
            return labels
        labels = new.select("node", F.col("new").alias("component"))
