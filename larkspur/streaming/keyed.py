"""State of an instrument by event time: rows take effect in the order of (time, id), whatever the order they come in.

A row waits until the watermark has passed it; only then is it folded, and a tick of it is final. Until then it counts in the state
that is shown, so the state after the last batch is that of all rows. A line closes once the watermark reaches kickoff less two minutes, whether
or not another row of it comes; rows of later event time only count. State goes some days after kickoff, or after
the last row where no kickoff is known. Rows behind the watermark are dropped. A key's waiting rows are those of the allowed
lateness, so state does not grow with the length of the stream.

State and waiting rows are tables (``steps``), folded by windows and aggregates over one shuffle by key, so no key costs a call of
Python; each micro-batch writes the state of all live keys anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.times import FREEZE_MINUTES
from larkspur.operators.history import MOVE
from larkspur.streaming import steps

KEY = ("game", "house")
_FOLD = "open_odd double, open_us long, last_odd double, last_us long, min_odd double, max_odd double, n_obs long, n_moves long, kickoff_us long, closed boolean, newest_us long, shown long"
_NAMES = [f.split()[0] for f in _FOLD.split(", ")]
_TICK = "id long, us long, odd double, previous double"
OUT = f"game long, house string, kind string, {_TICK}, {_FOLD}"
_STRUCT = "struct<" + ", ".join(f.replace(" ", ": ") for f in _FOLD.split(", ")) + ">"
_HELD = f"game long, house string, live boolean, emitted boolean, folded {_STRUCT}, seen {_STRUCT}"
_WAITING = "game long, house string, id long, us long, odd double"
_DAY, _MINUTE = 86_400_000_000, 60_000_000


@dataclass(frozen=True)
class Instruments:
    """A stream of rows(game, house, id, us, odd, kickoff_us), how late they may come, and how long state stays, in microseconds."""

    rows: DataFrame
    late: int
    keep: int
    freeze: int = FREEZE_MINUTES * _MINUTE


def instruments(rows: DataFrame, late: str = "1 hour", keep_days: int = 30) -> Instruments:
    """rows(game, house, id, ts, odd, kickoff), a stream, for run."""
    timed = rows.where("ts IS NOT NULL AND odd IS NOT NULL")
    waits = rows.sparkSession.sql(f"SELECT unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {late})").first()[0]
    return Instruments(timed.select("game", "house", "id", F.unix_micros("ts").alias("us"), "odd", F.unix_micros("kickoff").alias("kickoff_us")), waits, keep_days * _DAY)


def _at(us: int | None) -> Column:
    return F.lit(us).cast("long")


def _passed(mark: dict | None, of: Instruments) -> int | None:
    """The watermark after the rows of mark, in whole milliseconds."""
    return None if mark is None or mark["newest"] is None else (mark["newest"] - of.late) // 1000 * 1000


def _seen(rows: DataFrame, waiting: DataFrame, held: DataFrame, passed: int | None, of: Instruments) -> DataFrame:
    """Rows and those that waited, and one row for each state s, with what came before in their order.

    live is false for what belongs to a state whose days are over: it is settled, and rows that come begin anew.
    """
    none = lambda **columns: [F.lit(None).cast(kind).alias(c) for c, kind in columns.items()]
    every = rows.select(*KEY, "id", "us", "odd", "kickoff_us", F.lit(True).alias("fresh"), *none(s=_STRUCT))
    every = every.unionByName(waiting.select(*KEY, "id", "us", "odd", *none(kickoff_us="long"), F.lit(False).alias("fresh"), *none(s=_STRUCT)))
    every = every.unionByName(held.select(*KEY, *none(id="long", us="long", odd="double", kickoff_us="long"), F.lit(False).alias("fresh"), F.col("folded").alias("s")))
    key = Window.partitionBy(*KEY)
    every = every.withColumns({"s": F.max("s").over(key), "again": F.max("fresh").over(key)})
    over = F.coalesce(F.greatest("s.kickoff_us", "s.newest_us") + of.keep <= _at(passed), F.lit(False))
    every = every.withColumns({"live": ~over | F.col("fresh"), "s": F.when(~(over & F.col("fresh")), F.col("s"))})
    life = Window.partitionBy(*KEY, "live")
    every = every.withColumn("kickoff_us", F.coalesce("s.kickoff_us", F.min("kickoff_us").over(life)))
    alive = F.when(F.col("us").isNotNull(), F.coalesce(F.col("us") < F.col("kickoff_us") - of.freeze, F.lit(True)))
    every = every.withColumns({"alive": alive, "done": F.coalesce(F.col("us") < _at(passed), F.lit(False))})
    previous = F.coalesce(F.lag("odd").over(Window.partitionBy(*KEY, "live", "alive").orderBy("us", "id", "odd")), "s.last_odd")
    every = every.withColumn("previous", F.when(F.col("alive"), previous))
    moved = F.abs(F.col("odd") - F.col("previous")) >= MOVE - 1e-9
    return every.withColumn("kind", F.when(F.col("alive") & F.col("previous").isNull(), "open").when(F.col("alive") & moved, "price"))


def _folded(seen: DataFrame, passed: int | None, of: Instruments) -> DataFrame:
    """_HELD of each key: folded by the rows that the watermark has passed, and seen by all."""
    s = F.first("s")
    kickoff = F.first("kickoff_us")
    closed = F.coalesce(s["closed"], F.lit(False)) | F.coalesce(kickoff - of.freeze <= _at(passed), F.lit(False))
    emitted = F.max(F.col("fresh") | F.col("done")) | (closed != F.coalesce(s["closed"], F.lit(False)))
    newest = F.greatest(s["newest_us"], F.max("us"))

    def state(counted: Column) -> Column:
        live = lambda c: F.when(counted & F.col("alive"), c)
        at, odd, us = live(F.struct("us", "id", "odd")), live(F.col("odd")), live(F.col("us"))
        count = lambda c: F.count(F.when(counted & c, 1))
        total = lambda name, n: F.coalesce(s[name], F.lit(0)) + n
        return F.struct(
            F.coalesce(s["open_odd"], F.min_by(odd, at)).alias("open_odd"), F.coalesce(s["open_us"], F.min(us)).alias("open_us"),
            F.coalesce(F.max_by(odd, at), s["last_odd"]).alias("last_odd"), F.coalesce(F.max(us), s["last_us"]).alias("last_us"),
            F.least(s["min_odd"], F.min(odd)).alias("min_odd"), F.greatest(s["max_odd"], F.max(odd)).alias("max_odd"),
            total("n_obs", count(F.col("us").isNotNull())).alias("n_obs"), total("n_moves", count(F.col("kind") == "price")).alias("n_moves"),
            kickoff.alias("kickoff_us"), closed.alias("closed"), newest.alias("newest_us"), total("shown", emitted.cast("long")).alias("shown"),
        )

    # a state that ends in the batch that begins the key anew is not the one to show
    shown = emitted & (F.col("live") | ~F.first("again"))
    return seen.groupBy(*KEY, "live").agg(shown.alias("emitted"), state(F.col("done")).alias("folded"), state(F.lit(True)).alias("seen"))


def _step(new: DataFrame | None, step: int, of: Instruments, folder: str, files_folder: str) -> None:
    """Fold the rows of a micro-batch, or none once the input has ended, into the state that the step before left."""
    spark = of.rows.sparkSession if new is None else new.sparkSession
    earlier = steps.before(spark, folder, step)
    passed, over = _passed(earlier, of), earlier and earlier["passed"]
    rows = spark.createDataFrame([], "game long, house string, id long, us long, odd double, kickoff_us long") if new is None else new
    rows = rows if over is None else rows.where(F.col("us") >= over)
    held = steps.snapshot(spark, folder, "fold", _HELD, earlier).where("live")
    seen = _seen(rows, steps.snapshot(spark, folder, "waiting", _WAITING, earlier), held, passed, of).persist()
    try:
        seen.where("us IS NOT NULL AND NOT done").select(*KEY, "id", "us", "odd").write.mode("overwrite").parquet(f"{folder}/waiting/step={step}")
        _folded(seen, passed, of).write.mode("overwrite").parquet(f"{folder}/fold/step={step}")
        states = steps.snapshot(spark, folder, "fold", _HELD, {"step": step})
        none = lambda fields: [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in fields.split(", ")]
        ticks = seen.where("done AND kind IS NOT NULL").select(*KEY, "kind", "id", "us", "odd", "previous", *none(_FOLD))
        ticks.unionByName(states.where("emitted").select(*KEY, F.lit("state").alias("kind"), *none(_TICK), "seen.*")).write.mode("overwrite").parquet(f"{folder}/{files_folder}/batch={step}")
    finally:
        seen.unpersist()
    newest = [us for us in (earlier and earlier["newest"], states.agg(F.max("folded.newest_us")).first()[0]) if us is not None]
    steps.finish(spark, folder, {"step": step, "newest": max(newest, default=None), "passed": passed}, ("fold", "waiting"))


def final_ticks(out: DataFrame) -> DataFrame:
    """Openings and moves that no later row can change."""
    return out.where("kind <> 'state'").select("game", "house", "id", F.timestamp_micros("us").alias("ts"), "odd", "previous", "kind")


def latest(out: DataFrame) -> DataFrame:
    """The newest state of each key; close_odd is that of a closed line."""
    newest = out.where("kind = 'state'").groupBy("game", "house").agg(F.max_by(F.struct(*_NAMES), "batch").alias("s")).select("game", "house", "s.*")
    stamps = {f"{c}_ts": F.timestamp_micros(f"{c}_us") for c in ("open", "last")}
    return newest.withColumns(stamps | {"close_odd": F.when(F.col("closed"), F.col("last_odd"))})


def run(stream: Instruments, folder: str, files_folder: str = "out", ended: bool = True) -> DataFrame:
    """Run a stream until its input ends, one folder a batch, so that a batch that is run again replaces what it wrote; rows of OUT and batch.

    Where more input is to follow (ended is false), what the last batch lets pass stays for the next.
    """
    spark = stream.rows.sparkSession
    steps.run(stream.rows, folder, lambda rows, step: _step(rows, step, stream, folder, files_folder))
    last = steps.ended(spark, folder) if ended else None
    if last is not None:
        _step(None, last, stream, folder, files_folder)
    return spark.read.schema(f"{OUT}, batch long").parquet(f"{folder}/{files_folder}")
