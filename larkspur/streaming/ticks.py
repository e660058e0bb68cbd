"""Streaming twins of the history operators: keyed state per instrument, ticks and folds as micro-batches come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators.history import MOVE
from larkspur.streaming import steps

TICK = "game long, house string, id long, ts timestamp, odd double, previous double, kind string"


STATE = "game long, house string, open_odd double, open_ts timestamp, last_odd double, last_ts timestamp, min_odd double, max_odd double, n_obs long, n_moves long, closed boolean"
_LAST = "game long, house string, odd double"


def price_ticks(rows: DataFrame, folder: str, least: float = MOVE) -> DataFrame:
    """rows(game, house, id, ts, odd), a stream, run to its end to open and price ticks; state is the last odd of a key, a table of a snapshot a batch."""

    def step(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        earlier = steps.before(spark, folder, number)
        held = steps.snapshot(spark, folder, "last", _LAST, earlier).select("game", "house", F.lit(None).cast("long").alias("id"), F.lit(None).cast("timestamp").alias("ts"), "odd", F.lit(0).alias("turn"))
        every = held.unionByName(new.select("game", "house", "id", "ts", "odd", F.lit(1).alias("turn")))
        order = ("turn", F.col("ts").isNull(), "ts", "id")
        previous = F.lag("odd").over(Window.partitionBy("game", "house").orderBy(*order))
        kind = F.when(F.col("previous").isNull(), "open").when(F.abs(F.col("odd") - F.col("previous")) >= least - 1e-9, "price")
        ticks = every.withColumn("previous", previous).withColumn("kind", kind).where("turn = 1 AND kind IS NOT NULL")
        ticks.select("game", "house", "id", "ts", "odd", "previous", "kind").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        last = every.groupBy("game", "house").agg(F.max_by("odd", F.struct("turn", F.col("ts").isNull(), "ts", "id")).alias("odd"))
        last.write.mode("overwrite").parquet(f"{folder}/last/step={number}")
        steps.finish(spark, folder, {"step": number}, ("last",))

    steps.run(rows, folder, step)
    return rows.sparkSession.read.schema(TICK).parquet(f"{folder}/out")


def open_close(rows: DataFrame, late: str = "1 hour", keep_days: int = 30) -> DataFrame:
    """rows(game, house, id, ts, odd, kickoff), a stream, to the state of each instrument after every batch that touches it.

    Observations from kickoff less 45 seconds on count, and change nothing else. A line closes when event time has
    passed kickoff less two minutes, by a timer if no row of its own comes, with its last odd from before. A late row takes its place as
    opening or last odd by its time; the moves around it are those of its batch (``keyed.instruments`` keeps them exact). State goes
    keep_days after kickoff has passed, or after the last row where no kickoff is known.
    """

    def shown(key: tuple, now: list) -> pd.DataFrame:
        return pd.DataFrame([(*key, *now[:9])], columns=[f.split()[0] for f in STATE.split(", ")])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [None, None, None, None, None, None, 0, 0, False, None, None]
        # open odd and ts, last odd and ts, least, most, observations, moves, closed, kickoff, newest
        if state.hasTimedOut and (now[8] or now[9] is None):
            state.remove()
            return
        if state.hasTimedOut:
            now[8] = True
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "id"])
            known = rows["kickoff"].dropna()
            now[9] = known.iloc[-1].to_pydatetime() if len(known) else now[9]
            now[10] = max(x for x in (now[10], rows["ts"].iloc[-1].to_pydatetime()) if x is not None)
            alive = rows if now[9] is None else rows[rows["ts"] < now[9] - pd.Timedelta(seconds=45)]
            now[6] += len(rows)
            if len(alive) and not now[8]:
                first, last = alive.iloc[0], alive.iloc[-1]
                changes = alive["odd"].diff().abs()
                changes.iloc[0] = abs(first.odd - now[2]) if now[2] is not None else 0.0
                now[7] += int((changes >= 0.01 - 1e-9).sum())
                if now[0] is None or first.ts < now[1]:
                    now[0], now[1] = float(first.odd), first.ts.to_pydatetime()
                if now[2] is None or last.ts >= now[3]:
                    now[2], now[3] = float(last.odd), last.ts.to_pydatetime()
                now[4] = min(x for x in (now[4], float(alive["odd"].min())) if x is not None)
                now[5] = max(x for x in (now[5], float(alive["odd"].max())) if x is not None)
            now[8] = bool(now[8] or (now[9] is not None and rows["ts"].max() >= now[9] - pd.Timedelta(minutes=2)))
        state.update(tuple(now))
        ends = now[10] if now[9] is None else max(now[9], now[10])
        due = ends + pd.Timedelta(days=keep_days) if now[8] or now[9] is None else now[9] - pd.Timedelta(minutes=2)
        state.setTimeoutTimestamp(max(int(pd.Timestamp(due).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield shown(key, now)

    watermarked = rows.select("game", "house", "id", "ts", "odd", "kickoff").withWatermark("ts", late)
    kept = ", ".join(STATE.split(", ")[2:]) + ", kickoff timestamp, newest timestamp"
    return watermarked.groupBy("game", "house").applyInPandasWithState(step, STATE, kept, "update", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(rows: DataFrame, late: str = "10 minutes", size: str = "6 hours") -> DataFrame:
    """Counts by house and tumbling window behind a watermark."""
    return rows.withWatermark("ts", late).groupBy("house", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.sum("odd").alias("total"))


def distinct_ticks(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Drops repeated captures of one observation that come within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["game", "house", "id"])
