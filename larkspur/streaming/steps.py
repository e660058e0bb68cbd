"""State of a stream as tables: a micro-batch reads the snapshot that the one before left, and leaves the next.

Micro-batch k is step 2k + 2; what an ended input lets pass is the odd step after it. A step reads the newest finished one below its own, and
is finished by a swap of the pointer, so a batch that is run again replaces what it wrote. The snapshots of two steps stay.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources import sinks


def _finished(spark: SparkSession, folder: str) -> list[dict]:
    return json.loads(sinks.read_text(spark, f"{folder}/steps.json") or "[]")


def before(spark: SparkSession, folder: str, step: int) -> dict | None:
    """The mark of the newest finished step below step."""
    return max((m for m in _finished(spark, folder) if m["step"] < step), key=lambda m: m["step"], default=None)


def finish(spark: SparkSession, folder: str, mark: dict, kept: tuple[str, ...]) -> None:
    """Mark a step as finished and drop all but its snapshots in the folders kept and those of the one before."""
    known, earlier = _finished(spark, folder), before(spark, folder, mark["step"])
    now = [m for m in (earlier, mark) if m]
    sinks.put_text(spark, f"{folder}/steps.json", json.dumps(now))
    for step in {m["step"] for m in known} - {m["step"] for m in now}:
        for name in kept:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/step={step}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def snapshot(spark: SparkSession, folder: str, name: str, schema: str, mark: dict | None) -> DataFrame:
    """What the step of mark left under name; nothing where there was none."""
    if mark is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}/step={mark['step']}")


def run(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None]) -> None:
    """Run a stream until its input ends, each micro-batch as step(rows, number)."""
    stream.writeStream.foreachBatch(lambda rows, k: step(rows, 2 * k + 2)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def ended(spark: SparkSession, folder: str) -> int | None:
    """The number of the step for an input that has ended, if none has followed its last micro-batch."""
    newest = max((m["step"] for m in _finished(spark, folder)), default=0)
    return newest + 1 if newest % 2 == 0 else None
