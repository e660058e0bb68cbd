"""Shared helpers: reading tables, cutting lineage in the shared folder, expression binding."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_local: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a temporary one only where it is unset, in local mode."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="larkspur-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared folder; the folder goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/larkspur-{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def _sweep() -> None:
    """Results may be read as long as the session lasts, so their folders are removed last."""
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may have been stopped
            discard_folder(spark, path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized frame that nothing will read again."""
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/larkspur-" in parent:
            discard_folder(df.sparkSession, parent)


def discard_folder(spark: SparkSession, url: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(url)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
