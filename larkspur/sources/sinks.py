"""Writers: append logs, month upserts, immutable generations with pointers, documents and manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_ticks(rows: DataFrame, path: str, time: str = "ts") -> None:
    """Append to a log partitioned by day."""
    rows.withColumn("date", F.to_date(time)).write.mode("append").partitionBy("date").json(path)


def upsert_months(rows: DataFrame, path: str, kickoff: str = "kickoff", keys: list[str] | None = None) -> None:
    """Write rows to their months. With keys, a month keeps what it holds under other keys, and is left alone if nothing in it changes."""
    new = rows.withColumn("month", F.date_format(kickoff, "yyyy-MM"))
    spark, aside = rows.sparkSession, None
    if keys and _exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        held = old.join(new.select("month").distinct(), "month", "left_semi")
        merged = new.unionByName(held.join(new.select("month", *keys), ["month", *keys], "left_anti"))
        changed = merged.exceptAll(held.select(*merged.columns)).select("month").union(held.select(*merged.columns).exceptAll(merged).select("month")).distinct()
        # read and written in one place: the rows are held in files of their own first
        aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.aside"
        merged.join(changed, "month", "left_semi").write.parquet(aside)
        new = spark.read.schema(merged.schema).parquet(aside)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    if aside:
        where = spark._jvm.org.apache.hadoop.fs.Path(aside)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def append_months(rows: DataFrame, path: str, kickoff: str = "kickoff") -> None:
    """Append settled rows, partitioned by the month of kickoff; those without one go to ``unknown``."""
    rows.withColumn("month", F.coalesce(F.date_format(kickoff, "yyyy-MM"), F.lit("unknown"))).write.mode("append").partitionBy("month").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def generation(rows: DataFrame, folder: str, columns: list[str]) -> tuple[str, int]:
    """Write rows below folder under a name made from their content, and count them; a generation that is there is not written again.

    The name is the sha256 of four sums over the rows' own hashes, so that it depends on no order and tells repeated rows apart.
    """
    spark = rows.sparkSession
    part = lambda k: F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    hashed = rows.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))
    sums = hashed.agg(F.count("*").alias("n"), *[F.sum(part(k)).cast("string").alias(f"s{k}") for k in range(4)])
    made = sums.select("n", F.substring(F.sha2(F.concat_ws("|", *sums.columns), 256), 1, 20).alias("name")).first()
    path = f"{folder}/gen={made.name}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        rows.write.mode("overwrite").json(path)
    return path, made.n


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file by writing aside and renaming, so that readers see the old or the new one whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = final.getFileSystem(conf).create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf)
    how = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    how[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    files.rename(aside, final, how)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file whole; null where there is none."""
    if not _exists(spark, path):
        return None
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _body(spark: SparkSession, path: str) -> dict:
    """A pointer's content; empty where there is none or it does not read."""
    try:
        body = json.loads(read_text(spark, path) or "{}")
    except ValueError:
        return {}
    return body if isinstance(body, dict) else {}


def pointers(pointer: str) -> dict[str, str]:
    """The pointers of one publication: the last sound full one, the last close one, the last of any kind."""
    stem = pointer.removesuffix(".json")
    return {"full": pointer, "close": f"{stem}_close.json", "any": f"{stem}_any.json"}


def keep_pointed(spark: SparkSession, folder: str, kept: set[str]) -> None:
    """Remove the generations of a folder that are not named; a failure leaves them for the next time."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = {path.rstrip("/").rpartition("/")[2] for path in kept if path}
    try:
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(where):
            name = status.getPath().getName()
            if name.startswith("gen=") and name not in names:
                fs.delete(status.getPath(), True)
    except Py4JJavaError:
        return


def manifest(artifacts: DataFrame, path: str, at: str, most_spread_minutes: int = 45) -> dict:
    """Write a manifest of artifacts(name, sha256, n, ts): what was published together; refuse sources too far apart in time."""
    spread = artifacts.agg(((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 60e6).alias("minutes")).first().minutes
    if spread is not None and spread > most_spread_minutes:
        raise ValueError(f"sources lie {spread:.0f} minutes apart")
    rows = [r.asDict() for r in artifacts.select("name", "sha256", F.col("n").cast("long").alias("n"), F.col("ts").cast("string").alias("ts")).orderBy("name").collect()]
    body = {"at": at, "spread_minutes": spread, "artifacts": rows}
    put_text(artifacts.sparkSession, path, json.dumps(body))
    return body


#: A market that had eight events or more may not fall below this share of them in a full publication.
MARKET_LEAST, MARKET_SHARE = 8, 0.35


def collapsed(now: dict[str, int], before: dict[str, int]) -> list[str]:
    """Markets, in order, whose events fell too far for a snapshot to take the place of the last sound one."""
    return [m for m, n in sorted(before.items()) if n >= MARKET_LEAST and now.get(m, 0) < n * MARKET_SHARE]


def publish(rows: DataFrame, folder: str, pointer: str, columns: list[str], at: str, mode: str = "full", least: int = 1, market: str | None = None) -> dict:
    """Write a generation, then its pointers, last; then remove what neither they nor the full pointer before them name.

    A ``close`` publication never replaces the full pointer, nor does one of fewer rows than least, nor one in which a market
    collapsed (``market`` names the column that events are counted by). ``..._any.json`` points to the latest whatever it is.
    """
    spark, names = rows.sparkSession, pointers(pointer)
    path, n = generation(rows, folder, columns)
    held = _body(spark, names["full"])
    body: dict = {"file": path, "n": n, "at": at, "mode": mode}
    if market:
        body["markets"] = {r[0]: r[1] for r in rows.where(F.col(market).isNotNull()).groupBy(market).count().collect()}
        if mode == "full":
            body["promotion_blocked"] = collapsed(body["markets"], held.get("markets") or {})
    sound = mode == "full" and n >= least and not body.get("promotion_blocked")
    if sound:
        put_text(spark, names["full"], json.dumps(body))
    if mode != "full":
        put_text(spark, names["close"], json.dumps(body))
    put_text(spark, names["any"], json.dumps(body))
    keep_pointed(spark, folder, {held.get("file"), *(_body(spark, p).get("file") for p in names.values())})
    return body


class Conflict(RuntimeError):
    """Another writer committed first, as often as was tried."""


def head(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """The last commit of a folder and the generation that it names; 0 and null before the first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_commits")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return 0, None
    found = [s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")]
    if not found:
        return 0, None
    last = max(found)
    return int(last.removesuffix(".json")), _body(spark, f"{folder}/_commits/{last}")["file"]


def _put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file whole if it is not there: the file system's rename decides between writers."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = final.getFileSystem(conf).create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(aside, final, spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
    except Py4JJavaError as error:
        final.getFileSystem(conf).delete(aside, False)
        if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
            raise
        return False
    return True


def persist(spark: SparkSession, folder: str, ingest: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> int:
    """Commit ingest(what is committed) as the next version, and return its number.

    Rows go to a folder of their own. The commit is a file that only one writer can create; the other one ingests again, into what
    has been committed meanwhile. What a lost try wrote is removed.
    """
    for _ in range(tries):
        version, base = head(spark, folder)
        path = f"{folder}/gen={uuid.uuid4().hex}"
        ingest(spark.read.parquet(base) if base else None).write.parquet(path)
        if _put_new(spark, f"{folder}/_commits/{version + 1:012d}.json", json.dumps({"file": path})):
            return version + 1
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    raise Conflict(f"{tries} tries to commit to {folder} were overtaken")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(head(spark, folder)[1])


def document(rows: DataFrame, path: str, name: str, order: list[str]) -> None:
    """A view document ``window.NAME = [...];`` of rows that a report holds: one file."""
    item = F.struct(*[F.col(c) for c in [*order, *[c for c in rows.columns if c not in order]]])
    rows.agg(F.to_json(F.sort_array(F.collect_list(item))).alias("j")).select(F.concat(F.lit(f"window.{name} = "), F.coalesce("j", F.lit("[]")), F.lit(";"))).coalesce(1).write.mode("overwrite").text(path)
