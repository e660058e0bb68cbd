"""Files that are published together: a manifest of their bytes, and whether a folder still is what its manifest says."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.sinks import put_text

MANIFEST = "manifest.json"


def scanned(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, sha256, bytes, at) of each file below folder, read and hashed by Spark; a file is a row, of two GB at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    name = F.substring_index(F.col("path"), f"{base}/", -1)
    rows = files.select(name.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.col("modificationTime").alias("at"))
    return rows.where(~F.col("name").rlike(r"(^|/)[._]") & (F.col("name") != MANIFEST))


def publish_manifest(spark: SparkSession, folder: str, at: str, most_spread_minutes: float = 45) -> DataFrame:
    """Write the manifest of a folder's files, last; files that were written too far apart are refused. One line a file is its bound."""
    found = scanned(spark, folder)
    rows = [r.asDict() for r in found.select("name", "sha256", "bytes", F.unix_micros("at").alias("us")).orderBy("name").collect()]
    if rows and (max(r["us"] for r in rows) - min(r["us"] for r in rows)) / 60e6 > most_spread_minutes:
        raise ValueError("files of different builds")
    put_text(spark, f"{folder}/{MANIFEST}", json.dumps({"generated_iso": at, "artifacts": [{k: r[k] for k in ("name", "sha256", "bytes")} for r in rows]}))
    return found


def incoherent(spark: SparkSession, folder: str, now: str, most_age_minutes: float = 360) -> DataFrame:
    """(gate, subject, reason) of what makes a folder differ from its manifest: absent, changed and extra files, and a manifest too old."""
    text = spark.read.option("wholetext", True).text(f"{folder}/{MANIFEST}")
    body = text.select(F.from_json("value", "generated_iso string, artifacts array<struct<name: string, sha256: string, bytes: long>>").alias("m"))
    listed = body.select(F.explode("m.artifacts").alias("a")).select("a.name", F.col("a.sha256").alias("said"))
    both = listed.join(scanned(spark, folder).select("name", "sha256"), "name", "full")
    reason = F.when(F.col("sha256").isNull(), "absent").when(F.col("said").isNull(), "extra").when(F.col("said") != F.col("sha256"), "changed")
    files = both.withColumn("reason", reason).where("reason IS NOT NULL").select(F.lit("manifest_hash").alias("gate"), F.col("name").alias("subject"), "reason")
    at = F.col("m.generated_iso").try_cast("timestamp")
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at)) / 60e6
    why = F.when(at.isNull(), "no time").when(age > most_age_minutes, "old").when(F.size("m.artifacts") == 0, "empty")
    return files.unionByName(body.select(F.lit("manifest_hash").alias("gate"), F.lit(MANIFEST).alias("subject"), why.alias("reason")).where("reason IS NOT NULL"))
