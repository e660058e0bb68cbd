"""Token counts of flat token files by a separator scan.

A token file is a bare array of little-endian unsigned integers, documents one after another, each ended by the
end-of-document id; nothing says where a document begins. Files are read in blocks. In a block, numpy finds the
separators; documents that begin and end in it are counted at once. What remains of a block are three numbers:
its separators, the tokens before the first and the tokens after the last. A prefix scan over these stitches the
document that spans a block boundary, however many blocks it spans, and numbers the documents of a file. The scan
has two levels, blocks in groups of GROUP and then groups, so no task holds all blocks of a large file.

Files lie where every executor reaches them; a path is a URL that pyarrow.fs opens or a local path. The tokens
after a file's last separator are a document too, unless there are none. An empty file has no documents.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tokens a block; blocks a group of the prefix scan.
BLOCK, GROUP = 1 << 20, 1 << 10


def opened(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (fs.LocalFileSystem(), url)


def blocks_of(spark: SparkSession, files: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """files(path, size in bytes) to (path, block, first, tokens)."""
    n = F.col("size") / width
    return files.where(f"size >= {width}").select("path", F.floor(n).alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.floor(n) - 1) / block))).alias("block")).select(
        "path", "block", (F.col("block") * block).alias("first"), F.least(F.lit(block).cast("long"), F.col("n") - F.col("block") * block).alias("tokens")
    )


def scan_block(ids: np.ndarray, end: int) -> tuple[int, int, int, np.ndarray]:
    """(separators, tokens before the first, tokens after the last, sizes of the documents between them)."""
    at = np.flatnonzero(ids == end)
    if not len(at):
        return 0, len(ids), 0, at
    return len(at), int(at[0]), int(len(ids) - 1 - at[-1]), np.diff(at) - 1


def dealt(blocks: DataFrame) -> DataFrame:
    """blocks over all shuffle partitions: their rows are few and small, but each stands for a block to be read."""
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "block")


def scanned(blocks: DataFrame, dtype: str, end: int) -> DataFrame:
    """blocks to (path, block, seps, head, tail, sizes)."""
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, first, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = opened(path)
                with system.open_input_file(place) as f:
                    ids = np.frombuffer(f.read_at(tokens * width, first * width), np.dtype(dtype).newbyteorder("<"))
                seps, head, tail, sizes = scan_block(ids, end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int64()), pa.array([seps], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([sizes.tolist()], pa.list_(pa.int64()))],
                    names=["path", "block", "seps", "head", "tail", "sizes"],
                )

    return blocks.mapInArrow(run, "path string, block long, seps long, head long, tail long, sizes array<long>")


def _stitched(summaries: DataFrame) -> DataFrame:
    """Adds docs_before, the separators before each block, and carry, the tokens since the last of them."""
    s = summaries.withColumn("group", F.floor(F.col("block") / GROUP))
    inside = Window.partitionBy("path", "group").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # tokens since the last separator: those after it in its block, and all of the blocks since
    whole = F.sum(F.when(F.col("seps") == 0, F.col("head")).otherwise(F.lit(0)))
    part = s.withColumns({
        "seps_in": F.coalesce(F.sum("seps").over(before), F.lit(0)),
        "run": whole.over(before),
        "mark": F.last(F.when(F.col("seps") > 0, F.struct(F.col("block"), F.col("tail"), whole.over(inside).alias("upto"))), True).over(before),
    })
    part = part.withColumn("carry_in", F.when(F.col("mark").isNull(), F.coalesce("run", F.lit(0))).otherwise(F.col("mark.tail") + F.col("run") - F.col("mark.upto")))
    last = s.groupBy("path", "group").agg(F.max("block").alias("block"), F.sum("seps").alias("group_seps"))
    ends = part.join(last, ["path", "group", "block"]).select(
        "path", "group", "group_seps",
        F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("carry_in") + F.col("head")).alias("group_tail"),
    )
    over = Window.partitionBy("path").orderBy("group")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.sum(F.when(F.col("group_seps") == 0, F.col("group_tail")).otherwise(F.lit(0)))
    groups = ends.withColumns({
        "seps_before": F.coalesce(F.sum("group_seps").over(earlier), F.lit(0)),
        "grun": F.coalesce(open_.over(earlier), F.lit(0)),
        "gmark": F.last(F.when(F.col("group_seps") > 0, F.struct(F.col("group_tail").alias("tail"), open_.over(over).alias("upto"))), True).over(earlier),
    }).select("path", "group", "seps_before", F.when(F.col("gmark").isNull(), F.col("grun")).otherwise(F.col("gmark.tail") + F.col("grun") - F.col("gmark.upto")).alias("carry_before"))
    return part.join(groups, ["path", "group"]).select(
        "path", "block", "seps", "head", "tail",
        (F.col("seps_in") + F.col("seps_before")).alias("docs_before"),
        (F.col("carry_in") + F.when(F.col("seps_in") == 0, F.col("carry_before")).otherwise(F.lit(0))).alias("carry"),
    )


def counts(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """scanned() blocks to (path, doc, n_tokens): doc numbers the documents of a file from 0. found is read twice.

    Sizes are exploded after the join, and neither side is ever broadcast: files tell little of how many documents are in them.
    """
    s = _stitched(found.select("path", "block", "seps", "head", "tail"))
    spanning = s.where("seps > 0").select("path", F.col("docs_before").alias("doc"), (F.col("carry") + F.col("head")).alias("n_tokens"))
    inner = found.where("seps > 1").select("path", "block", "sizes").hint("merge").join(s.select("path", "block", "docs_before"), ["path", "block"])
    inner = inner.select("path", "docs_before", F.posexplode("sizes").alias("k", "n_tokens")).select("path", (F.col("docs_before") + 1 + F.col("k")).alias("doc"), "n_tokens")
    last = s.groupBy("path").agg(F.max_by(F.struct((F.col("docs_before") + F.col("seps")).alias("doc"), F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("head")).alias("n_tokens")), "block").alias("e"))
    return spanning.union(inner).union(last.select("path", "e.doc", "e.n_tokens").where("n_tokens > 0"))


def write(docs: DataFrame, folder: str, encode, dtype: str, end: int) -> DataFrame:
    """Writes docs(doc_id, text), in files below folder, as token files; rows (path, size, doc, doc_id).

    encode, a function without arguments, makes the function from texts to lists of ids. A task writes one file
    under a name of its own, so a task that runs again leaves a file that no row names. The rows must be
    materialized before use.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, path = encode(), f"{folder}/{uuid.uuid4().hex}.bin"
        system, place = opened(path)
        system.create_dir(os.path.dirname(place), recursive=True)
        doc = size = 0
        with system.open_output_stream(place) as f:
            for batch in batches:
                ids = one([t or "" for t in batch.column(1).to_pylist()])
                data = b"".join(np.array([*x, end], np.dtype(dtype).newbyteorder("<")).tobytes() for x in ids)
                f.write(data)
                size += len(data)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array([size] * n, pa.int64()), pa.array(range(doc, doc + n), pa.int64()), batch.column(0).cast(pa.int64())], names=["path", "size", "doc", "doc_id"]
                )
                doc += n

    return docs.select("doc_id", "text").mapInArrow(run, "path string, size long, doc long, doc_id long")
