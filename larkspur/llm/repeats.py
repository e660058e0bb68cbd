"""Suffix-array dedup: remove every byte covered by a string of LENGTH bytes that starts anywhere else too.

Candidates. Every window of LENGTH bytes owns the q-gram in it of least hash, the leftmost at ties; which one
that is depends on the window's bytes alone, so equal windows own equal q-grams at equal offsets. Runs of
windows with the same q-gram make one record: some n / 77 for n bytes. Records are counted by q-gram with
partial aggregates; a q-gram met once leads nowhere. Records with equal bytes (by 128 bits of BLAKE2) are copies of
one kind; each kind is sorted once, and a suffix of a kind with copies stands for several.

Sorting. The suffixes of all kinds of a q-gram are sorted by bucket-pointer refinement: buckets of 8-grams are made
first; a bucket of two or more is sorted by the bucket ids at the offset up to which its members agree, and what it becomes is at once what
later buckets point to, so that the depth up to which a bucket agrees grows by that of the buckets it points to. Buckets are taken from
the ends of the kinds to their begins, so that most point to finished ones and are finished by one sort. Buckets of one are left
alone. Windows that stand next to each other in the end are compared byte by byte; equal ones are repeated, as are those that stand for
several. That verdict goes back to all records of the kind. A task sorts whole q-gram groups, packed in batches in which each q-gram
has buckets of its own. A group of more than GROUP kinds takes another exact way: its windows are counted as rows.

Kinds with more than a thousandth of the records, a thousand at most, reach their records by broadcast, the rest by a
shuffle, so no kind fills a task. A null text is empty. Rows whose doc_id is null or repeated are told apart by a key of their own,
so each row counts as a document. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.bytes import mix, powers
from larkspur.llm.common import materialize

LENGTH = 200
GRAM = 48
#: Kinds of one q-gram that a task sorts at most (some 300 bytes each).
GROUP = 20_000
#: Bytes that are sorted at once.
BATCH = 1 << 20
#: Bytes of the initial buckets; most parts in which a round refines its buckets, each with what the parts before have found.
FIRST, PARTS = 8, 48
#: Kinds with more than one in so many records are broadcast.
HOT = 1_000


def records(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(q-gram hash, two halves of the digest, first window, last window) of the runs of windows that own one q-gram."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 5
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = n - GRAM + 1
    g = mix((sums[GRAM:] - sums[:grams]) * down[:grams])
    low = np.uint64((1 << n.bit_length()) - 1)
    least = (g & ~low) | np.arange(grams, dtype=np.uint64)
    reach, width = LENGTH - GRAM + 1, 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[reach - width :][: n - LENGTH + 1])
    anchor = (least & low).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    hi = np.concatenate([lo[1:] - 1, [n - LENGTH]])
    at = anchor[lo]
    text, shift = data.tobytes(), at - lo
    digests = b"".join(
        hashlib.blake2b(text[i:j], digest_size=16, salt=k.to_bytes(8, "little")).digest() for i, j, k in zip(lo.tolist(), (hi + LENGTH).tolist(), shift.tolist(), strict=True)
    )
    halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return g[at].view(np.int64), halves[:, 0], halves[:, 1], lo, hi


def sorted_windows(data: np.ndarray, starts: np.ndarray, needed: np.ndarray, room: np.ndarray | None = None, group: np.ndarray | None = None) -> np.ndarray:
    """starts in order of the suffixes of data that begin there, by bucket-pointer refinement.

    needed has, for each place in data, the bytes from there on that count; a bucket is refined as long as one of its
    members needs it. room has the bytes up to the end of the place's record, all data if None: buckets with less of it
    come first. group has small numbers of 16 bits; if given, the suffixes of each group stand together.
    """
    n = len(data)
    room = n - np.arange(n) if room is None else room
    words = words_at(data)
    at = np.argsort(words, kind="stable")
    new = np.concatenate([[True], words[at[1:]] != words[at[:-1]]])
    if group is not None:
        at = at[np.argsort(group[at], kind="stable")]
        new = np.concatenate([[True], (words[at[1:]] != words[at[:-1]]) | (group[at[1:]] != group[at[:-1]])])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, n))
    # the id of a bucket is the place of its first member in the order, so that a part keeps the ids of its bucket
    bucket, depth = np.empty(n, np.int64), np.full(n, FIRST)
    bucket[at] = np.repeat(head, size)
    open_ = _unfinished(at, head, size, depth, needed)
    stretch = max(FIRST, -(-(int(room.max()) + 1) // PARTS))
    while len(open_):
        ids = bucket[open_]
        head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        part = np.repeat((np.maximum.reduceat(room[open_], head) // stretch).astype(np.uint8), np.diff(np.append(head, len(open_))))
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        open_ = np.concatenate([_refine(at, bucket, depth, needed) for at in np.split(open_[order], cuts)])
    return starts[np.argsort(bucket[starts], kind="stable")]


def _unfinished(at: np.ndarray, head: np.ndarray, size: np.ndarray, depth: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """The members, at in order, of the buckets of two or more that agree in fewer bytes than one of them needs."""
    wants = np.maximum.reduceat(needed[at], head) > depth[at[head]]
    return at[np.repeat((size > 1) & wants, size)]


def _refine(at: np.ndarray, bucket: np.ndarray, depth: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Sorts the members at of whole buckets by the buckets they point to, in place; gives the unfinished ones in order."""
    n = len(bucket)
    target = at + depth[at]
    inside = target < n
    there = np.minimum(target, n - 1)
    # what ends before its target comes first and stands alone
    pointer = np.where(inside, bucket[there], at - n)
    gain = np.where(inside, depth[there], 0)
    order = np.argsort(bucket[at] * (2 * n + 1) + pointer + n, kind="stable")
    at, pointer, gain = at[order], pointer[order], gain[order]
    own = bucket[at]
    fresh = np.concatenate([[True], own[1:] != own[:-1]])
    new = fresh | np.concatenate([[True], pointer[1:] != pointer[:-1]])
    head, first = np.flatnonzero(new), np.flatnonzero(fresh)
    size = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    bucket[at] = own + np.repeat(place[head], size)
    depth[at] += gain
    return _unfinished(at, head, size, depth, needed)


def words_at(data: np.ndarray) -> np.ndarray:
    """The FIRST bytes from each place on, as big-endian numbers; zeros follow the end."""
    long = np.concatenate([data, np.zeros(FIRST - 1, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(FIRST):
        out = (out << np.uint64(8)) | long[k : k + len(data)]
    return out


def refined(data: np.ndarray, starts: np.ndarray, room: np.ndarray | None = None, group: np.ndarray | None = None) -> np.ndarray:
    """Which of starts begin a LENGTH-byte string that another of starts, in the same group, begins too.

    starts are at least LENGTH bytes before the end of data. Neighbours in the order are compared byte by byte.
    """
    if room is None:
        room = len(data) - np.arange(len(data))
    at = sorted_windows(data, starts, np.minimum(room, LENGTH), room, group)
    words = words_at(data)
    pair = np.arange(len(at) - 1)
    if group is not None:
        pair = pair[group[at[:-1]] == group[at[1:]]]
    for k in [*range(0, LENGTH - FIRST, FIRST), LENGTH - FIRST]:
        pair = pair[words[at[pair] + k] == words[at[pair + 1] + k]]
    hit = np.zeros(len(data), bool)
    hit[at[pair]] = hit[at[pair + 1]] = True
    return hit[starts]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a column _key that tells rows apart: doc_id, where it is set and never repeated."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)))
    return materialize(docs.withColumn("_key", F.monotonically_increasing_id()), "keyed")


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _records(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                gram, a, b, lo, hi = records(np.frombuffer(_encoded(text.as_py()), np.uint8))
                parts.append((gram, a, b, np.full(len(lo), key, np.int64), lo, hi - lo))
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns[:4]), pa.array(columns[4].astype(np.int32)), pa.array(columns[5].astype(np.int32))],
                names=["gram", "a", "b", "_key", "lo", "more"],
            )

    return rows.mapInArrow(run, "gram long, a long, b long, _key long, lo int, more int")


#: A kind of a q-gram: how many records it has, and where its first one stands.
_KIND = "gram long, a long, b long, held long, _key long, lo int"
_FIELDS = [("gram", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("held", pa.int64()), ("_key", pa.int64()), ("lo", pa.int32())]


def _cut(rows: DataFrame) -> DataFrame:
    """rows(_key, text, wanted) to the kinds wanted, with their bytes."""
    schema = pa.schema([*_FIELDS, ("big", pa.bool_()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = _encoded(text.as_py())
                pieces = [{**w, "_key": key, "data": data[w["lo"] : w["lo"] + w["more"] + LENGTH]} for w in wanted.as_py()]
                yield pa.RecordBatch.from_pylist(pieces, schema=schema)

    return rows.mapInArrow(run, f"{_KIND}, big boolean, data binary")


def _spans(pieces: list[tuple]) -> pa.RecordBatch:
    """Sorts pieces (kind's columns, data) that come by q-gram, and gives the spans of repeated windows in each."""
    data = np.frombuffer(b"".join(p[-1] for p in pieces), np.uint8)
    sizes = np.array([len(p[-1]) for p in pieces])
    begins = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(pieces)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    # bytes of other records say nothing of a window's place
    room = np.repeat(begins + sizes, sizes) - np.arange(len(data))
    grams = np.array([p[0] for p in pieces])
    group = np.repeat(np.cumsum(np.concatenate([[False], grams[1:] != grams[:-1]])).astype(np.uint16), sizes)
    several = np.array([p[3] > 1 for p in pieces])
    hit = np.flatnonzero(refined(data, begins[owner] + within, room, group) | several[owner])
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]) if len(hit) else np.zeros(0, bool)
    first, last = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] if len(hit) else hit
    kinds = [pieces[k] for k in owner[first]]
    columns = [pa.array([p[k] for p in kinds], kind) for k, (_, kind) in enumerate(_FIELDS)]
    ends = [pa.array(within[first].astype(np.int32)), pa.array((within[last] + LENGTH).astype(np.int32))]
    return pa.RecordBatch.from_arrays([*columns, *ends], names=[*(name for name, _ in _FIELDS), "start", "stop"])


def _sorted(pieces: DataFrame) -> DataFrame:
    """Spans of repeated windows in the kinds of pieces; rows come clustered by gram, whole groups go to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        group: list[tuple] = []
        gram, total = None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != gram:
                    done += group
                    group, gram = [], row[0]
                    if total >= BATCH:
                        yield _spans(done)
                        done, total = [], 0
                group.append(row)
                total += len(row[-1])
        done += group
        if done:
            yield _spans(done)

    one = pieces.select(*(name for name, _ in _FIELDS), "data").repartition("gram").sortWithinPartitions("gram")
    return one.mapInArrow(run, f"{_KIND}, start int, stop int")


def _counted(pieces: DataFrame) -> DataFrame:
    """Spans in the kinds of very large groups: each window is a row, repeated ones are found by counting."""
    names = [name for name, _ in _FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = row[-1]
                starts = range(len(data) - LENGTH + 1)
                marks = [hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest() for i in starts]
                kind = [pa.array([row[k]] * len(marks), t) for k, (_, t) in enumerate(_FIELDS)]
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), *kind, pa.array(starts, pa.int32())], names=["mark", *names, "start"])

    rows = materialize(pieces.select(*names, "data").mapInArrow(run, f"mark binary, {_KIND}, start int"), "windows")
    repeated = materialize(rows.groupBy("mark").agg(F.sum("held").alias("n")).where("n > 1").select("mark"), "marks")
    return rows.join(repeated, "mark", "left_semi").select(*names, "start", (F.col("start") + LENGTH).alias("stop"))


def spans(rows: DataFrame) -> DataFrame:
    """rows(_key, text) to (_key, spans): the sorted, possibly overlapping spans of bytes to remove."""
    found = materialize(_records(rows.select("_key", "text")), "records")
    # written first: a join of two plain exchanges is one whose hot partitions Spark can split
    grams = materialize(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    shared = materialize(found.join(grams, "gram", "left_semi"), "shared")
    kind = ["gram", "a", "b"]
    kinds = materialize(shared.groupBy(*kind).agg(F.count("*").alias("held"), F.min(F.struct("_key", "lo", "more")).alias("at")), "kinds")
    groups = kinds.groupBy("gram").agg(F.count("*").alias("kinds"))
    todo = kinds.join(groups.select("gram", (F.col("kinds") > GROUP).alias("big")), "gram")
    wanted = todo.groupBy(F.col("at._key").alias("_key")).agg(F.collect_list(F.struct(*kind, "held", "big", "at.lo", "at.more")).alias("wanted"))
    pieces = materialize(_cut(rows.select("_key", "text").join(wanted, "_key").select("_key", "text", "wanted")), "pieces")
    verdicts = materialize(_sorted(pieces.where("NOT big")).union(_counted(pieces.where("big"))), "verdicts")
    lone = verdicts.where("held = 1").select("_key", (F.col("lo") + F.col("start")).alias("start"), (F.col("lo") + F.col("stop")).alias("stop"))
    limit = shared.count() // HOT
    copied = verdicts.where("held > 1").drop("_key", "lo")
    span = lambda d: d.select("_key", (F.col("lo") + F.col("start")).alias("start"), (F.col("lo") + F.col("stop")).alias("stop"))
    # kinds of more than a thousandth of all records are a thousand at most
    hot = span(shared.join(F.broadcast(copied.where(F.col("held") > limit)), kind))
    rest = shared.join(F.broadcast(kinds.where(F.col("held") > limit).select(*kind)), kind, "left_anti").join(copied.where(F.col("held") <= limit), kind)
    every = lone.union(hot).union(span(rest))
    return every.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def kept_parts(data: bytes, found: list[dict] | None) -> tuple[list[bytes], int, int]:
    """The kept pieces of data, the bytes removed and the number of maximal removed runs."""
    parts, at, removed, runs, end = [], 0, 0, 0, -1
    for s in found or ():
        if s["start"] > end:
            runs += 1
            parts.append(data[at : s["start"]])
            removed -= s["start"]
            at = end = s["stop"]
            removed += s["stop"]
        elif s["stop"] > end:
            removed += s["stop"] - end
            at = end = s["stop"]
    parts.append(data[at:])
    return parts, removed, runs


def _with_spans(rows: DataFrame) -> DataFrame:
    return rows.join(spans(rows), "_key", "left")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = _encoded(text.as_py())
                parts, removed, runs = kept_parts(data, found.as_py())
                out.append((len(data), removed, runs, hashlib.sha256(b"".join(parts)).hexdigest()))
            n, removed, runs, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return _with_spans(rows).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from text, columns as they were; n_chars follows the text if it is there.

    Cuts are of bytes; what they leave of a split character is dropped. A null text stays null.
    """

    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = batch.column(0).flatten(), []
            for text, found in zip(columns[at], batch.column(1), strict=True):
                t = text.as_py()
                texts.append(t if t is None or not found.is_valid else b"".join(kept_parts(_encoded(t), found.as_py())[0]).decode("utf-8", "ignore"))
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # the columns travel as one, so that none of theirs meets one of ours
    rows = keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    out = rows.join(spans(rows), "_key", "left").select("row", "spans").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
