"""N-gram Jaccard join with token-combination prefixes; exact links, components without a pair for each copy.

Tokens are hashes of word shingles. Documents with equal token sets form a class and one stands for all.

1. Prefixes: a document's tokens stand in one order for all (longer shingles first, then by hash). Prefixes are
   extended so that two sets that link share m tokens within both. The tokens are indexed singly; a token that
   at most RARE classes have in their prefix gives its pairs, which count if they meet often enough: m times, less
   the frequent tokens that the two may share as well.
2. A token that more classes have is frequent. Documents with m frequent tokens in the prefix are indexed by
   combinations of tokens too: the prefix is extended to the whole set, which is split by hash into more parts
   than the tokens in which two linked sets of that size can differ, and the combination of all tokens of a
   part is one key. So linked sets share a key, and texts that only share a passage share none. Sizes are put in
   classes; a set is split for its own size class and for the next one.
3. Small groups of a combination give all pairs. A large group gives pairs with one pivot; these are verified and
   merged into components. Large groups that still hold several components are joined to clusters, one size class
   at a time, whose sets are compared in blocks: a task holds two blocks of bounded size, counts all overlaps as
   products of incidence matrices and gives only the links that merge components.
4. Candidates are verified on whole sets, made again from the texts.

Of the m tokens that linked sets share in their prefixes all are frequent, or one is rare: step 2 covers the
first case, step 1 the second, so no link is lost.

Tokens that one in a hundred classes or more have in their prefix, some dozens a class at most, are found and counted before
the shuffle and get their counts by broadcast, so that no task holds the rows of such a token.

Null and empty texts have no tokens and link with nothing. Rows with one doc_id are one document, come back
once, and have the largest of their texts; rows without doc_id come back each, with their n_shingles and without a
component, as nothing names them. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.bytes import mix, shingles
from larkspur.llm.common import materialize
from larkspur.llm.components import components

#: A token or combination held by at most so many classes gives all their pairs.
RARE = 16
#: Tokens that a class in so many or more has are counted before the shuffle; looked for in batches at twice that rate.
HOT = 100
#: Ids of candidate documents are broadcast up to this many (some 20 MB), so that only candidates' texts are shuffled.
BROADCAST_IDS = 200_000
#: Sets and tokens of a block; columns of an incidence matrix that are multiplied at once.
BLOCK_SETS, BLOCK_TOKENS, COLUMNS = 800, 1_000_000, 8_192


def tokens(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of a text in the common order, and the shingles' byte lengths (255 at most)."""
    h, n = shingles(text or "", size)
    h, first = np.unique(h, return_index=True)
    n = np.minimum(n[first], 255)
    order = np.lexsort((h, -n))
    return h[order], n[order]


def at_least(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set it links with: 100 * i >= percent * u and u >= n."""
    return -(-percent * n // 100)


def shared_least(n: int) -> int:
    """m: how many tokens linked sets share within their prefixes, the smaller having n tokens."""
    return 1 + n // 40


def apart(n: int, percent: int) -> int:
    """Most tokens in which a set of up to n and a linked one of up to n differ."""
    return (100 - percent) * 2 * n // (100 + percent)


def size_class(n: int, percent: int) -> int:
    """Classes of sizes, such that linked sets are in the same or in neighbouring classes."""
    k, top = 0, 1
    while n > top:
        k, top = k + 1, max(top + 1, 100 * top // percent)
    return k


def class_top(k: int, percent: int) -> int:
    top = 1
    for _ in range(k):
        top = max(top + 1, 100 * top // percent)
    return top


def combinations(h: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts of a token set, for its size class and the next, and these classes."""
    own = size_class(len(h), percent)
    keys, classes = [], []
    for k in (own, own + 1):
        # two linked sets, the larger in class k, differ in at most d tokens
        d = apart(class_top(k, percent), percent)
        spare = 2 + d // 8
        parts = d + 1 + spare
        of = (mix(h + np.uint64(k)) % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, of, mix(h))
        held = np.bincount(of, minlength=parts)
        full = np.flatnonzero(held)
        keys.append(mix(sums[full] ^ mix((full + 1 + (k << 32)).astype(np.uint64))))
        if parts - len(full) > spare:  # the parts that agree may all be empty ones
            keys.append(mix(np.array([(k << 32) | 0xFFFFFFFF], np.uint64)))
        classes.append(np.full(sum(map(len, keys)) - sum(map(len, classes)), k, np.int64))
    return np.concatenate(keys).view(np.int64), np.concatenate(classes)


def profiles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n, digest, prefix): set size, digest of the set, prefix tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, digests, values, offsets = [], [], [], [], [0]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, _ = tokens(text.as_py(), size)
                ids.append(doc)
                ns.append(len(h))
                digests.append(hashlib.blake2b(np.sort(h).tobytes(), digest_size=16).digest())
                p = h[: len(h) - at_least(len(h), percent) + shared_least(len(h))]
                values.append(p.view(np.int64))
                offsets.append(offsets[-1] + len(p))
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                names=["doc_id", "n", "digest", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, prefix array<long>")


def combination_keys(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """texts(doc_id, text) to (key, doc, n, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in range(4)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, _ = tokens(text.as_py(), size)
                keys, classes = combinations(h, percent)
                for column, x in zip(out, (keys, np.full(len(keys), doc), np.full(len(keys), len(h)), classes), strict=True):
                    column.append(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["key", "doc", "n", "k"])

    return texts.select("doc_id", "text").mapInArrow(run, "key long, doc long, n long, k long")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs(a, b) whose texts(doc_id, text) link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)  # rows come sorted by b: the set of a pivot is made once
        for batch in batches:
            left, right = [], []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if last[0] != b:
                    last = (b, np.unique(shingles(tb.as_py(), size)[0]))
                x, y = np.unique(shingles(ta.as_py(), size)[0]), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can link."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def group_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """All pairs of groups(key, members), each of a bounded number of members struct(doc, n, f)."""
    first = groups.select("members", F.posexplode("members").alias("i", "x"))
    pair = first.select("x", F.explode(F.expr("slice(members, i + 2, size(members))")).alias("y"))
    return pair.where(near("x.n", "y.n", percent)).select(
        F.greatest("x.doc", "y.doc").alias("a"), F.least("x.doc", "y.doc").alias("b"), F.least("x.n", "y.n").alias("n"), F.least("x.f", "y.f").alias("f")
    )


def hot_tokens(reps: DataFrame) -> DataFrame:
    """(key, held, pivot) of the tokens in reps(doc_id, n, prefix) that one in HOT rows or more have; their number is bounded by HOT
    times the mean prefix.

    A token that is so frequent is as frequent in some batch, so batches name the candidates; all rows count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, times = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values[times >= max(2, batch.num_rows // (2 * HOT))], pa.int64())], names=["key"])

    named = materialize(reps.select("prefix").mapInArrow(run, "key long").distinct(), "hot")
    rows = reps.select(F.explode("prefix").alias("key"), F.col("doc_id").alias("doc"), "n")
    known = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    counted = rows.join(known, "key", "left_semi").groupBy("key").agg(F.count("*").alias("held"), F.min(F.struct("doc", "n")).alias("pivot"))
    return materialize(counted.where((F.col("held") > RARE) & (F.col("held") * HOT >= reps.count())), "hot")


def grouped(index: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """index(key, doc, n) with the group's size and its least member, for groups of two or more; one shuffle of all but the hot keys."""
    rest = index if hot is None else index.join(F.broadcast(hot.select("key")), "key", "left_anti")
    dealt = rest.repartition("key")
    sizes = dealt.groupBy("key").agg(F.count("*").alias("held"), F.min(F.struct("doc", "n")).alias("pivot")).where("held > 1")
    out = dealt.join(sizes, "key")
    return out if hot is None else out.unionByName(index.join(F.broadcast(hot), "key"))


def collected(index: DataFrame) -> DataFrame:
    """Groups of at most RARE members as arrays."""
    return index.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("doc", "n", "f"))).alias("members"))


def single(rows: DataFrame) -> DataFrame:
    """One row for each doc_id, and each of those without one. Texts are only grouped where an id is repeated."""
    repeated = rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return rows
    merged = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    return rows.join(repeated, "doc_id", "left_anti").unionByName(merged)


def join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_shingles, component_id)."""
    rows = single(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = materialize(profiles(rows, size, percent), "profiles")
    # classes of equal sets; sets without tokens stay alone
    classes = found.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"))
    reps = materialize(found.join(classes.select("digest", F.col("doc").alias("doc_id")), ["digest", "doc_id"], "left_semi").select("doc_id", "n", "prefix"), "reps")
    index = reps.select(F.explode("prefix").alias("key"), F.col("doc_id").alias("doc"), "n")
    shared = materialize(grouped(index, hot_tokens(reps)), "shared")
    frequent = shared.where(F.col("held") > RARE).groupBy("doc").agg(F.count("*").alias("f"), F.first("n").alias("n"))
    frequent = materialize(frequent, "frequent")
    # the smaller of two linked sets, one of which has n tokens, has percent of n at least
    hot = frequent.where(F.col("f") >= 1 + F.expr(f"({percent} * n + 99) DIV 100 DIV 40")).select("doc")
    few = shared.where(F.col("held") <= RARE).join(frequent.select("doc", "f"), "doc", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    met = group_pairs(collected(few), percent).groupBy("a", "b").agg(F.count("*").alias("c"), F.first(1 + F.expr("n DIV 40") - F.col("f")).alias("least"))
    rare = materialize(met.where("c >= least").select("a", "b"), "pairs")
    involved = rare.select(F.explode(F.array("a", "b")).alias("doc_id")).union(hot.select("doc")).distinct()
    involved = materialize(involved, "involved")
    texts = materialize(rows.join(F.broadcast(involved) if involved.count() <= BROADCAST_IDS else involved, "doc_id", "left_semi"), "texts")
    combos = combination_keys(texts.join(hot.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi"), size, percent)
    parts = materialize(grouped(combos), "parts")
    small = group_pairs(collected(parts.where(F.col("held") <= RARE).withColumn("f", F.lit(0))), percent).select("a", "b")
    many = parts.where(F.col("held") > RARE)
    star = many.where("doc != pivot.doc").where(near("n", "pivot.n", percent)).select(F.col("doc").alias("a"), F.col("pivot.doc").alias("b"))
    pairs = materialize(rare.union(small).union(star).distinct(), "pairs")
    links = materialize(verified(pairs, texts, size, percent), "links")
    comps = materialize(components(links), "components")
    across = materialize(block_links(many, comps, texts, size, percent), "links")
    if not across.isEmpty():
        comps = materialize(components(links.union(across)), "components")
    merged = classes.join(comps.withColumnRenamed("node", "doc"), "doc", "left").select("digest", F.coalesce("component", "doc").alias("component"))
    return found.join(merged, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id")
    )


def keep_first(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """docs with one row of each group of linked documents, the one of least doc_id; rows without doc_id stay."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        best = Window.partitionBy("doc_id").orderBy(F.col("text").desc_nulls_last())
        again = docs.join(repeated, "doc_id", "left_semi").withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")
        docs = docs.join(repeated, "doc_id", "left_anti").unionByName(again)
    late = join(docs, size, percent).where("doc_id != component_id").select("doc_id")
    return docs.join(late, "doc_id", "left_anti")


def block_links(many: DataFrame, comps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components that meet in a large group: many(key, doc, n, k), by blocks of clusters of groups."""
    placed = many.select("key", "doc", "n", "k").join(comps.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    rest = materialize(placed.join(mixed, "key").withColumn("node", F.xxhash64("doc", "k")), "mixed")
    heads = rest.groupBy("key").agg(F.min("node").alias("b"))
    clusters = components(rest.join(heads, "key").select(F.col("node").alias("a"), "b").where("a != b")).select("node", F.col("component").alias("cluster"))
    members = materialize(rest.select("node", "doc", "n", "component").distinct().join(clusters, "node"), "members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    dealt = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    rows = dealt.join(texts.withColumnRenamed("doc_id", "doc"), "doc").select("cluster", "block", "doc", "component", "text", other)
    pairs = rows.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc", "component", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != group:
                    if held:
                        yield _linked(group, held, size, percent)
                    group, held = row[:3], []
                held.append((*row[3:6], np.unique(shingles(row[6] or "", size)[0])))
        if held:
            yield _linked(group, held, size, percent)

    by = ["cluster", "lo", "hi"]
    return pairs.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def _linked(group: tuple, held: list[tuple], size: int, percent: int) -> pa.RecordBatch:
    """Links among held (block, doc, component, set) that merge components: across two blocks, or within one."""
    left = [r for r in held if r[0] == group[1]]
    right = [r for r in held if r[0] == group[2]]
    both = overlaps([r[3] for r in left], [r[3] for r in right])
    n, m = (np.array([len(r[3]) for r in side]) for side in (left, right))
    linked = (both > 0) & (100 * both >= percent * (n[:, None] + m[None, :] - both))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    a, b = [], []
    for i, j in np.argwhere(linked):
        x, y = find(left[i][2]), find(right[j][2])
        if x != y:
            root[x] = y
            a.append(left[i][1])
            b.append(right[j][1])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the sets in left with those in right."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not left or not right:
        return out
    flat = [np.concatenate(side) for side in (left, right)]
    common = np.intersect1d(*flat)
    at, row = [], []
    for side, values in zip((left, right), flat, strict=True):
        place = np.searchsorted(common, values)
        kept = np.flatnonzero(common[np.minimum(place, len(common) - 1)] == values) if len(common) else np.zeros(0, np.int64)
        at.append(place[kept])
        row.append(np.repeat(np.arange(len(side)), [len(x) for x in side])[kept])
    for start in range(0, len(common), COLUMNS):
        parts = []
        for k, side in enumerate((left, right)):
            here = (at[k] >= start) & (at[k] < start + COLUMNS)
            part = np.zeros((len(side), min(COLUMNS, len(common) - start)), np.float32)
            part[row[k][here], at[k][here] - start] = 1
            parts.append(part)
        out += np.rint(parts[0] @ parts[1].T).astype(np.int64)
    return out
