"""Language-model scores by Katz backoff: Good-Turing discounted n-gram counts, exactly normalised backoff weights.

Documents are read once into blocks of some millions of tokens: hashed words and, for each token, its place among them. All later
steps work on blocks, so that an n-gram travels once a block, not once an occurrence:

1. A block sends each distinct n-gram of every order with its count in training documents to the n-gram's bucket, a range of hashes.
2. A bucket adds up the counts, stores them as a part of the count table, and answers every block; the first block that trains an
   n-gram owns it.
3. Discounts follow from the counts of counts. A token takes the discounted relative frequency of its longest known n-gram. Each
   context that is passed on the way down multiplies it by its weight. For the n-grams that it owns, a block sends what they leave to
   unseen words, and their probability in the next shorter context, to the bucket of their context.
4. A bucket turns these sums into weights: (1 - sum of discounted frequencies) / (1 - sum of the shorter context's probabilities). It
   stores them as a part of the weight table and answers the blocks that asked.

No key is hot, as any block sends it once; a bucket holds some two million entries at most as expected. Counts r of up to 5 are
discounted as Katz does, (r* / r - m) / (1 - m) with r* = (r + 1) n[r + 1] / n[r] and m = 6 n[6] / n[1]; larger ones, and all where
that leaves the open interval (0, 1), by the line log n[r] = a + b log r, (1 + 1 / r) ** (b + 1). So every context keeps something for
unseen words and no score is infinite. All words never seen in training are one class; a text starts after a context of its own.

Words and n-grams are known by 64 bits of a hash: of two billion distinct ones, 0.1 pairs are expected to collide.

Defined cases: a null text is empty and holds the end token alone; a null doc_id counts as an empty one; null or repeated ids each get
a row. Without training tokens every score is 0, and the base score too. Columns but id and text are not read. A text of any length
is one block at least; its memory grows with the longest text of a block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.bytes import LONG_WORD, LOWER, mix, range_hashes, words
from larkspur.llm.common import discard, materialize

#: Tokens of a block, and entries of a bucket, on the average.
BLOCK, BUCKET = 1 << 21, 1 << 21
#: Counts of counts up to here reach the driver.
SPECTRUM = 64
#: Counts up to here are discounted by Turing's estimate.
RELIABLE = 5
END, START, EMPTY = (np.uint64(x) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D))
_STEP = np.uint64(0xFF51AFD7ED558CCD)
_SLICE = 1 << 20

CODED = "block long, n_tokens long, ids binary, words binary, lengths binary, held binary, doc_ids array<long>"
ASKED = "bucket int, block long, keys binary, counts binary"
COUNTED = "bucket int, block long, answer binary, keys binary, counts binary, spectrum array<long>, types long, total long"
PARTIAL = "block long, bucket int, keys binary, left binary, lower binary, wanted binary, docs array<struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base_score:double,score:double>>, pending_doc binary, pending_at binary"
WEIGHED = "bucket int, block long, answer binary, keys binary, weights binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Scored(NamedTuple):
    """Scores of documents, and the tables of the model: (level, key, count) and (level, key, log10 of the backoff weight)."""

    scores: DataFrame
    grams: DataFrame
    weights: DataFrame


def pack(a: np.ndarray) -> bytes:
    """An array byte by byte of significance, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1) if len(a) else b""


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def token_hashes(text: str) -> np.ndarray:
    """Hashes of the words of text, A-Z lower-cased, and the end token."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    starts, ends = words(data)
    out = np.full(len(starts) + 1, END)
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(ends, starts[at] + _SLICE, "right"))
        if to > at:  # else a word as long as a slice
            out[at:to] = range_hashes(data[starts[at] : ends[to - 1]], starts[at:to] - starts[at], ends[at:to] - starts[at])
        at = max(to, at + 1)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def _code(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Documents (doc_id, text, held) as blocks."""

    def block(name: int, hashes: list, ids: list, held: list) -> pa.RecordBatch:
        known, places = np.unique(np.concatenate(hashes), return_inverse=True)
        lengths = np.array([len(h) for h in hashes], np.uint32)
        row = {"block": [name], "n_tokens": [len(places)], "ids": [pack(places.astype(np.uint32))], "words": [pack_sorted(known)], "lengths": [pack(lengths)], "held": [pack(np.array(held, np.uint8))]}
        return pa.record_batch({**{k: pa.array(v, pa.binary() if isinstance(v[0], bytes) else pa.int64()) for k, v in row.items()}, "doc_ids": pa.array([ids], pa.list_(pa.int64()))})

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total, hashes, ids, held = TaskContext.get().partitionId() << 32, 0, [], [], []
        for batch in batches:
            for doc, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                hashes.append(token_hashes(text.as_py()))
                ids.append(doc)
                held.append(out)
                total += len(hashes[-1])
                if total >= block_tokens:
                    yield block(name, hashes, ids, held)
                    name, total, hashes, ids, held = name + 1, 0, [], [], []
        if hashes:
            yield block(name, hashes, ids, held)

    return docs.mapInArrow(code, CODED)


class _Block:
    """A decoded block: the n-gram that ends at every token and its context, by level."""

    def __init__(self, row: dict, order: int) -> None:
        self.tokens = unpack_sorted(row["words"])[unpack(row["ids"], np.uint32)]
        self.lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.held = unpack(row["held"], np.uint8).astype(bool)
        self.grams, self.contexts, pad = [self.tokens], [np.full(len(self.tokens), EMPTY)], START
        for _ in range(order - 1):
            context = np.roll(self.grams[-1], 1)
            context[self.starts] = pad
            self.contexts.append(context)
            self.grams.append(mix(context * _STEP + self.tokens))
            pad = mix(np.array([pad * _STEP + START]))[0]


def _spans(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Buckets of sorted keys, with where each begins and ends; a bucket is a range of keys."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(of)) + 1
    for a, b in zip([0, *edges], [*edges, len(keys)]):
        if b > a:
            yield int(of[a]), int(a), int(b)


def _table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [(f.split(" ", 1)[0], kinds.get(f.split(" ", 1)[1], _DOCS)) for f in schema.split(", ")]
    return pa.table({n: pa.array([r.get(n) for r in rows], k) for n, k in fields}, schema=pa.schema(fields))


_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))


def _ask(coded: DataFrame, order: int, buckets: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                b = _Block(one, order)
                trains = np.repeat(~b.held, b.lengths)
                for level, grams in enumerate(b.grams):
                    keys, which = np.unique(grams, return_inverse=True)
                    counts = np.bincount(which[trains], minlength=len(keys)).astype(np.uint32)
                    rows = [{"bucket": level * buckets + k, "block": one["block"], "keys": pack_sorted(keys[x:y]), "counts": pack(counts[x:y])} for k, x, y in _spans(keys, buckets)]
                    yield from _table(rows, ASKED).to_batches()

    return coded.select("block", "ids", "words", "lengths", "held").mapInArrow(ask, ASKED)


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The distinct keys of several rows, the place of every entry among them, entries in order of keys, and where rows begin."""
    parts = [unpack_sorted(r["keys"]) for r in rows]
    keys, which = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, which, np.argsort(which, kind="stable"), [0, *np.cumsum([len(p) for p in parts])]


def _count(rows: pa.Table) -> pa.Table:
    """Counts of one bucket: a part of the table, and answers to blocks: twice the count, one more for the owner."""
    asks = sorted(rows.to_pylist(), key=lambda r: r["block"])
    keys, which, order, edges = _merged(asks)
    counts = np.concatenate([unpack(r["counts"], np.uint32) for r in asks]).astype(np.int64)
    begins = np.searchsorted(which[order], np.arange(len(keys)))
    total = np.add.reduceat(counts[order], begins)
    owner = np.minimum.reduceat(np.where(counts[order] > 0, order, len(order)), begins)
    answers = (total[which] * 2 + (owner[which] == np.arange(len(which)))).astype(np.uint64)
    trained = total > 0
    few = total[trained & (total <= SPECTRUM)]
    out = [{"bucket": asks[0]["bucket"], "block": r["block"], "answer": pack(answers[a:b])} for r, a, b in zip(asks, edges, edges[1:])]
    out.append({
        "bucket": asks[0]["bucket"], "keys": pack_sorted(keys[trained]), "counts": pack(total[trained].astype(np.uint64)),
        "spectrum": np.bincount(few, minlength=SPECTRUM + 1)[1:].tolist(), "types": int(trained.sum()), "total": int(total.sum()),
    })
    return _table(out, COUNTED)


def discounts(spectrum: list[int]) -> tuple[np.ndarray, float]:
    """Discounts of counts 0 (unused) to RELIABLE, and the power of the line for larger ones; n[r] is spectrum[r - 1]."""
    n = np.array(spectrum, float)
    r = np.flatnonzero(n) + 1.0
    slope = -2.0
    if len(r) > 1:
        x, y, w = np.log(r), np.log(n[n > 0]), n[n > 0]
        x, y = x - np.average(x, weights=w), y - np.average(y, weights=w)
        slope = min(float((w * x * y).sum() / (w * x * x).sum()), -1.25)
    small = np.ones(RELIABLE + 1)
    for k in range(1, RELIABLE + 1):
        small[k] = (1 + 1 / k) ** (slope + 1)
    if (n[: RELIABLE + 1] > 0).all():
        m = (RELIABLE + 1) * n[RELIABLE] / n[0]
        turing = np.array([((k + 1) * n[k] / (k * n[k - 1]) - m) / (1 - m) for k in range(1, RELIABLE + 1)]) if m < 1 else np.zeros(RELIABLE)
        if (turing > 0).all() and (turing < 1).all():
            small[1:] = turing
    return small, slope + 1


def discounted(counts: np.ndarray, rule: tuple[np.ndarray, float]) -> np.ndarray:
    """Discounts of counts above 0."""
    small, power = rule
    return np.where(counts <= RELIABLE, small[np.minimum(counts, RELIABLE)], (1 + 1 / np.maximum(counts, 1)) ** power)


def _partial(order: int, buckets: int, rules: list, tokens: int, types: int):
    """Scores of a block's documents but for weights, and what its own n-grams add to their contexts."""

    def work(coded: pa.Table, answers: pa.Table) -> pa.Table:
        one = coded.to_pylist()[0]
        b, size = _Block(one, order), 0
        given = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        counts, wholes, freqs, sums = [], [], [], []
        for level in range(order):
            answer = np.concatenate([unpack(r["answer"], np.uint64) for r in given if r["bucket"] // buckets == level]).astype(np.int64)
            _, first, which = np.unique(b.grams[level], return_index=True, return_inverse=True)
            counts.append((answer >> 1)[which])
            if level:
                whole = np.roll(counts[level - 1], 1)
                whole[b.starts] = counts[0][b.starts + b.lengths - 1][0]  # as many texts as end tokens
            else:
                whole = np.full(len(which), tokens)
            wholes.append(whole)
            taken = discounted(counts[level], rules[level])
            freqs.append(np.where(counts[level] > 0, taken * counts[level] / np.maximum(whole, 1), 0.0))
            at = first[(answer & 1).astype(bool)]
            sums.append((b.contexts[level][at], ((1 - taken) * counts[level] / np.maximum(whole, 1))[at], freqs[level - 1][at] if level else np.zeros(len(at))))
        # from the longest n-gram down
        logs, open_, pending, wanted = np.zeros(len(b.tokens)), np.ones(len(b.tokens), bool), [], {}
        for level in reversed(range(order)):
            hit = open_ & (counts[level] > 0)
            logs[hit] = np.log10(freqs[level][hit])
            open_ &= ~hit
            passed = np.flatnonzero(open_ & (wholes[level] > 0))
            wanted[level] = (passed, *np.unique(b.contexts[level][passed], return_inverse=True))
        out, doc_of = [], np.repeat(np.arange(len(b.lengths)), b.lengths)
        for level in range(order):
            contexts, left, lower = sums[level]
            passed, asked, which = wanted[level]
            pending.append((doc_of[passed], which + size))
            size += len(asked)
            keys, place = np.unique(np.concatenate([contexts, asked]), return_inverse=True)
            own = place[: len(contexts)]
            flags = np.zeros(len(keys), np.uint8)
            flags[place[len(contexts) :]] = 1
            lefts, lowers = np.bincount(own, left, len(keys)), np.bincount(own, lower, len(keys))
            for k, x, y in _spans(keys, buckets):
                out.append({"block": one["block"], "bucket": level * buckets + k, "keys": pack_sorted(keys[x:y]), "left": pack(lefts[x:y]), "lower": pack(lowers[x:y]), "wanted": pack(flags[x:y])})
        base = np.log10((counts[0] + 0.5) / (tokens + 0.5 * (types + 1)))
        add = lambda x: np.add.reduceat(x, b.starts)
        docs = zip(one["doc_ids"], b.held.tolist(), b.lengths.tolist(), add((counts[0] > 0).astype(np.int64)).tolist(), add(base).tolist(), add(logs).tolist())
        names = [f.name for f in _DOCS.value_type]
        out.append({
            "block": one["block"], "docs": [dict(zip(names, d)) for d in docs],
            "pending_doc": pack(np.concatenate([p[0] for p in pending]).astype(np.uint32)), "pending_at": pack(np.concatenate([p[1] for p in pending]).astype(np.uint32)),
        })
        return _table(out, PARTIAL)

    return work


def _weigh(rows: pa.Table) -> pa.Table:
    """Weights of one bucket's contexts: a part of the table, and answers to the blocks that asked."""
    asks = sorted(rows.to_pylist(), key=lambda r: r["block"])
    keys, which, _, edges = _merged(asks)
    left, lower = (np.bincount(which, np.concatenate([unpack(r[c], np.float64) for r in asks]), len(keys)) for c in ("left", "lower"))
    weights = np.log10(left / (1 - lower))
    out = [{"bucket": asks[0]["bucket"], "keys": pack_sorted(keys), "weights": pack(weights)}]
    for r, a, b in zip(asks, edges, edges[1:]):
        flags = unpack(r["wanted"], np.uint8).astype(bool)
        if flags.any():
            out.append({"bucket": asks[0]["bucket"], "block": r["block"], "answer": pack(weights[which[a:b][flags]])})
    return _table(out, WEIGHED)


def _finished(tokens: int):
    def work(partial: pa.Table, answers: pa.Table) -> pa.Table:
        one = partial.to_pylist()[0]
        given = [unpack(r["answer"], np.float64) for r in sorted(answers.to_pylist(), key=lambda r: r["bucket"])]
        weights = np.concatenate([np.zeros(0), *given])
        more = np.bincount(unpack(one["pending_doc"], np.uint32), weights[unpack(one["pending_at"], np.uint32)], len(one["docs"]))
        flat = pa.array(one["docs"], _DOCS.value_type)
        columns = {n: flat.field(n) for n in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")}
        columns |= {"train_tokens": pa.array([tokens] * len(flat), pa.int64()), "score": pa.array(flat.field("score").to_numpy(zero_copy_only=False) + more)}
        return pa.table({f.split()[0]: columns[f.split()[0]] for f in SCORES.split(", ")})

    return work


def _rows(table: DataFrame, buckets: int, column: str, kind: type, sql: str) -> DataFrame:
    """A stored table as rows (level, key, value)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = unpack_sorted(r["keys"])
                yield pa.record_batch({"level": np.full(len(keys), r["bucket"] // buckets + 1, np.int32), "key": keys.view(np.int64), column: unpack(r[column + "s"], kind).astype(np.int64 if kind is np.uint64 else kind)})

    return table.where("block IS NULL").select("bucket", "keys", column + "s").mapInArrow(explode, f"level int, key long, {column} {sql}")


def held_out(doc_id: Column, parts: int = 5, part: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the remainder part."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def score(docs: DataFrame, order: int = 2, held: Column | None = None, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK, bucket_entries: int = BUCKET) -> Scored:
    """Train on the documents that are not held out and score all."""
    held = held_out(F.col(doc_id)) if held is None else held
    coded = materialize(_code(docs.select(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")), F.coalesce(held, F.lit(False))), block_tokens), "coded")
    buckets = max(1, math.ceil((coded.agg(F.sum("n_tokens")).first()[0] or 0) / bucket_entries))
    level = F.floor(F.col("bucket") / buckets).cast("int").alias("level")
    counted = materialize(_ask(coded, order, buckets).groupBy("bucket").applyInArrow(_count, COUNTED), "counted")
    parts = counted.where("block IS NULL").select(level, "types", "total", "spectrum")
    sizes = {r.level: r for r in parts.groupBy("level").agg(F.sum("types").alias("types"), F.sum("total").alias("total")).collect()}
    found = parts.select("level", F.posexplode("spectrum").alias("r", "n")).groupBy("level", "r").agg(F.sum("n").alias("n")).collect()
    spectra = [[0] * SPECTRUM for _ in range(order)]
    for r in found:  # SPECTRUM rows a level
        spectra[r.level][r.r] = r.n
    tokens, types = (sizes[0].total, sizes[0].types) if sizes else (0, 0)
    answers = counted.where("block IS NOT NULL").select("block", "bucket", "answer")
    partial = coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_partial(order, buckets, [discounts(s) for s in spectra], tokens, types), PARTIAL)
    partial = materialize(partial, "partial")
    discard(coded)
    asked = partial.where("bucket IS NOT NULL").select("bucket", "block", "keys", "left", "lower", "wanted")
    weighed = materialize(asked.groupBy("bucket").applyInArrow(_weigh, WEIGHED), "weights")
    docs_of = partial.where("bucket IS NULL").select("block", "docs", "pending_doc", "pending_at")
    given = weighed.where("block IS NOT NULL").select("block", "bucket", "answer")
    scores = docs_of.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_finished(tokens), SCORES)
    return Scored(scores, _rows(counted, buckets, "count", np.uint64, "long"), _rows(weighed, buckets, "weight", np.float64, "double"))
