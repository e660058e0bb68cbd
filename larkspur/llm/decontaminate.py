"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders; windows of canonical words are hashed and joined with the
benchmark's; the windows that match at one alignment count if their slots are consistent, that is if equal slot
values of the item stand for equal values in the document and different for different. So a question with other numbers or names in it is
found, and a text that only has placeholders in the same places is not. DataFrame functions only.

An item of which no window counts, being shorter than WINDOW words or having fewer than MIN_LITERAL plain words
in each, is looked for as a whole: all its canonical words in a row. If it has fewer than MIN_LITERAL plain words,
its slots must have equal values. A name mark on the first word is left out of account, as it comes from what stands before.

A null text is empty and leaks nothing. An item without words never matches. Windows with fewer than MIN_LITERAL
plain words do not count. Rows that share a doc_id, null included, are judged together. Repeated
benchmark rows count once for each item_id. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import let, materialize

WINDOW = 8
MIN_LITERAL = 5
#: Part of an item's windows that a document must hold.
COVERAGE = 0.25
#: Benchmarks up to this many windows are broadcast (some 20 MB), larger ones are joined by shuffle.
BROADCAST_WINDOWS = 200_000

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: Units that follow a number.
UNITS = "kg|mg|g|km|cm|mm|m|l|ml|mph|kmh|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|years?|dollars?|euros?|cents?|percent|miles?|meters?|metres?|feet|inches"

#: Words are what white space and ASCII punctuation separate.
SEPARATOR = "[\\x09-\\x0D\\x20-/:-@\\[-`{-~]+"
MARK = "[\ue000-\ue002]"
#: Steps as (condition, [(pattern, replacement)]), in syntax that Java and RE2 share; group references are written
#: for Java. A text that does not meet a condition is left as it is.
STEPS = [
    (MARK, [(MARK, "")]),
    # a capital letter that does not begin a sentence; twice, as neighbours share a letter
    ("[^.!?:\\x20\\x09-\\x0D]\\x20[A-Z][a-z]", [("([^.!?:\\x20\\x09-\\x0D]\\x20)([A-Z][a-z])", f"$1{NAME}$2")] * 2),
    # 1,000.5 is one number; twice, as neighbours share a digit
    ("[0-9]", [("([0-9])[.,]([0-9])", "$1$2")] * 2 + [("[0-9]+", f"{NUMBER}$0"), (f"({NUMBER}[0-9]+\\x20?)({UNITS})\\b", f"$1{UNIT}$2")]),
]
#: A word with a mark keeps what stands up to the mark.
BLANK = (f"({MARK})[^\\x09-\\x0D\\x20-/:-@\\[-`{{-~]*", "$1")


def marked(text: Column) -> Column:
    """Lower-cased text in which a placeholder mark stands before each slot's value."""

    def steps(t: Column, rest: list) -> Column:
        if not rest:
            return F.lower(t)
        (condition, replaces), rest = rest[0], rest[1:]
        out = t
        for pattern, replacement in replaces:
            out = F.regexp_replace(out, pattern, replacement)
        return let(F.when(t.rlike(condition), out).otherwise(t), lambda v: steps(v, rest))

    return let(F.coalesce(text, F.lit("")), lambda t: steps(t, STEPS))


def words_of(t: Column) -> Column:
    return F.array_remove(F.split(t, SEPARATOR), "")


_WINDOWS = "array<struct<h:bigint,slots:array<string>>>"


def windows_in(t: Column) -> Column:
    """array<struct<h, slots>>: each window of a marked text by the hash of its canonical words, with the words that have a mark.

    Words are made once; a window looks at its own words only.
    """

    def of(words: Column, has: Column) -> Column:
        blank = lambda w: F.when(w.rlike(MARK), F.regexp_replace(w, *BLANK)).otherwise(w)
        hashes = F.when(has, F.transform(words, lambda w: F.xxhash64(blank(w)))).otherwise(F.transform(words, lambda w: F.xxhash64(w)))
        slot = F.when(has, F.transform(words, lambda w: F.when(w.rlike(MARK), w)))
        return let(F.struct(hashes.alias("h"), slot.alias("slot")), windows)

    def windows(x: Column) -> Column:
        def one(i: Column) -> Column:
            slots = F.when(x["slot"].isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.slice(x["slot"], i + 1, WINDOW)))
            return F.struct(F.xxhash64(*[F.get(x["h"], i + k) for k in range(WINDOW)]).alias("h"), slots.alias("slots"))

        return F.transform(F.sequence(F.lit(0), F.size(x["h"]) - WINDOW), one)

    return let(words_of(t), lambda w: F.when(F.size(w) < WINDOW, F.array().cast(_WINDOWS)).otherwise(of(w, t.rlike(MARK))))


def windows_of(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, text) to (key, pos, h, slots): a row for each window with MIN_LITERAL plain words; nothing of the text but its slots goes along."""
    every = rows.select(key, marked(F.col("text")).alias("t")).select(key, F.posexplode(windows_in(F.col("t"))).alias("pos", "w"))
    return every.select(key, "pos", "w.h", "w.slots").where(F.size("slots") <= WINDOW - MIN_LITERAL)


def one_to_one(pairs: Column) -> Column:
    """Whether pairs(ours, theirs), a set, map one to one."""
    distinct = lambda name: F.size(F.array_distinct(F.transform(pairs, lambda p: p[name])))
    return (distinct("ours") == F.size(pairs)) & (distinct("theirs") == F.size(pairs))


def unnamed(words: Column) -> Column:
    """words with the first one's name mark taken off."""
    return F.transform(words, lambda w, i: F.when((i == 0) & w.startswith(NAME), F.substring(w, F.lit(2), F.length(w))).otherwise(w))


def blanked(word: Column) -> Column:
    return F.when(word.rlike(MARK), F.regexp_replace(word, *BLANK)).otherwise(word)


def anchors(words: Column, sizes: list[int]) -> Column:
    """array<struct<pos, h>>: a hash for each run of so many canonical words, the first word unnamed."""

    def runs(both: Column) -> Column:
        first, rest = both["first"], both["rest"]
        empty = F.array().cast("array<struct<pos:int,h:bigint>>")

        def of(size: int) -> Column:
            one = lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(size), F.get(first, i), *[F.get(rest, i + k) for k in range(1, size)]).alias("h"))
            return F.when(F.size(rest) < size, empty).otherwise(F.transform(F.sequence(F.lit(0), F.size(rest) - size), one))

        return F.concat(*[of(size) for size in sizes])

    hashed = lambda w: F.xxhash64(blanked(w))
    bare = lambda w: F.when(w.startswith(NAME), F.substring(w, F.lit(2), F.length(w))).otherwise(w)
    return let(words, lambda r: let(F.struct(F.transform(r, lambda w: hashed(bare(w))).alias("first"), F.transform(r, hashed).alias("rest")), runs))


def whole_leaks(docs: DataFrame, benchmark: DataFrame, items: DataFrame) -> DataFrame | None:
    """leaks() of the benchmark's items that have no row in items(item_id); None if there are none."""
    rest = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull()).join(items.select("item_id").distinct(), "item_id", "left_anti")
    ours = rest.select("item_id", unnamed(words_of(marked(F.col("text")))).alias("ours")).where(F.size("ours") > 0).distinct()
    ours = materialize(ours.withColumn("size", F.least(F.size("ours"), F.lit(WINDOW))), "whole")
    sizes = sorted(r["size"] for r in ours.select("size").distinct().collect())
    if not sizes:
        return None
    n = ours.count()
    key = F.lit(None).cast("bigint")
    for size in sizes:
        key = F.when(F.col("size") == size, F.get(anchors(F.col("ours"), [size]), F.lit(0))["h"]).otherwise(key)
    ours = ours.select("item_id", "ours", key.alias("h"))
    texts = docs.select("doc_id", marked(F.col("text")).alias("t")).withColumn("_text", F.xxhash64("t"))
    rows = texts.select("doc_id", "_text", F.explode(anchors(words_of(F.col("t")), sizes)).alias("a")).select("doc_id", "_text", "a.pos", "a.h")
    met = rows.join(F.broadcast(ours) if n <= BROADCAST_WINDOWS else ours, "h")
    # the words of a text are made once for all its hits; rows of one doc_id and hash are judged together anyway
    met = met.groupBy("doc_id", "_text").agg(F.collect_set(F.struct("item_id", "pos", "ours")).alias("met"))
    met = met.select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_hash"), "met")
    found = texts.join(met, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_hash")))
    cut = lambda w: F.transform("met", lambda m: F.struct(m["item_id"].alias("item_id"), m["ours"].alias("ours"), F.slice(w, m["pos"] + 1, F.size(m["ours"])).alias("there")))
    hits = found.select("doc_id", F.explode(let(words_of(F.col("t")), cut)).alias("m")).select("doc_id", "m.item_id", "m.ours", unnamed(F.col("m.there")).alias("theirs"))
    same = F.transform("ours", blanked) == F.transform("theirs", blanked)
    plain = F.size(F.filter("ours", lambda w: ~w.rlike(MARK)))
    slots = F.array_distinct(F.filter(F.arrays_zip("ours", "theirs"), lambda p: p["ours"].rlike(MARK)))
    equal = F.when(plain < MIN_LITERAL, F.col("ours") == F.col("theirs")).otherwise(one_to_one(slots))
    one = F.lit(1).cast("long")
    return hits.where(same & equal).select("doc_id", "item_id").distinct().select("doc_id", "item_id", one.alias("n_windows"), one.alias("n_item_windows"))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Pairs (doc_id, item_id, n_windows, n_item_windows) where docs(doc_id, text) holds enough of an item.

    An item looked for as a whole counts as one window."""
    items = windows_of(benchmark.select("item_id", "text").where(F.col("item_id").isNotNull()), "item_id")
    items = materialize(items.select("item_id", F.col("pos").alias("item_pos"), "h", F.col("slots").alias("item_slots")).distinct(), "items")
    sizes = items.groupBy("item_id").agg(F.countDistinct("h").alias("n_item_windows"))
    rows = windows_of(docs.select("doc_id", "text"), "doc_id")
    hits = rows.join(F.broadcast(items) if items.count() <= BROADCAST_WINDOWS else items, "h")
    # a copy of an item with gaps has one alignment a piece; an item has few windows, so the sets are small
    pairs = F.arrays_zip(F.col("item_slots").alias("ours"), F.col("slots").alias("theirs"))
    aligned = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set("h").alias("hs"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    counted = aligned.where(one_to_one(F.col("pairs"))).groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hs")))).cast("long").alias("n_windows")
    )
    found = counted.join(sizes, "item_id").where(F.col("n_windows") >= F.lit(coverage) * F.col("n_item_windows")).select("doc_id", "item_id", "n_windows", "n_item_windows")
    whole = whole_leaks(docs, benchmark, items)
    return found if whole is None else found.unionByName(whole)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, leaked, n_items, items (sorted ids, comma-joined)."""
    found = leaks(docs, benchmark).groupBy(F.col("doc_id").alias("found_id")).agg(
        F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")).cast("array<string>"), ",").alias("items")
    )
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("leaked"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("items")
    )


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak; other columns stay, whatever their names."""
    found = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left_anti")
