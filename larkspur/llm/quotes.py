"""Chat formatting by quotation linking.

Lines that begin with ``>`` are quotes, as many levels deep as there are marks. Runs of lines of one level are
passages; a passage, lower-cased and with single spaces, is looked up by hash among the lines, paragraphs and
whole texts that earlier messages of the conversation wrote themselves, and linked to the first of them. A
passage that is none of these is linked to the first message that wrote its lines one after the other, blank lines
left out; failing that, what its empty quoted lines separate is linked piece by piece, in both ways. A
message answers the latest message that its shallowest linked quotes come from. Chains of answers lead to
the message that began the thread; threads in order of their first turn, each in order of turns, give the
conversation, from which quotes and the lines that introduce them are dropped.

A null text is empty, a null role ``unknown``. Rows without conv_id or turn are left out. Rows that share
both are messages of their own with one place. Extra columns are ignored. An empty table gives an empty result. A conversation comes in
chunks of CHUNK messages, counted in its order whatever its turns are, so that one of any length needs no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import let, materialize

#: Messages of a row of conversations().
CHUNK = 1_000
_QUOTE = r"^((?:[ \t]*>)+)[ \t]?"
#: Ends of lines that introduce a quote.
_INTRO = r"(?i)\b(wrote|writes|schrieb|escribió|a écrit)\s*:\s*$"


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _tidy(body: Column) -> Column:
    """The lines of body, each as _norm() has it, without blank ones at the ends."""
    return F.regexp_replace(F.array_join(F.transform(F.split(body, "\n"), _norm), "\n"), r"^\n+|\n+$", "")


def _pairs(lines: Column) -> Column:
    """array<struct<at, pair>>: a hash for each two neighbouring lines."""
    pair = lambda i: F.struct(i.alias("at"), F.md5(F.concat_ws("\n", F.get(lines, i), F.get(lines, i + 1))).alias("pair"))
    return F.when(F.size(lines) > 1, F.transform(F.sequence(F.lit(0), F.size(lines) - 2), pair)).otherwise(F.array().cast("array<struct<at:int,pair:string>>"))


def _lines(text: Column) -> Column:
    """array<struct<depth, body>> of a text's lines."""
    def one(line: Column) -> Column:
        mark = F.regexp_extract(line, _QUOTE, 1)
        return F.struct(F.length(F.regexp_replace(mark, "[^>]", "")).alias("depth"), F.regexp_replace(line, _QUOTE, "").alias("body"))

    return F.transform(F.split(text, "\n"), one)


def _runs(lines: Column) -> Column:
    """Maximal runs of lines of one depth, joined by line feeds; blank lines of depth 0 end a run."""

    def of(kinds: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(kinds) - 1)
        starts = F.filter(at, lambda i: (i == 0) | (F.get(kinds, i) != F.get(kinds, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda i, k: run(i, F.coalesce(F.get(s, k + 1), F.size(kinds)), kinds)))

    def run(start: Column, stop: Column, kinds: Column) -> Column:
        body = F.array_join(F.transform(F.slice(lines, start + 1, stop - start), lambda x: x["body"]), "\n")
        return F.struct(F.greatest(F.get(kinds, start), F.lit(-1)).alias("depth"), body.alias("body"))

    # a blank line of depth 0 has a kind of its own
    kinds = F.transform(lines, lambda x, i: F.when((x["depth"] == 0) & (F.trim(x["body"]) == ""), -1 - i).otherwise(x["depth"]))
    none = F.array().cast("array<struct<depth:int,body:string>>")
    return F.when(F.size(lines) == 0, none).otherwise(let(kinds, of))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own, without quotes), quotes (depth, mark, body), marks of what the message wrote."""
    rows = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    has = F.col("text").rlike(r"(?m)^[ \t]*>")
    empty = F.array().cast("array<struct<depth:int,mark:string,body:string>>")

    def cut(lines: Column) -> Column:
        introduces = lambda x, i: x["body"].rlike(_INTRO) & F.coalesce(F.get(lines, i + 1)["depth"] > 0, F.lit(False))
        own = F.filter(lines, lambda x, i: (x["depth"] == 0) & ~introduces(x, i))
        return let(own, lambda o: F.struct(
            F.trim(F.array_join(F.transform(o, lambda x: x["body"]), "\n")).alias("text"),
            F.transform(F.filter(_runs(lines), lambda r: (r["depth"] > 0) & (_norm(r["body"]) != "")), lambda r: F.struct(r["depth"].alias("depth"), F.md5(_norm(r["body"])).alias("mark"), _tidy(r["body"]).alias("body"))).alias("quotes"),
            o.alias("own"),
        ))

    none = F.struct(F.col("text").alias("text"), empty.alias("quotes"), let(_lines(F.col("text")), lambda x: x).alias("own"))
    both = rows.select("conv_id", "turn", "role", F.when(has, let(_lines(F.col("text")), cut)).otherwise(none).alias("p"))
    return both.select("conv_id", "turn", "role", "p.text", "p.quotes", "p.own")


def _originals(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, mark, source): the first message of each conversation with quotes that wrote a passage."""
    talk = messages.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    lines = F.transform(F.col("own"), lambda x: x["body"])
    paragraphs = F.transform(F.filter(_runs(F.col("own")), lambda r: r["depth"] == 0), lambda r: r["body"])
    marks = F.array_distinct(F.transform(F.filter(F.transform(F.concat(lines, paragraphs, F.array("text")), _norm), lambda x: x != ""), lambda x: F.md5(x)))
    return talk.select("conv_id", "turn", F.explode(marks).alias("mark")).groupBy("conv_id", "mark").agg(F.min("turn").alias("source"))


def _written(messages: DataFrame, units: DataFrame) -> DataFrame:
    """units(conv_id, turn, unit) to those of two lines or more with source, the first message that wrote the lines in a row."""
    talk = messages.join(units.select("conv_id").distinct(), "conv_id", "left_semi")
    lines = F.filter(F.transform(F.col("own"), lambda x: _norm(x["body"])), lambda x: x != "")
    wrote = talk.select("conv_id", "turn", lines.alias("lines")).where(F.size("lines") > 1).groupBy("conv_id", "lines").agg(F.min("turn").alias("source"))
    theirs = wrote.select("conv_id", "source", F.xxhash64("lines").alias("text"), F.posexplode(_pairs(F.col("lines"))).alias("i", "p")).select("conv_id", "source", "text", F.col("p.at").alias("there"), "p.pair")
    ours = units.select("conv_id", "turn", "unit", F.split("unit", "\n").alias("lines")).distinct()
    ours = ours.select("conv_id", "turn", "unit", (F.size("lines") - 1).alias("n"), F.explode(_pairs(F.col("lines"))).alias("p")).select("conv_id", "turn", "unit", "n", "p.at", "p.pair")
    met = ours.join(theirs, ["conv_id", "pair"]).where("source < turn").groupBy("conv_id", "turn", "unit", "n", "source", "text", F.expr("there - at").alias("shift")).count()
    return met.where("count = n").groupBy("conv_id", "turn", "unit").agg(F.min("source").alias("source"))


def _parts(messages: DataFrame, originals: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that are no passage, with the source of their lines, or the latest source of their pieces."""
    whole = F.struct(F.lit(True).alias("whole"), F.regexp_replace("body", r"\n{2,}", "\n").alias("unit"))
    pieces = F.transform(F.split("body", r"\n{2,}"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit")))
    units = runs.withColumn("u", F.explode(F.concat(F.array(whole), pieces))).select(*runs.columns, "u.whole", "u.unit")
    units = materialize(units.withColumn("mark", F.md5(F.regexp_replace("unit", "\n", " "))), "units")
    by_mark = units.select("conv_id", "turn", "unit", "mark").join(originals, ["conv_id", "mark"]).where("source < turn").select("conv_id", "turn", "unit", "source")
    found = by_mark.unionByName(_written(messages, units)).groupBy("conv_id", "turn", "unit").agg(F.min("source").alias("source"))
    of_run = units.join(found, ["conv_id", "turn", "unit"]).groupBy("conv_id", "turn", "depth", "body", "times")
    sources = of_run.agg(F.min(F.when(F.col("whole"), F.col("source"))).alias("all"), F.max(F.when(~F.col("whole"), F.col("source"))).alias("some"))
    return sources.select("conv_id", "turn", "depth", "times", F.coalesce("all", "some").alias("source"))


def linked(messages: DataFrame) -> DataFrame:
    """parsed() messages to (conv_id, turn, parent_turn, n_linked) of those with linked quotes."""
    quoted = messages.where(F.size("quotes") > 0)
    quotes = quoted.select("conv_id", "turn", F.explode("quotes").alias("q")).groupBy("conv_id", "turn", "q.depth", "q.mark", "q.body").agg(F.count("*").alias("times"))
    quotes = materialize(quotes, "quotes")
    originals = _originals(messages, quotes)
    sought = materialize(quotes.join(originals, ["conv_id", "mark"], "left").withColumn("source", F.expr("CASE WHEN source < turn THEN source END")), "sought")
    hits = sought.where("source IS NOT NULL").select("conv_id", "turn", "depth", "times", "source")
    rest = sought.where("source IS NULL").select("conv_id", "turn", "depth", "body", "times")
    if not rest.isEmpty():
        hits = hits.unionByName(_parts(messages, originals, rest))
    return hits.groupBy("conv_id", "turn").agg(
        F.max_by("source", F.struct(-F.col("depth"), F.col("source"))).alias("parent_turn"), F.sum("times").alias("n_linked")
    )


def threads(links: DataFrame) -> DataFrame:
    """links with thread_turn, the turn at the head of the chain of answers, by pointer doubling."""
    now = links.withColumn("thread_turn", F.col("parent_turn"))
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("higher")).distinct()
        step = materialize(now.join(up, ["conv_id", "thread_turn"], "left"), "threads")
        if step.where("higher IS NOT NULL").isEmpty():
            return step.drop("higher")
        now = step.select("conv_id", "turn", "parent_turn", "n_linked", F.coalesce("higher", "thread_turn").alias("thread_turn"))


def linked_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, n_quotes, n_linked, parent_turn, thread_turn of each message."""
    clean = parsed(messages)
    links = materialize(linked(clean), "links")
    chains = threads(links)
    return clean.join(chains, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"),
    )


def placed(said: DataFrame) -> DataFrame:
    """said with place, the row's number from 0 in its conversation, in order of thread, turn, role and text.

    Rows are dealt by ranges of the whole order, so that a long conversation is spread over tasks; a range counts its own rows
    and starts after those of the ranges before it.
    """
    order = ["conv_id", "thread_turn", "turn", "role", "text"]
    written = materialize(said.withColumn("_at", F.monotonically_increasing_id()), "said")
    dealt = materialize(written.repartitionByRange(*order, "_at").withColumn("_range", F.spark_partition_id()), "dealt")
    # a row for each conversation of a range: two or more only for conversations that a range ends in
    counts = dealt.groupBy("conv_id", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy("conv_id", "_range").orderBy(*order[1:], "_at"))
    return dealt.withColumn("_number", number).join(offsets, ["conv_id", "_range"]).withColumn("place", F.col("_before") + F.col("_number") - 1).drop("_at", "_range", "_number", "_before")


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, chunk, n_messages, n_quotes, n_linked, turns, chat): reply-ordered text without quotes."""
    item = F.struct("place", "turn", "role", "text")
    parts = placed(linked_messages(messages)).groupBy("conv_id", F.expr(f"place DIV {CHUNK}").alias("chunk")).agg(
        F.count("*").alias("n_messages"), F.sum("n_quotes").alias("n_quotes"), F.sum("n_linked").alias("n_linked"), F.sort_array(F.collect_list(item)).alias("m")
    )
    return parts.select(
        "conv_id", "chunk", "n_messages", "n_quotes", "n_linked",
        F.array_join(F.transform("m", lambda x: x["turn"].cast("string")), ",").alias("turns"),
        F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"])), "\n").alias("chat"),
    )
