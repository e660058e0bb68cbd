"""Price ladders: sanitation, main line, team-line exclusion, pairing of sides, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import prob
from larkspur.functions.keys import three_way
from larkspur.functions.prob import bind

MARGIN_LEAST, MARGIN_MOST = 0.0, 0.12
TOLERANCE = 0.01


def sanitize(rows: DataFrame, by: list[str], arrival: list[str]) -> DataFrame:
    """rows(by, arrival, line, over, under) with reason, null for clean rows.

    In order: odds_range, duplicate_line (a later arrival of a line that was taken), margin_low, then along the
    lines mono_over and mono_under against the last row kept; margin_high_kept marks dear rows that stay. A
    ladder is one group, of as many rows as a market has lines.
    """
    margin = 1 / F.col("over") + 1 / F.col("under") - 1
    ranged = F.coalesce((F.col("over") > 1.01) & (F.col("over") <= 50) & (F.col("under") > 1.01) & (F.col("under") <= 50), F.lit(False))
    first = rows.withColumns({"margin": margin, "_reason": F.when(F.col("line").isNull() | F.col("over").isNull() | F.col("under").isNull(), "parse").when(~ranged, "odds_range").when(margin < MARGIN_LEAST - 1e-9, "margin_low")})
    # a line is taken by the first arrival that passes; a row before it that fails leaves the line free
    taken = Window.partitionBy(*by, "line").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.col("_reason").isNull().cast("int")).over(taken), F.lit(0)) == 1
    marked = first.withColumn("_reason", F.when(F.coalesce(F.col("_reason"), F.lit("")).isin("parse", "odds_range"), F.col("_reason")).when(before, "duplicate_line").otherwise(F.col("_reason")))
    item = F.struct("line", *arrival, "over", "under", "margin", F.col("_reason").alias("reason"))
    ladders = marked.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("items"))
    state = "struct<o:double,u:double,out:array<string>>"
    start = F.struct(F.lit(None).cast("double").alias("o"), F.lit(None).cast("double").alias("u"), F.array().cast("array<string>").alias("out")).cast(state)

    def step(a, r):
        bad = F.when(r["reason"].isNotNull(), r["reason"]).when(a["o"].isNotNull() & (r["over"] + 1e-9 < a["o"] * (1 - TOLERANCE)), "mono_over").when(a["u"].isNotNull() & (r["under"] > a["u"] * (1 + TOLERANCE) + 1e-9), "mono_under")
        return bind(bad, lambda b: F.struct(
            F.when(b.isNull(), r["over"]).otherwise(a["o"]).alias("o"), F.when(b.isNull(), r["under"]).otherwise(a["u"]).alias("u"),
            F.concat(a["out"], F.array(F.coalesce(b, F.when(r["margin"] > MARGIN_MOST + 1e-9, "margin_high_kept").otherwise("")))).alias("out"),
        ).cast(state))

    folded = ladders.withColumn("out", F.aggregate("items", start, step, lambda a: a["out"]))
    flat = folded.select(*by, F.explode(F.arrays_zip("items", "out")).alias("z"))
    return flat.select(*by, "z.items.line", *[F.col(f"z.items.{c}").alias(c) for c in arrival], "z.items.over", "z.items.under", "z.items.margin", F.when(F.col("z.out") != "", F.col("z.out")).alias("reason"))


def kept(sanitized: DataFrame) -> DataFrame:
    return sanitized.where("reason IS NULL OR reason = 'margin_high_kept'")


def main_line(rows: DataFrame, by: list[str], arrival: list[str]) -> DataFrame:
    """The most balanced line: least 10 |over - under| + |mean - 1.9|, the first arrival at ties."""
    score = F.abs(F.col("over") - F.col("under")) * 10 + F.abs((F.col("over") + F.col("under")) / 2 - 1.9)
    return rows.where("over IS NOT NULL AND under IS NOT NULL AND line IS NOT NULL").groupBy(*by).agg(F.min_by("line", F.struct(F.round(score, 9), *arrival)).alias("main_line"))


def match_lines(rows: DataFrame, by: list[str]) -> DataFrame:
    """Lines without the team totals among them: above the widest gap of 4 or more, if the range is 8 and the top 12."""
    arr = F.col("lines")
    gaps = F.zip_with(F.slice(arr, 2, F.size(arr)), F.slice(arr, 1, F.size(arr) - 1), lambda b, a: b - a)
    cut = F.when((F.size(arr) >= 2) & (F.element_at(arr, -1) - F.element_at(arr, 1) >= 8) & (F.element_at(arr, -1) >= 12), bind(gaps, lambda g: F.when(F.array_max(g) >= 4, F.array_position(g, F.array_max(g)).cast("int"))))
    sets = rows.groupBy(*by).agg(F.sort_array(F.collect_set("line")).alias("lines")).withColumn("cut", F.when(F.size("lines") >= 2, cut))
    return sets.select(*by, F.expr("CASE WHEN cut IS NULL THEN lines ELSE slice(lines, cut + 1, size(lines)) END").alias("lines"))


def pair_sides(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(by, side, odd) to one row a key with both sides: the best odd of each."""
    best = lambda side: F.max(F.when(F.col("side") == side, F.col("odd")))
    return rows.groupBy(*by).agg(best("over").alias("over"), best("under").alias("under")).where("over IS NOT NULL AND under IS NOT NULL")


def pick_family(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(by, family, name, lines): two-way before three-way, then most lines, preferred name, least id."""
    flat = F.regexp_replace(F.lower("name"), "[ -]", "")
    three = flat.rlike("3vias|3way|tresvias|trêsvias").cast("int")
    prefer = F.lower("name").rlike("total|mais/menos|mais menos").cast("int") - 5 * F.lower("name").rlike("1º|2º|primeiro|segundo|tempo|ht").cast("int")
    order = Window.partitionBy(*by).orderBy(three, F.desc("lines"), prefer.desc(), F.col("family").cast("string"))
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def balanced_at_edge(rows: DataFrame, by: list[str], edge: str, minutes: int = 5) -> DataFrame:
    """rows(by, line, over, under, minute, ref): the most balanced pair among those within minutes of the edge.

    edge is ``open`` or ``close``; ties go to the line nearest ref, then the lower one.
    """
    w = Window.partitionBy(*by)
    near = F.col("minute") <= F.min("minute").over(w) + minutes if edge == "open" else F.col("minute") >= F.max("minute").over(w) - minutes
    close = rows.withColumn("_near", F.coalesce(near, F.lit(False))).withColumn("_any", F.max("_near").over(w)).where("_near OR NOT _any")
    score = F.struct(F.round(F.abs(F.col("over") - F.col("under")), 9), F.coalesce(F.abs(F.col("line") - F.col("ref")), F.lit(0.0)), F.col("line"))
    best = close.groupBy(*by).agg(F.min_by(F.struct("line", "over", "under"), score).alias("b"))
    return best.select(*by, "b.line", "b.over", "b.under")


#: The margin, chance, expected value and edge of a line that a board flags.
MARGIN_TOP, CHANCE, EV_LEAST, EDGE_LEAST = 0.12, (0.15, 0.85), 0.05, 0.04


def value_flags(lines: DataFrame, now: Column) -> DataFrame:
    """lines(kickoff, stale, type_name, over, under, p struct(over, under, push), ...) to one row for each side of value.

    Games that have begun, stale houses and three-way markets are left out, and so are lines whose margin is negative or too wide; a
    kickoff that is not known counts as still to come.
    """
    open_ = lines.where(F.coalesce(F.col("kickoff") > now, F.lit(True)) & ~F.coalesce("stale", F.lit(False)) & ~three_way(F.col("type_name")))
    fair = open_.withColumn("d", prob.devig(F.col("over"), F.col("under"))).where(F.col("d.margin").between(-1e-9, MARGIN_TOP + 1e-9))
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(s).alias("odd"), F.col(f"p.{s}").alias("chance"), F.col(f"d.p_{s}").alias("market_chance"))
    sides = fair.select(*[c for c in lines.columns if c != "p"], F.col("p.push").alias("push"), F.explode(F.array(side("over"), side("under"))).alias("s")).select("*", "s.*").drop("s")
    ev, edge = F.round(prob.expected_value(F.col("chance"), F.col("odd"), F.col("push")), 6), F.round(prob.conditional_win(F.col("chance"), F.col("push")) - F.col("market_chance"), 6)
    return sides.withColumns({"ev": ev, "edge": edge}).where(F.col("chance").between(*CHANCE) & (F.col("ev") >= EV_LEAST) & (F.col("edge") >= EDGE_LEAST))
