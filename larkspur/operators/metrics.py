"""Closing-line value, returns, selection of signals, reliability and collapse gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.prob import valid_odd, wilson

ROI_LEAST = 50


def _rounded(c: Column, places: int) -> Column:
    return F.round(c, places)


def clv_columns(places: int = 6) -> list[Column]:
    """Aggregates over clv and won (null: push): counts, shares with Wilson bounds, mean and median."""
    n, dec = F.count("clv"), F.count("won")
    beat, green = F.count_if(F.col("clv") > 0), F.count_if(F.col("won"))
    error = F.stddev_samp("clv") / F.sqrt(n)
    return [
        F.count("*").alias("n"), dec.alias("n_dec"),
        _rounded(100 * beat / F.when(n > 0, n), places).alias("beat"),
        _rounded(wilson(beat, F.when(n > 0, n))["lo"], places).alias("beat_lo"), _rounded(wilson(beat, F.when(n > 0, n))["hi"], places).alias("beat_hi"),
        _rounded(F.avg("clv"), places).alias("clv_mean"), _rounded(F.median("clv"), places).alias("clv_median"),
        _rounded(F.when(n > 1, F.avg("clv") - 1.96 * error), places).alias("clv_lo"), _rounded(F.when(n > 1, F.avg("clv") + 1.96 * error), places).alias("clv_hi"),
        _rounded(100 * green / F.when(dec > 0, dec), places).alias("green"),
    ]


def roi(rows: DataFrame, by: list[str], odd: str, places: int = 6) -> DataFrame:
    """Flat returns of rows(odd, won, push) in percent; pushes stay in the stakes; null below ROI_LEAST rows."""
    usable = rows.where(valid_odd(F.col(odd)) & (F.col("won").isNotNull() | F.col("push")))
    profit = F.when(F.col("push"), 0.0).when(F.col("won"), F.col(odd) - 1).otherwise(-1.0)
    return usable.groupBy(*by).agg(
        F.round(F.when(F.count("*") >= ROI_LEAST, 100 * F.avg(profit)), places).alias("roi"), F.count("*").alias("n"), F.count_if("push").alias("n_push")
    )


def main_signals(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(by, line, house, side, odd): the side nearest 2.00 at its best price on the most balanced line.

    Lines with both sides at one house come first, by mean gap, then by line; over wins ties of sides.
    """
    sides = rows.groupBy(*by, "line", "house").agg(F.max(F.when(F.col("side") == "over", F.col("odd"))).alias("o"), F.max(F.when(F.col("side") == "under", F.col("odd"))).alias("u"))
    lines = sides.groupBy(*by, "line").agg(F.avg(F.abs(F.col("o") - F.col("u"))).alias("gap"))
    main = lines.groupBy(*by).agg(F.min_by("line", F.struct(F.col("gap").isNull(), F.round("gap", 9), "line")).alias("line"))
    prices = rows.join(main, [*by, "line"])
    best = prices.groupBy(*by, "line", "side").agg(F.min_by(F.struct("house", "odd"), F.struct(-F.col("odd"), F.col("house"))).alias("b"))
    chosen = best.groupBy(*by, "line").agg(F.min_by(F.struct("side", "b"), F.struct(F.round(F.abs(F.col("b.odd") - 2), 9), F.col("side") != "over")).alias("c"))
    return chosen.select(*by, "line", "c.side", "c.b.house", "c.b.odd")


def collapsed(now: DataFrame, baseline: DataFrame, by: list[str], least: int, share: float) -> DataFrame:
    """Baseline keys of least or more whose count fell below share of it; a missing key counts as 0."""
    both = baseline.join(now.withColumnRenamed("n", "now"), by, "left").withColumn("now", F.coalesce("now", F.lit(0)))
    return both.where((F.col("n") >= least) & (F.col("now") < F.col("n") * share)).select(*by, F.col("n").alias("before"), "now")


def runner_up(rows: DataFrame, by: list[str], score: str, order: list) -> DataFrame:
    """The best row of a key with its margin over the second best, null if there is none."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *order)
    ranked = rows.withColumns({"_rank": F.row_number().over(w), "margin": F.col(score) - F.lead(score).over(w)})
    return ranked.where("_rank = 1").drop("_rank")


def beat_split(rows: DataFrame, places: int = 6) -> DataFrame:
    """rows(clv, won) to one row: how often won of those that beat the close and of the others, and whether the intervals lie apart."""
    decided = rows.where("won IS NOT NULL")
    side = lambda beat: (F.count_if(F.col("won") & beat), F.count_if(beat))
    (k, n), (j, m) = side(F.col("clv") > 0), side(~(F.coalesce(F.col("clv"), F.lit(0.0)) > 0))
    sums = decided.agg(k.alias("k"), n.alias("n_beat"), j.alias("j"), m.alias("n_not"))
    some = lambda c: F.when(c > 0, c)
    a, b = wilson(F.col("k"), some(F.col("n_beat"))), wilson(F.col("j"), some(F.col("n_not")))
    return sums.select(
        "n_beat", F.round(100 * F.col("k") / some(F.col("n_beat")), places).alias("green_beat"), "n_not", F.round(100 * F.col("j") / some(F.col("n_not")), places).alias("green_not"),
        F.coalesce(a["lo"] > b["hi"], F.lit(False)).alias("apart"),
    )


def owners(rows: DataFrame, by: list[str], pair: list[str]) -> DataFrame:
    """The most common pair of each key, the least one at ties, with its count."""
    counts = rows.groupBy(*by, *pair).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.min_by(F.struct(*pair, "n"), F.struct(-F.col("n"), *pair)).alias("o"))
    return best.select(*by, *[f"o.{c}" for c in (*pair, "n")])


def consolidated(rows: DataFrame, key: list[str], month: str) -> DataFrame:
    """One row a key, that of the newest month."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), month).alias("r")).select(*key, "r.*")


def last_runs(rows: DataFrame, by: list[str], order: list, value: str, n: int) -> DataFrame:
    """Each key's last n values as columns run_1 (the latest) to run_n."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("_k") == k, F.col(value))).alias(f"run_{k}") for k in range(1, n + 1)])
