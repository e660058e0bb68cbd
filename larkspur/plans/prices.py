"""Queries over price ladders: lineitem rows are over/under pairs of a part, part gives the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import names, prob
from larkspur.operators import history, ladder
from larkspur.operators.matching import by_names
from larkspur.plans import similar
from larkspur.plans.registry import query, table


def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("grp"), F.col("l_orderkey").alias("a1"), F.col("l_linenumber").alias("a2"), F.col("l_suppkey").alias("a3"),
        (F.col("l_quantity") / 2).alias("line"),
        F.round(1.05 + F.col("l_quantity") / 25 + F.col("l_discount"), 2).alias("over"),
        F.round(1.05 + (51 - F.col("l_quantity")) / 25 + F.col("l_tax"), 2).alias("under"),
        (F.col("l_suppkey") % 7).alias("house"),
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("grp"), (F.col("p_size") / 4.0 + 1).alias("mu"), (1 + (F.col("p_partkey") % 20) / 10.0).alias("phi"))


L = """SELECT l_partkey AS grp, l_orderkey AS a1, l_linenumber AS a2, l_suppkey AS a3, l_quantity / 2 AS line,
  round(1.05 + l_quantity / 25 + l_discount, 2) AS "over", round(1.05 + (51 - l_quantity) / 25 + l_tax, 2) AS "under", l_suppkey % 7 AS house FROM lineitem"""
M = "SELECT p_partkey AS grp, p_size / 4.0 + 1 AS mu, 1 + (p_partkey % 20) / 10.0 AS phi FROM part"


def _pois(k: str, mu: str) -> str:
    return f"CASE WHEN {k} < 0 THEN 0.0 ELSE least(1.0, list_sum([exp(-{mu} + i * ln({mu}) - lgamma(i + 1)) FOR i IN range(0, CAST({k} AS BIGINT) + 1)])) END"


def _nb(k: str, r: str, p: str) -> str:
    return f"CASE WHEN {k} < 0 THEN 0.0 ELSE least(1.0, list_sum([exp(lgamma(i + {r}) - lgamma({r}) - lgamma(i + 1) + {r} * ln({p}) + i * ln(1 - {p})) FOR i IN range(0, CAST({k} AS BIGINT) + 1)])) END"


def _ou(rows: str, lower: str, upper: str) -> str:
    """Over, under and push of rows(..., line, k, whole): lower is the CDF at k, upper the one at k - 1."""
    return f"""SELECT *, o / (o + u + p) AS p_over, u / (o + u + p) AS p_under, p / (o + u + p) AS p_push FROM (
      SELECT *, greatest(0.0, 1 - ck) AS o, CASE WHEN whole THEN ck1 ELSE ck END AS u, CASE WHEN whole THEN greatest(0.0, ck - ck1) ELSE 0.0 END AS p
      FROM (SELECT *, {lower} AS ck, {upper} AS ck1 FROM ({rows})))"""


_K = "CASE WHEN abs(line - round(line)) < 1e-9 THEN round(line) ELSE floor(line) END AS k, abs(line - round(line)) < 1e-9 AS whole"
_LINES = f"SELECT grp, mu, phi, line, {_K} FROM ({M}) m, (SELECT unnest(range(1, 30)) * 0.5 AS line)"


def _priced(spark: SparkSession, sf_dir: str, cdf) -> DataFrame:
    rows = models(spark, sf_dir).withColumn("line", F.explode(F.transform(F.sequence(F.lit(1), F.lit(29)), lambda i: i * F.lit(0.5))))
    p = prob.ou_from_sums(lambda k: cdf(k, F.col("mu"), F.col("phi")), F.col("mu"), F.col("line"))
    return by_names(rows, "p", p, ("mu", "phi", "line")).select("grp", "line", *[F.round(F.col(f"p.{x}") + 1e-12, 7).alias(f"p_{x}") for x in ("over", "under", "push")])


#: A trifle is added so that ties of rounding fall alike in every engine.
_OUT = "round(p_over + 1e-12, 7) AS p_over, round(p_under + 1e-12, 7) AS p_under, round(p_push + 1e-12, 7) AS p_push"


@query(f"SELECT grp, line, {_OUT} FROM ({_ou(_LINES, _pois('k', 'mu'), _pois('k - 1', 'mu'))})")
def poisson_ou_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, lambda k, mu, _: prob.poisson_sums(k, mu))


_R = "(mu / (CASE WHEN phi > 1.001 THEN phi - 1 ELSE 1 END))"


def _disp(k: str) -> str:
    return f"CASE WHEN phi <= 1.001 THEN {_pois(k, 'mu')} ELSE {_nb(k, _R, f'({_R} / ({_R} + mu))')} END"


@query(f"SELECT grp, line, {_OUT} FROM ({_ou(_LINES, _disp('k'), _disp('k - 1'))})")
def negbin_dispersion_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, prob.negbin_dispersion_sums)


@query(f"SELECT grp, line, {_OUT} FROM ({_ou(_LINES, _nb('k', 'phi', '(phi / (phi + mu))'), _nb('k - 1', 'phi', '(phi / (phi + mu))'))})")
def negbin_size_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, prob.negbin_size_sums)


@query(f"""SELECT grp, line, round(CASE WHEN p_over > 1e-12 THEN (1 - p_push) / p_over END, 4) AS fair_over,
  round(CASE WHEN p_under > 1e-12 THEN (1 - p_push) / p_under END, 4) AS fair_under
  FROM ({_ou(_LINES, _pois('k', 'mu'), _pois('k - 1', 'mu'))}) WHERE p_over > 0.01 AND p_under > 0.01""")
def fair_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a price is a matter of mean and line: each mean is priced once, whatever parts have it
    groups = models(spark, sf_dir).select("grp", "mu")
    rows = groups.select("mu").distinct().withColumn("line", F.explode(F.transform(F.sequence(F.lit(1), F.lit(29)), lambda i: i * F.lit(0.5))))
    p = prob.ou_from_sums(lambda k: prob.poisson_sums(k, F.col("mu")), F.col("mu"), F.col("line"))
    priced = prob.once(rows, "p", p).where("p.over > 0.01 AND p.under > 0.01").select(
        "mu", "line", F.round(prob.fair_odd(F.col("p.over"), F.col("p.push")), 4).alias("fair_over"), F.round(prob.fair_odd(F.col("p.under"), F.col("p.push")), 4).alias("fair_under"))
    return groups.join(priced, "mu").select("grp", "line", "fair_over", "fair_under")


@query(f"""SELECT house, count(*) AS n, count(*) FILTER (m < 0) AS n_low, count(*) FILTER (m > 0.12) AS n_high, round(avg(m), 6) AS margin
  FROM (SELECT house, 1 / "over" + 1 / "under" - 1 AS m FROM ({L}) WHERE "over" > 1 AND "under" > 1) GROUP BY house""")
def devig_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ladders(spark, sf_dir).withColumn("d", prob.devig(F.col("over"), F.col("under"))).where("d IS NOT NULL")
    m = F.col("d.margin")
    return rows.groupBy("house").agg(F.count("*").alias("n"), F.count_if(m < 0).alias("n_low"), F.count_if(m > 0.12).alias("n_high"), F.round(F.avg(m), 6).alias("margin"))


_FLAGS = f"""SELECT grp, a1, a2, a3, house, line, "over", "under", round(p_over * "over" + p_push - 1, 6) AS ev, round(p_over / (1 - p_push) - fair, 6) AS edge FROM (
  {_ou(f'SELECT l.*, m.mu, (1 / "over") / (1 / "over" + 1 / "under") AS fair, {_K} FROM ({L}) l JOIN ({M}) m USING (grp) WHERE "over" > 1.01 AND "over" <= 50 AND "under" > 1.01 AND "under" <= 50 AND 1 / "over" + 1 / "under" - 1 BETWEEN 0 AND 0.12', _pois('k', 'mu'), _pois('k - 1', 'mu'))})
  WHERE p_over BETWEEN 0.15 AND 0.85 AND round(p_over * "over" + p_push - 1, 6) >= 0.05 AND round(p_over / (1 - p_push) - fair, 6) >= 0.04"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ladders(spark, sf_dir).where((F.col("over") > 1.01) & (F.col("over") <= 50) & (F.col("under") > 1.01) & (F.col("under") <= 50))
    rows = rows.withColumn("d", prob.devig(F.col("over"), F.col("under"))).where(F.col("d.margin").between(0, 0.12))
    # a price is a matter of mean and line, of which there are few
    priced = by_names(rows.join(models(spark, sf_dir), "grp"), "p", prob.ou_from_sums(lambda k: prob.poisson_sums(k, F.col("mu")), F.col("mu"), F.col("line")), ("mu", "line"))
    ev = F.round(prob.expected_value(F.col("p.over"), F.col("over"), F.col("p.push")), 6)
    edge = F.round(prob.conditional_win(F.col("p.over"), F.col("p.push")) - F.col("d.p_over"), 6)
    return priced.withColumns({"ev": ev, "edge": edge}).where(F.col("p.over").between(0.15, 0.85) & (F.col("ev") >= 0.05) & (F.col("edge") >= 0.04)).select("grp", "a1", "a2", "a3", "house", "line", "over", "under", "ev", "edge")


@query(_FLAGS)
def ev_edge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: ladders priced by a Poisson model, flagged by expected value and edge."""
    return _flags(spark, sf_dir)


@query(f"SELECT * FROM ({_FLAGS}) ORDER BY ev DESC, grp, a1, a2, a3 LIMIT 25")
def topk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).orderBy(F.desc("ev"), "grp", "a1", "a2", "a3").limit(25)


@query(f"""WITH RECURSIVE s AS (SELECT grp, line, q, 0.0::DOUBLE AS lo, (line * 4 + 40)::DOUBLE AS hi, 0 AS k
  FROM (SELECT p_partkey AS grp, (p_size % 10) + 0.5 AS line, 0.3 + (p_partkey % 5) / 10.0 AS q FROM part)
  UNION ALL SELECT grp, line, q, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END, k + 1
  FROM (SELECT *, 1 - ({_pois('floor(line)', 'mid')}) < q AS low FROM (SELECT *, (lo + hi) / 2 AS mid FROM s WHERE k < 40)))
  SELECT grp, line, round((lo + hi) / 2, 5) AS mu FROM s WHERE k = 40""")
def implied_mu_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("grp"), ((F.col("p_size") % 10) + 0.5).cast("double").alias("line"), (0.3 + (F.col("p_partkey") % 5) / 10.0).alias("q"))
    return by_names(rows, "mu", F.round(prob.solve_mu(F.col("line"), F.col("q")), 5), ("line", "q")).select("grp", "line", "mu")


_SANE = f"""WITH RECURSIVE l AS ({L}),
  f AS (SELECT *, 1 / "over" + 1 / "under" - 1 AS margin, CASE WHEN NOT ("over" > 1.01 AND "over" <= 50 AND "under" > 1.01 AND "under" <= 50) THEN 'odds_range'
    WHEN 1 / "over" + 1 / "under" - 1 < -1e-9 THEN 'margin_low' END AS r FROM l),
  t AS (SELECT *, coalesce(max(CASE WHEN r IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY grp, line ORDER BY a1, a2, a3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM f),
  d AS (SELECT *, CASE WHEN r = 'odds_range' THEN r WHEN taken = 1 THEN 'duplicate_line' ELSE r END AS reason FROM t),
  n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY line, a1, a2, a3) AS i FROM d),
  w AS (SELECT grp, 0 AS i, NULL::DOUBLE AS po, NULL::DOUBLE AS pu, ''::VARCHAR AS reason, NULL::DOUBLE AS line FROM (SELECT DISTINCT grp FROM n)
    UNION ALL SELECT n.grp, n.i, CASE WHEN x.bad IS NULL THEN n."over" ELSE w.po END, CASE WHEN x.bad IS NULL THEN n."under" ELSE w.pu END,
      coalesce(x.bad, CASE WHEN n.margin > 0.12 + 1e-9 THEN 'margin_high_kept' ELSE 'kept' END), n.line
    FROM w JOIN n ON n.grp = w.grp AND n.i = w.i + 1, LATERAL (SELECT CASE WHEN n.reason IS NOT NULL THEN n.reason
      WHEN w.po IS NOT NULL AND n."over" + 1e-9 < w.po * 0.99 THEN 'mono_over' WHEN w.pu IS NOT NULL AND n."under" > w.pu * 1.01 + 1e-9 THEN 'mono_under' END AS bad) x)
"""


@query(_SANE + "SELECT grp, reason, count(*) AS n, sum(line) AS lines FROM w WHERE i > 0 GROUP BY grp, reason")
def ladder_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ladder.sanitize(ladders(spark, sf_dir), ["grp"], ["a1", "a2", "a3"])
    return rows.groupBy("grp", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


@query(f"""SELECT grp, arg_min(line, (round(abs("over" - "under") * 10 + abs(("over" + "under") / 2 - 1.9), 9), a1, a2, a3)) AS main_line FROM ({L}) GROUP BY grp""")
def ladder_main_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.main_line(ladders(spark, sf_dir), ["grp"], ["a1", "a2", "a3"])


_GAPS = f"""WITH d AS (SELECT DISTINCT grp, line FROM ({L})),
  g AS (SELECT grp, line, line - lag(line) OVER w AS gap, min(line) OVER (PARTITION BY grp) AS lo, max(line) OVER (PARTITION BY grp) AS hi FROM d WINDOW w AS (PARTITION BY grp ORDER BY line)),
  c AS (SELECT grp, arg_max(line, (gap, -line)) AS cut, max(gap) AS widest, any_value(lo) AS lo, any_value(hi) AS hi FROM g WHERE gap IS NOT NULL GROUP BY grp)
  SELECT d.grp, count(*) AS n, min(d.line) AS lowest FROM d LEFT JOIN c USING (grp) WHERE c.grp IS NULL OR hi - lo < 8 OR hi < 12 OR widest < 4 OR d.line >= cut GROUP BY d.grp"""


@query(_GAPS)
def ladder_gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = ladder.match_lines(ladders(spark, sf_dir), ["grp"])
    return sets.select("grp", F.size("lines").cast("long").alias("n"), F.array_min("lines").alias("lowest"))


_SIDED = "SELECT l_partkey AS grp, l_suppkey % 7 AS house, l_quantity / 2 AS line, CASE WHEN l_linenumber % 2 = 0 THEN 'over' ELSE 'under' END AS side, round(1.05 + l_quantity / 25 + l_discount, 2) AS odd FROM lineitem"


def _sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("grp"), (F.col("l_suppkey") % 7).alias("house"), (F.col("l_quantity") / 2).alias("line"),
        F.when(F.col("l_linenumber") % 2 == 0, "over").otherwise("under").alias("side"), F.round(1.05 + F.col("l_quantity") / 25 + F.col("l_discount"), 2).alias("odd"))


@query(f"""SELECT * FROM (SELECT grp, line, max(odd) FILTER (side = 'over') AS "over", max(odd) FILTER (side = 'under') AS "under" FROM ({_SIDED}) GROUP BY grp, line) WHERE "over" IS NOT NULL AND "under" IS NOT NULL""")
def ou_pair_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.pair_sides(_sided(spark, sf_dir), ["grp", "line"])


@query(f"""WITH r AS ({_SIDED}), s AS (SELECT grp, line, house, max(odd) FILTER (side = 'over') AS o, max(odd) FILTER (side = 'under') AS u FROM r GROUP BY ALL),
  m AS (SELECT grp, arg_min(line, (gap IS NULL, coalesce(round(gap, 9), 0), line)) AS line FROM (SELECT grp, line, avg(abs(o - u)) AS gap FROM s GROUP BY ALL) GROUP BY grp),
  b AS (SELECT grp, line, side, arg_min(house, (-odd, house)) AS house, max(odd) AS odd FROM r JOIN m USING (grp, line) GROUP BY ALL)
  SELECT grp, line, arg_min(side, k) AS side, arg_min(house, k) AS house, arg_min(odd, k) AS odd FROM (SELECT *, (round(abs(odd - 2), 9), side <> 'over') AS k FROM b) GROUP BY grp, line""")
def main_signal_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.operators.metrics import main_signals

    return main_signals(_sided(spark, sf_dir), ["grp"])


@query(f"""WITH r AS (SELECT grp, line, "over", "under", a1 % 60 AS minute, 10.0 AS ref, a1, a2, a3 FROM ({L})),
  e AS (SELECT *, min(minute) OVER (PARTITION BY grp) AS lo FROM r), n AS (SELECT *, (round(abs("over" - "under"), 9), abs(line - ref), line) AS k FROM e WHERE minute <= lo + 5)
  SELECT grp, arg_min(line, k) AS line, round(min(round(abs("over" - "under"), 9)), 6) AS gap FROM n GROUP BY grp""")
def openclose_endpoint_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ladders(spark, sf_dir).withColumns({"minute": F.col("a1") % 60, "ref": F.lit(10.0)})
    return ladder.balanced_at_edge(rows, ["grp"], "open").select("grp", "line", F.round(F.abs(F.col("over") - F.col("under")), 6).alias("gap"))


@query(f"""SELECT grp, round(median(mu), 6) AS mu, count(*) AS n FROM (SELECT grp, house, avg(line) AS mu FROM ({L}) GROUP BY grp, house) GROUP BY grp""")
def consensus_median_mu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders(spark, sf_dir).groupBy("grp", "house").agg(F.avg("line").alias("mu")).groupBy("grp").agg(F.round(F.median("mu"), 6).alias("mu"), F.count("*").alias("n"))


@query("""SELECT p_partkey AS id, p_size * 10 - 250 AS price, CASE WHEN p_size * 10 - 250 >= 100 THEN round(1 + (p_size * 10 - 250) / 100.0, 2)
  WHEN p_size * 10 - 250 <= -100 THEN round(1 + 100.0 / abs(p_size * 10 - 250), 2) END AS odd FROM part""")
def american_to_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 10 - 250).cast("long").alias("price"))
    return rows.withColumn("odd", prob.american_to_decimal(F.col("price")))


_FAMILIES = """SELECT l_partkey AS grp, l_suppkey AS family, count(DISTINCT l_quantity) AS lines, CASE l_suppkey % 4 WHEN 0 THEN 'Total 3-Way' WHEN 1 THEN 'Total' WHEN 2 THEN 'Corners' ELSE 'Total 1º' END AS name FROM lineitem GROUP BY ALL"""


@query(f"""SELECT grp, family, lines, name FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY name = 'Total 3-Way', lines DESC, CASE name WHEN 'Corners' THEN 0 WHEN 'Total 1º' THEN -4 ELSE 1 END DESC, CAST(family AS VARCHAR)) AS k FROM ({_FAMILIES})) WHERE k = 1""")
def family_pick_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("family") % 4
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("grp"), F.col("l_suppkey").alias("family"), "l_quantity")
    # hardly two rows share part and supplier: counted after the shuffle, in all of its partitions, not in maps as large as a file's split
    counted = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "grp").groupBy("grp", "family").agg(F.countDistinct("l_quantity").alias("lines"))
    rows = counted.withColumn("name", F.when(kind == 0, "Total 3-Way").when(kind == 1, "Total").when(kind == 2, "Corners").otherwise("Total 1º"))
    return ladder.pick_family(rows, ["grp"]).select("grp", "family", "lines", "name")


@query("""SELECT l_suppkey AS market, count(*) AS n FROM lineitem GROUP BY l_suppkey
  HAVING bool_or(l_linenumber % 2 = 0) AND bool_or(l_linenumber % 2 = 1) AND bool_or(l_quantity % 2 = 1) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)""")
def unknown_market_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("market"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("market")).agg(F.count("*").alias("n"), F.bool_or(F.col("l_linenumber") % 2 == 0).alias("o"), F.bool_or(F.col("l_linenumber") % 2 == 1).alias("u"), F.bool_or(F.col("l_quantity") % 2 == 1).alias("h"))
    return rows.where("o AND u AND h").join(known, "market", "left_anti").select("market", "n")


@query("SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM part")
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.norm_team(F.col("p_name")).alias("name"))


_NAMES = "SELECT DISTINCT trim(regexp_replace(strip_accents(lower(coalesce(p_name, ''))), '[^a-z0-9]+', ' ', 'g')) AS a FROM part"


@query(f"SELECT a, b, round(ratio, 6) AS score FROM ({similar.ratios(f'SELECT x.a, y.a AS b FROM ({_NAMES}) x JOIN ({_NAMES}) y ON x.a < y.a')})")
def name_token_set_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of all pairs of distinct part names; a bounded dimension of names."""
    n = table(spark, sf_dir, "part").select(names.norm_team(F.col("p_name")).alias("a")).distinct()
    return n.join(n.withColumnRenamed("a", "b"), F.col("a") < F.col("b")).select("a", "b", F.round(names.token_set_ratio(F.col("a"), F.col("b")), 6).alias("score"))


@query("""WITH r AS (SELECT l_partkey AS grp, l_shipdate AS ts, l_orderkey AS a1, l_linenumber AS a2, l_quantity AS v FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts DESC, a1 DESC, a2 DESC, v DESC) - 1 AS k FROM r)
  SELECT grp, round(sum(pow(0.5, k / 8.0) * v) / sum(pow(0.5, k / 8.0)), 6) AS mean, count(*) AS n FROM k WHERE k < 80 GROUP BY grp HAVING count(*) >= 3""")
def ewma_halflife(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("grp"), "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    out = history.half_life_mean(rows, ["grp"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_quantity")], "l_quantity", 8.0, 80, 3)
    return out.select("grp", F.round("mean", 6).alias("mean"), "n")
