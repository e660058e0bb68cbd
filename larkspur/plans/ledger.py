"""Queries over the ledger of observed prices: banners, counts, owners, indexes, pairs, filters and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import prob
from larkspur.operators import gates, metrics
from larkspur.plans.registry import query, table

#: An event as a line of a market: side, line, capture and state come from its keys.
B = """SELECT event_id AS id, user_id AS game, event_type AS house, ts, round(1.02 + value / 100 + 1e-7, 2) AS odd, 'm' || event_id % 4 AS market, (event_id // 8) % 5 + 0.5 AS line,
  CASE WHEN event_id % 2 = 0 THEN 'over' ELSE 'under' END AS side, CASE WHEN event_id % 7 <> 0 THEN event_id % 5 < 2 END AS won, value - 100 AS clv FROM events"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("id"), F.col("user_id").alias("game"), F.col("event_type").alias("house"), "ts", F.round(1.02 + F.col("value") / 100 + 1e-7, 2).alias("odd"),
        F.concat(F.lit("m"), i % 4).alias("market"), (F.expr("event_id DIV 8") % 5 + 0.5).cast("double").alias("line"), F.when(i % 2 == 0, "over").otherwise("under").alias("side"),
        F.when(i % 7 != 0, i % 5 < 2).alias("won"), (F.col("value") - 100).alias("clv"),
    )


def _w(k: str, n: str, sign: str) -> str:
    return f"100 * ({k} / {n} + 1.9208 / {n} {sign} 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 0.9604 / ({n} * {n}))) / (1 + 3.8416 / {n})"


@query(f"""SELECT n AS n_beat, round(100 * k / n, 6) AS green_beat, m AS n_not, round(100 * j / m, 6) AS green_not, {_w('k', 'n', '-')} > {_w('j', 'm', '+')} AS apart
  FROM (SELECT count(*) FILTER (clv > 0)::DOUBLE AS n, count(*) FILTER (clv > 0 AND won)::DOUBLE AS k, count(*) FILTER (NOT clv > 0)::DOUBLE AS m, count(*) FILTER (NOT clv > 0 AND won)::DOUBLE AS j FROM ({B}) WHERE won IS NOT NULL)""")
def beat_versus_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.beat_split(ledger(spark, sf_dir))


@query(f"""SELECT quality, count(*) AS n, round(100.0 * count(*) FILTER (moves > 0) / count(*), 6) AS moved FROM (SELECT game, house, CASE WHEN count(*) >= 20 THEN 'deep' WHEN count(*) >= 5 THEN 'fair' ELSE 'thin' END AS quality, count(DISTINCT odd) - 1 AS moves FROM ({B}) GROUP BY game, house) GROUP BY quality""")
def bank_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    lines = ledger(spark, sf_dir).groupBy("game", "house").agg(F.when(n >= 20, "deep").when(n >= 5, "fair").otherwise("thin").alias("quality"), (F.countDistinct("odd") - 1).alias("moves"))
    return lines.groupBy("quality").agg(n.alias("n"), F.round(100.0 * F.count_if(F.col("moves") > 0) / n, 6).alias("moved"))


@query(f"SELECT CAST(ts AS DATE)::VARCHAR AS day, market, count(DISTINCT game) AS events FROM ({B}) GROUP BY ALL")
def snapshot_market_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy(F.to_date("ts").cast("string").alias("day"), "market").agg(F.countDistinct("game").alias("events"))


@query(f"SELECT coalesce(house, 'all') AS house, coalesce(market, 'all') AS market, count(*) AS n, count(DISTINCT game) AS games FROM ({B}) GROUP BY GROUPING SETS ((house, market), (house), (market), ())")
def capture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ledger(spark, sf_dir).cube("house", "market").agg(F.count("*").alias("n"), F.countDistinct("game").alias("games"))
    return g.select(F.coalesce("house", F.lit("all")).alias("house"), F.coalesce("market", F.lit("all")).alias("market"), "n", "games")


@query(f"SELECT game, house, market, n, month FROM (SELECT *, row_number() OVER (PARTITION BY game, house, market ORDER BY month DESC) AS k FROM (SELECT game, house, market, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM ({B}) GROUP BY ALL)) WHERE k = 1")
def newest_month_owns(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = ledger(spark, sf_dir).groupBy("game", "house", "market", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return metrics.consolidated(months, ["game", "house", "market"], "month").select("game", "house", "market", "n", "month")


@query(f"SELECT house, count(DISTINCT game) AS games, round(100.0 * count(DISTINCT game) FILTER (game % 3 > 0) / count(DISTINCT game), 6) AS with_fixture FROM ({B}) GROUP BY house")
def games_per_house(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = ledger(spark, sf_dir).select("house", "game").distinct()
    return games.groupBy("house").agg(F.count("*").alias("games"), F.round(100.0 * F.count_if(F.col("game") % 3 > 0) / F.count("*"), 6).alias("with_fixture"))


@query(f"SELECT game, market, side, n FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY n DESC, market, side) AS k FROM (SELECT game, market, side, count(*) AS n FROM ({B}) GROUP BY ALL)) WHERE k = 1")
def owner_pair_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.owners(ledger(spark, sf_dir), ["game"], ["market", "side"])


@query(f"SELECT sum(n) AS before, sum(n) AS after, true AS equal FROM (SELECT game, count(*) AS n FROM ({B}) GROUP BY game)")
def rekey_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations before and after games are put under another key."""
    counts = ledger(spark, sf_dir).groupBy("game").agg(F.count("*").alias("n"))
    after = counts.groupBy((F.col("game") % 50).alias("game")).agg(F.sum("n").alias("n"))
    return counts.agg(F.sum("n").alias("before")).join(after.agg(F.sum("n").alias("after")), F.lit(True)).withColumn("equal", F.col("before") == F.col("after"))


_MAIN = f"SELECT game, house, arg_min(line, (gap, line)) AS line FROM (SELECT game, house, line, round(abs(avg(odd) FILTER (side = 'over') - avg(odd) FILTER (side = 'under')), 9) AS gap FROM ({B}) GROUP BY ALL) WHERE gap IS NOT NULL GROUP BY ALL"


@query(f"SELECT game, line, n FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY n DESC, line) AS k FROM (SELECT game, line, count(*) AS n FROM ({_MAIN}) GROUP BY ALL)) WHERE k = 1")
def board_line_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main line of most houses."""
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("odd")))
    lines = ledger(spark, sf_dir).groupBy("game", "house", "line").agg(F.round(F.abs(mean("over") - mean("under")), 9).alias("gap")).where("gap IS NOT NULL")
    mains = lines.groupBy("game", "house").agg(F.min_by("line", F.struct("gap", "line")).alias("line"))
    return metrics.owners(mains, ["game"], ["line"])


@query(f"SELECT house, max(ts) AS latest, count(*) AS n, min(id) AS first_id FROM ({B}) GROUP BY house")
def artifact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy("house").agg(F.max("ts").alias("latest"), F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"""SELECT game, market, line, count(*) AS n, bool_or(won IS NOT NULL) AS settled, array_to_string(list_sort(list(DISTINCT house)), ',') AS houses, array_to_string(list_sort(list(DISTINCT side)), ',') AS sides FROM ({B}) GROUP BY ALL""")
def explorer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return ledger(spark, sf_dir).groupBy("game", "market", "line").agg(F.count("*").alias("n"), F.bool_or(F.col("won").isNotNull()).alias("settled"), listed("house").alias("houses"), listed("side").alias("sides"))


_PAIRED = f"""SELECT house, game, t, line, max(odd) FILTER (side = 'over') AS o, max(odd) FILTER (side = 'under') AS u FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS t FROM ({B})) GROUP BY ALL"""


@query(f"SELECT house, game, t, line, o, u FROM ({_PAIRED}) WHERE o IS NOT NULL AND u IS NOT NULL")
def pairs_of_one_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over and under of a line, seen within one span of time."""
    return _pairs(spark, sf_dir).where("o IS NOT NULL AND u IS NOT NULL")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lambda s: F.max(F.when(F.col("side") == s, F.col("odd")))
    spans = ledger(spark, sf_dir).withColumn("t", F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_seconds(F.col("ts").cast("timestamp")) % 21600 + F.extract(F.lit("SECOND"), "ts") % 1))
    return spans.groupBy("house", "game", "t", "line").agg(best("over").alias("o"), best("under").alias("u"))


_BEST = f"SELECT house, t, arg_min(line, (gap, line, game)) AS line, arg_min(o, (gap, line, game)) AS o, arg_min(u, (gap, line, game)) AS u FROM (SELECT *, round(abs(o - u), 9) AS gap FROM ({_PAIRED}) WHERE o > 1 AND u > 1) GROUP BY ALL"


@query(f"""WITH RECURSIVE b AS (SELECT house, t, line, (1 / o) / (1 / o + 1 / u) AS q FROM ({_BEST})), s AS (SELECT *, 0.0::DOUBLE AS lo, (line * 4 + 40)::DOUBLE AS hi, 0 AS k FROM b
  UNION ALL SELECT house, t, line, q, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END, k + 1 FROM (SELECT *, 1 - list_sum([exp(-mid + i * ln(mid) - lgamma(i + 1)) FOR i IN range(0, CAST(floor(line) AS BIGINT) + 1)]) < q AS low FROM (SELECT *, (lo + hi) / 2 AS mid FROM s WHERE k < 40)))
  SELECT house, t, line, round((lo + hi) / 2, 5) AS mu FROM s WHERE k = 40""")
def implied_mu_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each house's implied mean through time, from the most balanced line of a span."""
    rows = _pairs(spark, sf_dir).where("o > 1 AND u > 1")
    best = rows.groupBy("house", "t").agg(F.min_by(F.struct("line", "o", "u"), F.struct(F.round(F.abs(F.col("o") - F.col("u")), 9), "line", "game")).alias("b"))
    priced = best.select("house", "t", "b.line", prob.devig(F.col("b.o"), F.col("b.u"))["p_over"].alias("q"))
    return priced.select("house", "t", "line", F.round(prob.solve_mu(F.col("line"), F.col("q")), 5).alias("mu"))


@query(f"SELECT game, min(ts) AS kickoff, arg_min(house, (ts, id)) FILTER (won IS NOT NULL) AS name, arg_min(won, (ts, id)) FILTER (won IS NOT NULL) AS result FROM ({B}) GROUP BY game")
def first_known_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("won").isNotNull(), F.struct("ts", "id"))
    return ledger(spark, sf_dir).groupBy("game").agg(F.min("ts").alias("kickoff"), F.min_by("house", at).alias("name"), F.min_by("won", at).alias("result"))


@query(f"SELECT house, max(n) FILTER (k = 1) AS run_1, max(n) FILTER (k = 2) AS run_2, max(n) FILTER (k = 3) AS run_3 FROM (SELECT house, n, row_number() OVER (PARTITION BY house ORDER BY day DESC) AS k FROM (SELECT house, CAST(ts AS DATE) AS day, count(*) AS n FROM ({B}) GROUP BY ALL)) GROUP BY house")
def last_runs_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ledger(spark, sf_dir).groupBy("house", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return metrics.last_runs(runs, ["house"], [F.desc("day")], "n", 3)


_STATES = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'closed' WHEN 1 THEN 'pending' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'settled' END AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 END AS retryable, CASE WHEN o_orderkey % 9 = 0 THEN '?' WHEN o_orderkey % 9 <> 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders"


@query(f"SELECT id, status, day FROM ({_STATES}) WHERE (status IN ('closed', 'pending') OR (status = 'unavailable' AND retryable IS DISTINCT FROM false)) AND day IS NOT NULL AND day <> '?'")
def retryable_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        i.alias("id"), F.get(F.array(*[F.lit(s) for s in ("closed", "pending", "unavailable", "settled", None)]), (i % 5).cast("int")).alias("status"),
        F.when(i % 3 > 0, i % 3 == 1).alias("retryable"), F.when(i % 9 == 0, "?").when(i % 9 != 1, F.to_date("o_orderdate").cast("string")).alias("day"))
    again = F.col("status").isin("closed", "pending") | ((F.col("status") == "unavailable") & ~F.col("retryable").eqNullSafe(False))
    return rows.where(again & F.col("day").isNotNull() & (F.col("day") != "?")).select("id", "status", "day")


@query(f"SELECT market, house, count(*) AS n FROM (SELECT *, count(DISTINCT house) OVER (PARTITION BY game, market, line) AS houses FROM ({B}) WHERE market IN ('m0', 'm1', 'm2') AND side = 'over' AND odd BETWEEN 1.2 AND 1.9) WHERE houses >= 2 GROUP BY ALL")
def board_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets of a list, a side, a price span, and more than one house on the line."""
    rows = ledger(spark, sf_dir).where(F.col("market").isin("m0", "m1", "m2") & (F.col("side") == "over") & F.col("odd").between(1.2, 1.9))
    wide = rows.groupBy("game", "market", "line").agg(F.countDistinct("house").alias("houses")).where("houses >= 2")
    return rows.join(wide, ["game", "market", "line"], "left_semi").groupBy("market", "house").agg(F.count("*").alias("n"))


_DIM = "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_custkey % 40 AS h, o_orderkey % 41 AS a, max(o_orderkey) AS fixture FROM orders GROUP BY ALL"


@query(f"""WITH d AS ({_DIM}), x AS (SELECT day, h, a, max(fixture) AS fixture FROM (SELECT * FROM d UNION ALL SELECT day, a, h, fixture FROM d) GROUP BY ALL)
  SELECT o.o_orderkey AS id, x.fixture FROM orders o LEFT JOIN x ON x.day = CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) AND x.h = o.o_orderkey % 41 AND x.a = o.o_custkey % 40""")
def alias_of_both_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy games (day, names) to fixtures, whichever side is named first; the latest fixture wins."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("day"), (F.col("o_custkey") % 40).alias("p"), (F.col("o_orderkey") % 41).alias("q"))
    one = o.select("day", F.col("p").alias("h"), F.col("q").alias("a"), F.col("id").alias("fixture"))
    alias = one.unionByName(one.select("day", F.col("a").alias("h"), F.col("h").alias("a"), "fixture")).groupBy("day", "h", "a").agg(F.max("fixture").alias("fixture"))
    return o.select("id", "day", F.col("q").alias("h"), F.col("p").alias("a")).join(alias, ["day", "h", "a"], "left").select("id", "fixture")


_COUNTS = f"SELECT game, market, count(*) AS n0, count(*) FILTER (odd >= 1.6) AS n1 FROM ({B}) GROUP BY ALL"


@query(f"SELECT 'baseline_game_market' AS gate, game || '|' || market AS subject, n0 || ' -> ' || n1 AS reason FROM ({_COUNTS}) WHERE n0 >= 2 AND n1 < n0 * 0.5")
def gate_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    count = lambda d: d.groupBy("game", "market").agg(F.count("*").alias("n"))
    return gates.baseline(count(rows.where("odd >= 1.6")), count(rows), ["game", "market"], 2)


@query(f"SELECT 'status' AS gate, CAST(game AS VARCHAR) AS subject, CASE WHEN ok THEN 'empty' ELSE 'Parse' END AS reason FROM (SELECT game, count(*) % 4 > 0 AS ok, count(*) % 3 AS n FROM ({B}) GROUP BY game) WHERE NOT ok OR n = 0")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return gates.status(ledger(spark, sf_dir).groupBy(F.col("game").alias("house")).agg((n % 4 > 0).alias("ok"), (n % 3).alias("n_events")).withColumn("error_class", F.lit("Parse")))


@query(f"SELECT 'fixture_coverage' AS gate, 'board' AS subject, CAST(round(share, 4) AS VARCHAR) AS reason FROM (SELECT count(*) FILTER (game % 2 = 0) / count(*) AS share FROM (SELECT DISTINCT game FROM ({B}))) WHERE share < 0.6")
def gate_fixture_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.fixture_coverage(ledger(spark, sf_dir).select("game").distinct().withColumn("fixture", F.when(F.col("game") % 2 == 0, F.col("game"))))


@query(f"""SELECT 'flag_audit' AS gate, game || '|' || market || '|' || house AS subject, CASE WHEN 1 / o + 1 / u - 1 < 0 THEN 'negative_margin' WHEN game % 5 = 0 THEN 'three_way' ELSE 'past_game' END AS reason FROM (
  SELECT game, market, house, max(odd) FILTER (side = 'over') AS o, min(odd) FILTER (side = 'over') + 0.5 AS u FROM ({B}) GROUP BY ALL) WHERE o IS NOT NULL AND (1 / o + 1 / u - 1 < 0 OR game % 5 = 0 OR game % 7 = 0)""")
def gate_flag_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = F.when(F.col("side") == "over", F.col("odd"))
    lines = ledger(spark, sf_dir).groupBy("game", "market", "house").agg(F.max(over).alias("over"), (F.min(over) + 0.5).alias("under")).where("over IS NOT NULL")
    lines = lines.withColumns({"line": F.lit(2.5), "three_way": F.col("game") % 5 == 0, "begun": F.col("game") % 7 == 0})
    return gates.flag_audit(lines.select("game", "market", "house", F.lit(2.5 + 1e-10).alias("flag_line")), lines)


@query(f"SELECT 'identity_purity' AS gate, CAST(game AS VARCHAR) AS subject, CAST(n AS VARCHAR) AS reason FROM (SELECT game, count(DISTINCT house) AS n FROM ({B}) GROUP BY game) WHERE n > 1")
def gate_identity_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.purity(ledger(spark, sf_dir).select(F.col("game").alias("fixture"), F.col("house").alias("component")))


@query(f"SELECT 'market_collapse' AS gate, market AS subject, n0 || ' -> ' || n1 AS reason FROM (SELECT market || game % 9 AS market, count(*) AS n0, count(*) FILTER (odd >= 1.6) AS n1 FROM ({B}) GROUP BY ALL) WHERE n0 >= 8 AND n1 < n0 * 0.35")
def gate_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).withColumn("market", F.concat("market", F.col("game") % 9))
    count = lambda d: d.groupBy("market").agg(F.count("*").alias("n"))
    return gates.promotion_block(count(rows.where("odd >= 1.6")), count(rows))


_ARTIFACTS = f"SELECT house AS name, date_trunc('minute', max(ts)) AS ts, count(*) AS n, count(*) FILTER (odd < 1.9) AS m FROM ({B}) GROUP BY house"


@query(f"""WITH a AS ({_ARTIFACTS})
  SELECT 'manifest_age' AS gate, name AS subject, CAST(ts AS VARCHAR) AS reason FROM a, (SELECT TIMESTAMP '2024-01-31 00:00:00' AS now) WHERE epoch_us(now) - epoch_us(ts) > 360 * 60000000::BIGINT
  UNION ALL SELECT 'manifest_spread', 'all', CAST((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000 AS VARCHAR) FROM a HAVING epoch_us(max(ts)) - epoch_us(min(ts)) > 1 * 60000000
  UNION ALL SELECT 'manifest_shrink', name, n || ' -> ' || m FROM a WHERE m < n * 0.98""")
def gate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of the houses that are old, far apart in time, or shrunk."""
    rows = ledger(spark, sf_dir).groupBy(F.col("house").alias("name")).agg(F.date_trunc("minute", F.max("ts")).cast("timestamp").alias("ts"), F.count("*").alias("before"), F.count_if(F.col("odd") < 1.9).alias("valid_count"))
    return gates.manifest(rows, "2024-01-31 00:00:00", most_spread_minutes=1)
