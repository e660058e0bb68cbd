"""Queries over time series: events are observed prices (game, house, time, odd), orders are fixtures and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import prob, times
from larkspur.operators import history, identity, metrics
from larkspur.plans.registry import query, table

#: Now, for queries that need one.
NOW = "2024-02-01 00:00:00"


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("game"), F.col("event_type").alias("house"), "ts",
        F.round(1.02 + F.col("value") / 100 + 1e-7, 2).alias("odd"), "props")


def kickoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("game")).agg((F.max("ts") - F.expr("INTERVAL 2 DAYS")).alias("kickoff"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).join(kickoffs(spark, sf_dir), "game")


E = "SELECT event_id AS id, user_id AS game, event_type AS house, ts, round(1.02 + value / 100 + 1e-7, 2) AS odd, props FROM events"
K = "SELECT user_id AS game, max(ts) - INTERVAL 2 DAY AS kickoff FROM events GROUP BY user_id"
T = f"SELECT e.*, k.kickoff FROM ({E}) e JOIN ({K}) k USING (game)"


@query(f"""SELECT * FROM (SELECT id, game, house, odd, lag(odd) OVER w AS previous, CASE WHEN lag(odd) OVER w IS NULL THEN 'open' WHEN abs(odd - lag(odd) OVER w) >= 0.01 - 1e-9 THEN 'price' END AS kind
  FROM ({E}) WINDOW w AS (PARTITION BY game, house ORDER BY ts, id)) WHERE kind IS NOT NULL""")
def price_ticks_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.ticks(observed(spark, sf_dir), ["game", "house"], "ts", "odd", order=("id",)).select("id", "game", "house", "odd", "previous", "kind")


@query(f"""SELECT * FROM (SELECT id, game, line, lag(line) OVER w AS previous, CASE WHEN lag(line) OVER w IS NULL THEN 'open' WHEN line <> lag(line) OVER w THEN 'price' END AS kind
  FROM (SELECT *, floor(odd) + 0.5 AS line FROM ({E})) WINDOW w AS (PARTITION BY game ORDER BY ts, id)) WHERE kind IS NOT NULL""")
def line_moves_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed(spark, sf_dir).withColumn("line", F.floor("odd") + F.lit(0.5))
    return history.ticks(rows, ["game"], "ts", "line", order=("id",)).select("id", "game", "line", "previous", "kind")


_FOLD = f"""SELECT game, house, arg_min(odd, (ts, id)) FILTER (alive) AS open_odd, min(ts) FILTER (alive) AS open_ts, arg_max(odd, (ts, id)) FILTER (alive) AS last_odd,
  max(ts) FILTER (alive) AS last_ts, max(odd) FILTER (alive) AS max_odd, min(odd) FILTER (alive) AS min_odd, count(*) AS n_obs, count(*) FILTER (alive AND abs(odd - prev) >= 0.01 - 1e-9) AS n_moves, any_value(kickoff) AS kickoff
  FROM (SELECT *, lag(odd) OVER (PARTITION BY game, house, alive ORDER BY ts, id) AS prev FROM (SELECT *, ts < kickoff - INTERVAL 45 SECOND AS alive FROM ({T}))) GROUP BY game, house"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.fold(timed(spark, sf_dir), ["game", "house"], order=("id",))


@query(_FOLD)
def open_last_minmax_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir)


_STATE = f"""SELECT *, CASE n_obs % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'settled' END AS status, CASE WHEN n_obs % 5 > 0 THEN last_odd END AS close_odd, CASE WHEN n_obs % 7 > 0 THEN last_ts END AS close_ts FROM ({_FOLD})"""
_QUALITY = """CASE WHEN kickoff IS NULL OR open_ts IS NULL THEN 'unknown' WHEN open_ts >= kickoff - INTERVAL 45 SECOND THEN 'post_kickoff'
  WHEN status = 'open' THEN band WHEN close_odd IS NULL OR close_odd = 0 OR close_ts IS NULL OR close_ts >= kickoff - INTERVAL 45 SECOND THEN 'no_close' ELSE band END"""
_GRADED = f"SELECT *, {_QUALITY} AS quality FROM (SELECT *, CASE WHEN open_ts > kickoff - INTERVAL 3 HOUR THEN 'late_open' ELSE 'full_prematch' END AS band FROM ({_STATE}))"


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _folded(spark, sf_dir).withColumns({
        "status": F.when(F.col("n_obs") % 4 == 0, "open").when(F.col("n_obs") % 4 == 1, "closed").otherwise("settled"),
        "close_odd": F.when(F.col("n_obs") % 5 > 0, F.col("last_odd")), "close_ts": F.when(F.col("n_obs") % 7 > 0, F.col("last_ts")),
    })
    return state.withColumn("quality", times.capture_quality(*[F.col(c) for c in ("open_ts", "close_odd", "close_ts", "kickoff", "status")]))


@query(f"SELECT status, quality, count(*) AS n, sum(n_obs)::BIGINT AS n_obs FROM ({_GRADED}) GROUP BY status, quality")
def capture_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).groupBy("status", "quality").agg(F.count("*").alias("n"), F.sum("n_obs").alias("n_obs"))


_REASON = """CASE WHEN status <> 'settled' THEN 'not_settled' WHEN NOT coalesce(open_odd > 1, false) THEN 'invalid_open' WHEN NOT coalesce(close_odd > 1, false) THEN 'invalid_close'
  WHEN kickoff IS NULL THEN 'missing_kickoff' WHEN open_ts IS NULL THEN 'missing_open_ts' WHEN close_ts IS NULL THEN 'missing_close_ts'
  WHEN open_ts >= kickoff - INTERVAL 45 SECOND THEN 'open_not_prematch' WHEN close_ts >= kickoff - INTERVAL 45 SECOND THEN 'close_not_prematch'
  WHEN quality NOT IN ('full_prematch', 'late_open') THEN 'quality_' || quality END"""


def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).withColumn("reason", times.strict_reason(*[F.col(c) for c in ("status", "open_odd", "close_odd", "open_ts", "close_ts", "kickoff", "quality")]))


@query(f"SELECT coalesce({_REASON}, 'valid') AS reason, count(*) AS n FROM ({_GRADED}) GROUP BY 1")
def strict_clv_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strict(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT game, house, TIMESTAMP '{NOW}' >= kickoff - INTERVAL 2 MINUTE AS frozen, CASE WHEN last_ts < kickoff - INTERVAL 45 SECOND THEN last_odd END AS close_odd FROM ({_FOLD})")
def freeze_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    return _folded(spark, sf_dir).select("game", "house", times.freezes(now, F.col("kickoff")).alias("frozen"), F.when(times.prematch(F.col("last_ts"), F.col("kickoff")), F.col("last_odd")).alias("close_odd"))


_CLV = f"""SELECT game, house, game % 5 AS market, open_odd, last_odd, (open_odd / last_odd - 1) * 100 AS clv,
  CASE WHEN abs(game % 6 - line) > 1e-9 THEN CASE WHEN house < 'm' THEN game % 6 > line ELSE game % 6 < line END END AS won
  FROM (SELECT *, CASE WHEN n_obs % 2 = 0 THEN 3.0 ELSE 2.5 END AS line FROM ({_FOLD})) WHERE open_odd > 1 AND last_odd > 1"""


def _clv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _folded(spark, sf_dir).where("open_odd > 1 AND last_odd > 1").withColumn("line", F.when(F.col("n_obs") % 2 == 0, 3.0).otherwise(2.5))
    side = F.when(F.col("house") < "m", "over").otherwise("under")
    return rows.select("game", "house", (F.col("game") % 5).alias("market"), "open_odd", "last_odd", prob.clv_percent(F.col("open_odd"), F.col("last_odd")).alias("clv"), prob.settle(F.col("game") % 6, F.col("line"), side).alias("won"))


_W = """(100 * ({k} / n + 1.9208 / n {s} 1.96 * sqrt({k} / n * (1 - {k} / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n))"""
_AGG = f"""n, n_dec, round(100 * beat / n, 6) AS beat, round({_W.format(k='beat', s='-')}, 6) AS beat_lo, round({_W.format(k='beat', s='+')}, 6) AS beat_hi, round(m, 6) AS clv_mean, round(med, 6) AS clv_median,
  round(CASE WHEN n > 1 THEN m - 1.96 * sd / sqrt(n) END, 6) AS clv_lo, round(CASE WHEN n > 1 THEN m + 1.96 * sd / sqrt(n) END, 6) AS clv_hi, round(100 * green / nullif(n_dec, 0), 6) AS green"""
_SUM = "count(*) AS n, count(won) AS n_dec, count(*) FILTER (clv > 0) AS beat, avg(clv) AS m, median(clv) AS med, stddev_samp(clv) AS sd, count(*) FILTER (won) AS green"


@query(f"SELECT {_AGG} FROM (SELECT {_SUM} FROM ({_CLV}))")
def clv_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clv(spark, sf_dir).agg(*metrics.clv_columns())


@query(f"SELECT market, {_AGG} FROM (SELECT market, {_SUM} FROM ({_CLV}) GROUP BY market)")
def wilson_by_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clv(spark, sf_dir).groupBy("market").agg(*metrics.clv_columns())


@query(f"""SELECT market, round(CASE WHEN count(*) >= 50 THEN 100 * avg(CASE WHEN won IS NULL THEN 0.0 WHEN won THEN open_odd - 1 ELSE -1.0 END) END, 6) AS roi, count(*) AS n, count(*) FILTER (won IS NULL) AS n_push FROM ({_CLV}) GROUP BY market""")
def clv_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roi(_clv(spark, sf_dir).withColumn("push", F.col("won").isNull()), ["market"], "open_odd")


def _cuts(kind: str) -> tuple[str, str]:
    spark = {"sets": "GROUPING SETS ((market), (house), ())", "rollup": "ROLLUP (market, house)", "cube": "CUBE (market, house)"}[kind]
    return spark, f"SELECT market, house, count(*) AS n, count(*) FILTER (clv > 0) AS beat, round(avg(clv), 6) AS clv FROM ({_CLV}) GROUP BY {spark}"


def _cut_aggregates() -> list:
    return [F.count("*").alias("n"), F.count_if(F.col("clv") > 0).alias("beat"), F.round(F.avg("clv"), 6).alias("clv")]


@query(_cuts("sets")[1])
def cuts_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clv(spark, sf_dir).groupingSets([["market"], ["house"], []], "market", "house").agg(*_cut_aggregates())


@query(_cuts("rollup")[1])
def cuts_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clv(spark, sf_dir).rollup("market", "house").agg(*_cut_aggregates())


@query(_cuts("cube")[1])
def cuts_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clv(spark, sf_dir).cube("market", "house").agg(*_cut_aggregates())


@query(f"SELECT game, house, date_trunc('hour', ts)::TIMESTAMP AS bucket, max(odd) AS odd FROM ({E}) GROUP BY ALL")
def moves_hour_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.bucket_extremes(observed(spark, sf_dir), ["game", "house"], "ts", "odd", "hour").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(f"SELECT game, kickoff, arg_max(id, (ts, id)) AS id, max(ts) AS ts FROM ({T}) WHERE ts < kickoff GROUP BY game, kickoff")
def asof_last_pre_kickoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed(spark, sf_dir).select("game", "ts", "id")
    return history.as_of_last(rows, kickoffs(spark, sf_dir), "game", "ts", "kickoff").select("game", "kickoff", "id", "ts")


_RECORDS = f"""SELECT game, house, 's' || (id % 3) AS source, min(ts) AS open_ts, arg_min(odd, (ts, id)) AS open_odd, max(ts) AS last_ts, arg_max(odd, (ts, id)) AS last_odd, max(odd) AS max_odd, min(odd) AS min_odd,
  count(*) AS n_obs, count(*) // 2 AS n_moves, CASE count(*) % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' WHEN 2 THEN 'settled' WHEN 3 THEN 'unavailable' ELSE 'pending_result' END AS status, min(id) AS result FROM ({E}) GROUP BY game, house, id % 3"""


@query(f"""SELECT game, house, arg_min(open_odd, (open_ts, source)) AS open_odd, min(open_ts) AS open_ts, arg_max(last_odd, (last_ts, source)) AS last_odd, max(last_ts) AS last_ts, max(max_odd) AS max_odd, min(min_odd) AS min_odd,
  sum(n_obs)::BIGINT AS n_obs, sum(n_moves)::BIGINT AS n_moves, arg_max(status, CASE status WHEN 'settled' THEN 4 WHEN 'pending_result' THEN 3 WHEN 'closed' THEN 2 WHEN 'unavailable' THEN 1 ELSE 0 END) AS status,
  arg_max(result, (last_ts, source)) FILTER (status = 'settled') AS result, string_agg(source, ',' ORDER BY source) AS merged_from FROM ({_RECORDS}) GROUP BY game, house""")
def merge_records_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, n = F.struct("ts", "id"), F.count("*")
    status = F.when(n % 5 == 0, "open").when(n % 5 == 1, "closed").when(n % 5 == 2, "settled").when(n % 5 == 3, "unavailable").otherwise("pending_result")
    records = observed(spark, sf_dir).groupBy("game", "house", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source")).agg(
        F.min("ts").alias("open_ts"), F.min_by("odd", at).alias("open_odd"), F.max("ts").alias("last_ts"), F.max_by("odd", at).alias("last_odd"), F.max("odd").alias("max_odd"), F.min("odd").alias("min_odd"),
        n.alias("n_obs"), F.floor(n / 2).alias("n_moves"), status.alias("status"), F.min("id").alias("result"))
    return history.merge_records(records, ["game", "house"])


@query(f"SELECT game, house, odd, min(id) AS id, min(props) AS props FROM ({E}) GROUP BY game, house, odd")
def tick_signature_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.dedup_signature(observed(spark, sf_dir), ["game", "house", "odd"], ["id", "props"])


@query(f"SELECT id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM ({E})")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).select("id", F.from_json("props", "k long")["k"].alias("k"))


@query(f"SELECT bucket, status, count(*) AS n FROM (SELECT status, CASE WHEN kickoff IS NULL THEN 'unknown' WHEN h < 0 THEN 'not_started' WHEN h < 24 THEN '0-24h' WHEN h < 72 THEN '1-3d' WHEN h < 168 THEN '3-7d' WHEN h < 720 THEN '7-30d' ELSE '30d+' END AS bucket FROM (SELECT *, (epoch(TIMESTAMP '{NOW}') - epoch(kickoff)) / 3600 AS h FROM ({_STATE}))) GROUP BY ALL")
def settlement_backlog_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    hours = (seconds(F.lit(NOW)) - seconds(F.col("kickoff"))) / 3600
    return _graded(spark, sf_dir).groupBy(times.age_bucket(hours).alias("bucket"), "status").agg(F.count("*").alias("n"))


@query(f"SELECT house, count(DISTINCT game) AS games, count(*) AS lines FROM ({E}) GROUP BY house")
def coverage_distinct_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).groupBy("house").agg(F.countDistinct("game").alias("games"), F.count("*").alias("lines"))


@query(f"SELECT house, count(DISTINCT (game, id % 2)) AS instruments FROM ({E}) GROUP BY house")
def coverage_gate_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).groupBy("house").agg(F.countDistinct("game", F.col("id") % 2).alias("instruments"))


@query(f"""WITH b AS (SELECT game, count(*) AS n FROM ({E}) WHERE id % 2 = 0 GROUP BY game), c AS (SELECT game, count(*) AS n FROM ({E}) WHERE id % 5 = 1 GROUP BY game)
  SELECT game, b.n AS before, coalesce(c.n, 0) AS now FROM b LEFT JOIN c USING (game) WHERE b.n >= 8 AND coalesce(c.n, 0) < b.n * 0.35""")
def baseline_collapse_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed(spark, sf_dir)
    count = lambda d: d.groupBy("game").agg(F.count("*").alias("n"))
    return metrics.collapsed(count(rows.where("id % 5 = 1")), count(rows.where("id % 2 = 0")), ["game"], 8, 0.35)


@query(f"SELECT house, count(*) AS total, count(*) FILTER (odd > 1.3) AS ok, round(100.0 * count(*) FILTER (odd > 1.3) / count(*), 6) AS rate, round(avg(odd), 6) AS avg_n FROM ({E}) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY house")
def reliability_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed(spark, sf_dir)
    since = rows.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since")).first().since
    recent = rows.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    ok = F.count_if(F.col("odd") > 1.3)
    return recent.groupBy("house").agg(F.count("*").alias("total"), ok.alias("ok"), F.round(100.0 * ok / F.count("*"), 6).alias("rate"), F.round(F.avg("odd"), 6).alias("avg_n"))


@query("SELECT o_orderkey AS game FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_critical_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game")).join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game")), "game", "left_anti")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def covered_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("SELECT house, count(*) AS n, round(sum(odd), 4) AS total FROM (" + " UNION ALL ".join(f"SELECT {i} AS house, round(1.02 + value / 100 + 1e-7, 2) AS odd FROM events WHERE user_id % 7 = {i}" for i in range(7)) + ") GROUP BY house")
def house_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed(spark, sf_dir)
    houses = [rows.where(F.col("game") % 7 == i).select(F.lit(i).alias("house"), "odd") for i in range(7)]
    out = houses[0]
    for h in houses[1:]:
        out = out.unionByName(h)
    return out.groupBy("house").agg(F.count("*").alias("n"), F.round(F.sum("odd"), 4).alias("total"))


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders UNION SELECT CAST(CAST(ts AS DATE) AS VARCHAR) FROM events")
def day_pool_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").cast("string").alias("day")).union(table(spark, sf_dir, "events").select(F.to_date("ts").cast("string"))).distinct()


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT user_id FROM events")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).intersect(table(spark, sf_dir, "events").select("user_id"))


@query(f"""WITH f AS (SELECT game, kickoff, CAST(kickoff AS DATE) AS day FROM ({K})) SELECT f.game, count(g.game) AS rivals FROM f LEFT JOIN f g ON f.day = g.day AND f.game <> g.game AND abs(epoch_us(f.kickoff) - epoch_us(g.kickoff)) <= 25 * 60000000 GROUP BY f.game""")
def interval_slot_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kickoffs(spark, sf_dir).withColumns({"day": F.to_date("kickoff"), "kickoff": F.col("kickoff").cast("timestamp")})
    return identity.slot_rivals(rows, "day", "kickoff", "game", 25)


@query(f"SELECT game, house, odd, margin FROM (SELECT game, house, odd, round(odd - lead(odd) OVER w, 6) AS margin, row_number() OVER w AS k FROM (SELECT game, house, max(odd) AS odd FROM ({E}) GROUP BY ALL) WINDOW w AS (PARTITION BY game ORDER BY odd DESC, house)) WHERE k = 1")
def runner_up_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = observed(spark, sf_dir).groupBy("game", "house").agg(F.max("odd").alias("odd"))
    return metrics.runner_up(best, ["game"], "odd", ["house"]).withColumn("margin", F.round("margin", 6))


_EDGES = "SELECT o_custkey AS a, o_orderkey % 97 + 1 AS b FROM orders WHERE o_custkey <> o_orderkey % 97 + 1"
#: Labels fall to the least of the neighbours' until none changes.
_COMPONENTS = f"""WITH RECURSIVE e AS ({_EDGES}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM u GROUP BY a
  UNION SELECT u.a, min(r.component) FROM r JOIN u ON r.node = u.b JOIN recurring.r AS k ON k.node = u.a WHERE r.component < k.component GROUP BY u.a) SELECT node, component FROM r"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 97 + 1).alias("b")).where("a <> b")
    return identity.unify(edges)


@query(_COMPONENTS)
def game_unify_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir)


@query(_COMPONENTS)
def game_unify_all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under the name it had while game_unify_components took a part of the orders."""
    return _components(spark, sf_dir)


@query(f"SELECT house, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(sum(odd), 4) AS total FROM ({E}) GROUP BY ALL")
def tumbling_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).groupBy("house", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("odd"), 4).alias("total")).select("house", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query(f"SELECT house, b - i * INTERVAL 2 HOUR AS start, count(*) AS n FROM (SELECT house, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS b, unnest([0, 1, 2]) AS i FROM ({E})) GROUP BY ALL")
def sliding_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).groupBy("house", F.window("ts", "6 hours", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("house", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(f"""WITH g AS (SELECT game, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM ({E}) WINDOW w AS (PARTITION BY game ORDER BY ts)), s AS (SELECT game, ts, sum(fresh) OVER (PARTITION BY game ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT game, min(ts) AS start, count(*) AS n FROM s GROUP BY game, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).groupBy("game", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n")).select("game", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(f"SELECT game, least(100, least(40, 10 * houses) + CASE WHEN n >= 20 THEN 30 WHEN n >= 10 THEN 20 ELSE 10 END + CASE WHEN spread < 0.5 THEN 30 ELSE 10 END) AS score FROM (SELECT game, count(DISTINCT house) AS houses, count(*) AS n, max(odd) - min(odd) AS spread FROM ({E}) GROUP BY game)")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = observed(spark, sf_dir).groupBy("game").agg(F.countDistinct("house").alias("houses"), F.count("*").alias("n"), (F.max("odd") - F.min("odd")).alias("spread"))
    score = F.least(F.lit(100), F.least(F.lit(40), 10 * F.col("houses")) + F.when(F.col("n") >= 20, 30).when(F.col("n") >= 10, 20).otherwise(10) + F.when(F.col("spread") < 0.5, 30).otherwise(10))
    return g.select("game", score.alias("score"))


@query("""WITH r AS (SELECT o_orderkey AS game, o_orderdate AS day, o_totalprice AS score FROM orders), c AS (SELECT l_orderkey AS game, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT coalesce(status, 'game_not_in_results') AS status, count(*) AS n FROM (SELECT r.game, CASE WHEN c.total > 100 THEN 'won' WHEN c.total < 100 THEN 'lost' WHEN c.total = 100 THEN 'push' END AS status FROM r LEFT JOIN c USING (game)) GROUP BY 1""")
def settle_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game")).agg(F.sum("l_quantity").alias("total"))
    won = prob.settle(F.col("total"), F.lit(100.0), F.lit("over"))
    status = F.when(F.col("total").isNull(), "game_not_in_results").when(won.isNull(), "push").when(won, "won").otherwise("lost")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game")).join(results, "game", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"SELECT market, n, share FROM (SELECT house AS market, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({E}) GROUP BY house)")
def flags_by_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = observed(spark, sf_dir).groupBy(F.col("house").alias("market")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))
