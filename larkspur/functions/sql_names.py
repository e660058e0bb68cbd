"""SQL names for the pricers and a table function over events, so that a text of SQL alone can price a board.

They are SQL functions: the optimizer puts their bodies in place of the calls, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_TERMS = "CASE WHEN k >= 1 THEN sequence(1, CAST(k AS INT)) ELSE CAST(array() AS ARRAY<INT>) END"
_SUM = f"aggregate({_TERMS}, named_struct('t', {{first}}, 's', {{first}}), (a, i) -> named_struct('t', a.t * {{ratio}}, 's', a.s + a.t * {{ratio}}), a -> least(1.0D, a.s))"
_WHOLE = "abs(line - round(line)) < 1e-9"
_K = f"CASE WHEN {_WHOLE} THEN round(line) ELSE floor(line) END"

#: name: (parameters, type, body)
FUNCTIONS = {
    "poisson_cdf": ("k DOUBLE, mu DOUBLE", "DOUBLE", f"CASE WHEN k < 0 THEN 0.0D ELSE {_SUM.format(first='exp(-mu)', ratio='mu / i')} END"),
    "negbin_size_cdf": (
        "k DOUBLE, mu DOUBLE, phi DOUBLE", "DOUBLE",
        f"CASE WHEN k < 0 THEN 0.0D WHEN phi IS NULL OR phi <= 0 OR phi > 1e6 THEN poisson_cdf(k, mu) ELSE {_SUM.format(first='exp(phi * ln(phi / (phi + mu)))', ratio='(mu / (phi + mu)) * (phi + i - 1) / i')} END",
    ),
    "poisson_over": ("mu DOUBLE, line DOUBLE", "DOUBLE", f"CASE WHEN mu <= 0 THEN 0.0D ELSE greatest(0.0D, 1 - poisson_cdf({_K}, mu)) END"),
    "poisson_under": ("mu DOUBLE, line DOUBLE", "DOUBLE", f"CASE WHEN mu <= 0 THEN 1.0D ELSE poisson_cdf(CASE WHEN {_WHOLE} THEN round(line) - 1 ELSE floor(line) END, mu) END"),
    "poisson_push": ("mu DOUBLE, line DOUBLE", "DOUBLE", f"CASE WHEN mu > 0 AND {_WHOLE} THEN greatest(0.0D, poisson_cdf(round(line), mu) - poisson_cdf(round(line) - 1, mu)) ELSE 0.0D END"),
    "expected_value": ("p_win DOUBLE, odd DOUBLE, p_push DOUBLE", "DOUBLE", "p_win * odd + p_push - 1"),
    "fair_odd": ("p_win DOUBLE, p_push DOUBLE", "DOUBLE", "CASE WHEN p_win > 1e-12 THEN (1 - p_push) / p_win END"),
    "conditional_win": ("p_win DOUBLE, p_push DOUBLE", "DOUBLE", "CASE WHEN p_push < 1 - 1e-12 THEN p_win / (1 - p_push) ELSE 0.0D END"),
    "margin": ("over DOUBLE, under DOUBLE", "DOUBLE", "CASE WHEN over > 1 AND under > 1 THEN 1 / over + 1 / under - 1 END"),
    "fair_over": ("over DOUBLE, under DOUBLE", "DOUBLE", "CASE WHEN over > 1 AND under > 1 THEN (1 / over) / (1 / over + 1 / under) END"),
    "american_to_decimal": ("price DOUBLE", "DOUBLE", "CASE WHEN price >= 100 THEN round(1 + price / 100, 2) WHEN price <= -100 THEN round(1 + 100 / abs(price), 2) END"),
    "event_markets": ("event STRING", "MAP<STRING, VARIANT>", "try_variant_get(try_parse_json(event), '$.mercados', 'map<string, variant>')"),
    "market_rungs": ("market VARIANT", "ARRAY<VARIANT>", "try_variant_get(market, '$', 'array<variant>')"),
    "clv_percent": ("open_odd DOUBLE, close_odd DOUBLE", "DOUBLE", "(open_odd / close_odd - 1) * 100"),
}

#: name: (parameters, columns, body). A call over a relation joins it with its distinct arguments; over large ones
#: ``explode`` of event_markets and ``posexplode`` of market_rungs give the same without a join.
TABLES = {
    "ladder_explode": (
        "event STRING", "market STRING, pos INT, line DOUBLE, over DOUBLE, under DOUBLE",
        "SELECT m.key, r.pos, try_variant_get(r.value, '$.linha', 'double'), try_variant_get(r.value, '$.over', 'double'), try_variant_get(r.value, '$.under', 'double')"
        " FROM variant_explode(try_variant_get(try_parse_json(event), '$.mercados', 'variant')) m, LATERAL variant_explode(m.value) r",
    ),
}


def register(spark: SparkSession) -> None:
    """Make all names known to a session; names that are there are replaced."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
