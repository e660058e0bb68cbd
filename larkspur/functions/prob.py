"""Probability and price expressions: Column builders, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gives P(X <= k) for k.
Cdf = Callable[[Column], Column]
#: Gives struct(at, below): P(X <= k) and P(X <= k - 1), from one fold.
Sums = Callable[[Column], Column]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column value under name, which no later filter or projection computes again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _sums(k: Column, first: Column, ratio: Callable[[Column], Column]) -> Column:
    """struct(at, below) of a sum of terms up to k, each the one before times ratio(its number); 0 below 0, at most 1."""
    start = F.struct(first.alias("t"), first.alias("s"))

    def step(a: Column, i: Column) -> Column:
        return bind(a["t"] * ratio(i), lambda t: F.struct(t.alias("t"), (a["s"] + t).alias("s")))

    terms = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    ends = lambda a: F.struct(F.least(F.lit(1.0), a["s"]).alias("at"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), a["s"] - a["t"])).alias("below"))
    none = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("below"))
    return F.when(k < 0, none).otherwise(F.aggregate(terms, start, step, ends))


def poisson_sums(k: Column, mu: Column) -> Column:
    return _sums(k, F.exp(-mu), lambda i: mu / i)


def _negbin_sums(k: Column, r: Column, p: Column) -> Column:
    """Of the terms C(i + r - 1, i) p^r (1 - p)^i."""
    return _sums(k, F.exp(r * F.log(p)), lambda i: (1 - p) * (r + i - 1) / i)


def negbin_dispersion_sums(k: Column, mu: Column, phi: Column) -> Column:
    """Variance phi * mu; Poisson up to phi = 1.001."""
    r = mu / F.when(phi > 1.001, phi - 1).otherwise(F.lit(1.0))
    return F.when(phi <= 1.001, poisson_sums(k, mu)).otherwise(_negbin_sums(k, r, r / (r + mu)))


def negbin_size_sums(k: Column, mu: Column, phi: Column) -> Column:
    """Variance mu + mu^2 / phi; Poisson where phi is null, not positive or above a million."""
    simple = phi.isNull() | (phi <= 0) | (phi > 1e6)
    size = F.when(simple, F.lit(1.0)).otherwise(phi)
    return F.when(simple, poisson_sums(k, mu)).otherwise(_negbin_sums(k, size, size / (size + mu)))


def poisson_cdf(k: Column, mu: Column) -> Column:
    """P(X <= k); 0 below 0, at most 1."""
    return poisson_sums(k, mu)["at"]


def negbin_dispersion_cdf(k: Column, mu: Column, phi: Column) -> Column:
    return negbin_dispersion_sums(k, mu, phi)["at"]


def negbin_size_cdf(k: Column, mu: Column, phi: Column) -> Column:
    return negbin_size_sums(k, mu, phi)["at"]


def ou_probs(cdf: Cdf, mu: Column, line: Column) -> Column:
    """struct(over, under, push) by any distribution; ou_from_sums is faster where one fold gives both values."""
    return ou_from_sums(lambda k: F.struct(cdf(k).alias("at"), cdf(k - 1).alias("below")), mu, line)


def ou_from_sums(sums: Sums, mu: Column, line: Column) -> Column:
    """struct(over, under, push): integer lines can push, others cannot; a mean of 0 is surely under."""
    whole = F.abs(line - F.round(line)) < 1e-9
    k = F.when(whole, F.round(line)).otherwise(F.floor(line)).cast("double")

    def raw(c: Column) -> Column:
        return F.struct(
            F.greatest(F.lit(0.0), 1 - c["at"]).alias("over"),
            F.when(whole, c["below"]).otherwise(c["at"]).alias("under"),
            F.when(whole, F.greatest(F.lit(0.0), c["at"] - c["below"])).otherwise(F.lit(0.0)).alias("push"),
        )

    def scaled(p: Column) -> Column:
        return bind(p["over"] + p["under"] + p["push"], lambda t: F.struct((p["over"] / t).alias("over"), (p["under"] / t).alias("under"), (p["push"] / t).alias("push")))

    none = F.struct(F.lit(0.0).alias("over"), F.lit(1.0).alias("under"), F.lit(0.0).alias("push"))
    return F.when(mu <= 0, none).otherwise(bind(sums(k), lambda c: bind(raw(c), scaled)))


def expected_value(p_win: Column, odd: Column, p_push: Column) -> Column:
    return p_win * odd + p_push - 1


def fair_odd(p_win: Column, p_push: Column) -> Column:
    return F.when(p_win > 1e-12, (1 - p_push) / p_win)


def conditional_win(p_win: Column, p_push: Column) -> Column:
    """Chance of winning if the bet is decided."""
    return F.when(p_push < 1 - 1e-12, p_win / (1 - p_push)).otherwise(F.lit(0.0))


def valid_odd(odd: Column) -> Column:
    return F.coalesce((odd > 1) & ~F.isnan(odd) & (odd < float("inf")), F.lit(False))


def devig(over: Column, under: Column) -> Column:
    """struct(p_over, p_under, margin), proportional; null if an odd is not above 1."""
    total = 1 / over + 1 / under
    return F.when((over > 1) & (under > 1), F.struct((1 / over / total).alias("p_over"), (1 / under / total).alias("p_under"), (total - 1).alias("margin")))


def american_to_decimal(price: Column) -> Column:
    return F.when(price >= 100, F.round(1 + price / 100.0, 2)).when(price <= -100, F.round(1 + 100.0 / F.abs(price), 2))


def p_over_decided(line: Column, mu: Column) -> Column:
    """Chance of over if there is no push, under a Poisson mean."""
    p = ou_from_sums(lambda k: poisson_sums(k, mu), mu, line)
    return bind(p, lambda x: F.when(x["over"] + x["under"] > 0, x["over"] / (x["over"] + x["under"])).otherwise(F.lit(0.0)))


def solve_mu(line: Column, p_over: Column, rounds: int = 40) -> Column:
    """The Poisson mean at which over has chance p_over, by bisection; null outside (0, 1) and below line 0.

    The bracket is wide from the start, so all rows take the same number of halvings.
    """
    start = F.struct(F.lit(0.0).alias("lo"), (line * 4 + 40).cast("double").alias("hi"))

    def step(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        return bind(mid, lambda m: bind(p_over_decided(line, m) < p_over, lambda low: F.struct(F.when(low, m).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(m).alias("hi"))))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda a: (a["lo"] + a["hi"]) / 2)
    return F.when((p_over > 0) & (p_over < 1) & (line >= 0), solved)


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(lo, hi) in percent; nulls for n = 0."""
    p, d = k / n, 1 + z * z / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(F.when(n > 0, 100 * (centre - half) / d).alias("lo"), F.when(n > 0, 100 * (centre + half) / d).alias("hi"))


def clv_percent(open_odd: Column, close_odd: Column) -> Column:
    return (open_odd / close_odd - 1) * 100


def settle(result: Column, line: Column, side: Column) -> Column:
    """true won, false lost, null push or unknown."""
    return F.when(F.abs(result - line) > 1e-9, F.when(side == "over", result > line).otherwise(result < line))
