"""Statistics with the guards and divisors that the estimators ask for, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is 0 or null."""
    return F.try_divide(a, b)


def pearson(x: Column, y: Column, least: int = 3) -> Column:
    """Aggregate; null below ``least`` pairs or without variance. Never divides by 0."""
    both = x.isNotNull() & y.isNotNull()
    vx, vy = F.var_pop(F.when(both, x)), F.var_pop(F.when(both, y))
    return F.when((F.count(F.when(both, 1)) >= least) & (vx > 0) & (vy > 0), F.try_divide(F.covar_pop(x, y), F.sqrt(vx) * F.sqrt(vy)))


def pearson_mixed_divisors(x: Column, y: Column) -> Column:
    """Aggregate: mean product over sample deviations, r * (n - 1) / n; 0 for few pairs or flat columns."""
    sx, sy = F.stddev_samp(x), F.stddev_samp(y)
    r = F.try_divide(F.covar_pop(x, y), sx * sy)
    return F.when((F.count("*") < 5) | (sx < 1e-8) | (sy < 1e-8), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def z_score(x: Column, mean: Column, deviation: Column) -> Column:
    """Deviations below 1e-6 count as 1."""
    return (x - mean) / F.when(deviation < 1e-6, 1.0).otherwise(deviation)


def reliability_sd(sum_w: Column, sum_w2: Column, spread: Column) -> Column:
    """Weighted deviation from the sums of weights, their squares, and w * (x - mean) ** 2."""
    divisor = sum_w - F.try_divide(sum_w2, sum_w)
    return F.when((sum_w > 0) & (divisor > 0), F.sqrt(F.try_divide(spread, divisor)))


def huber(e: Column, delta: float = 5.0) -> Column:
    return F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta))


def half_even_share(n: Column, share: float) -> Column:
    """A share of n, at least 1, rounded half to even."""
    return F.greatest(F.lit(1), F.bround(n * share).cast("int"))


def exact_mean(x: Column) -> Column:
    """Aggregate: the mean of values of six decimals, rounded half up to six; null without any.

    Sums of whole millionths don't depend on the order of rows, so any engine gets the same digits.
    """
    return exact_mean_of(F.sum(F.round(x * 1_000_000).cast("bigint")), F.count(x))


def exact_mean_of(total: Column, n: Column) -> Column:
    """The same from a sum of whole millionths and the number of values."""
    twice = 2 * total + n
    return F.when(n > 0, (twice - F.pmod(twice, F.greatest(2 * n, F.lit(1)))) / F.greatest(2 * n, F.lit(1)) / 1_000_000)


def exact_mean_sql(x: str, where: str = "true") -> str:
    """The same in SQL."""
    n = f"count({x}) filter (where {where})"
    twice = f"(2 * sum(cast(round({x} * 1000000) as bigint)) filter (where {where}) + {n})"
    d = f"greatest(2 * {n}, 1)"
    return f"case when {n} > 0 then cast({twice} - ({twice} % {d} + {d}) % {d} as double) / {d} / 1000000 end"
