"""Formulas and rules of the block design: bounds, retention, contrasts, branches, guards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _falling(top: Column, bottom: Column, m: Column) -> Column:
    """The ratio of the falling factorials of two numbers, m factors each; 0 if ``top`` has fewer than m."""
    steps = F.sequence(F.lit(1), m.cast("int"))
    factors = F.aggregate(steps, F.lit(1.0), lambda s, i: s * (top - i + 1) / (bottom - i + 1))
    return F.when(m > top, 0.0).when(m == 0, 1.0).otherwise(factors)


def inclusion_bounds(m: Column, blocks: Column, test: Column, train: Column) -> tuple[Column, Column]:
    """Given a node's block is tested: the odds that m other blocks all are, and that none is in training."""
    return _falling(test - 1, blocks - 1, m), _falling(blocks - 1 - train, blocks - 1, m)


def retention(g: Column, b: Column, q: Column) -> Column:
    """Mean share of a g by g block that a buffer b leaves if each neighbour spares it with probability q."""
    inner = g - 2 * b
    area = inner * inner + 4 * b * inner * q + 4 * b * b * (1 - math.pi / 4) * q * q + math.pi * b * b * q * q * q
    return area / (g * g)


def _bit(state: Column, k: int) -> Column:
    return F.shiftright(state, k).bitwiseAND(1)


def state_area(state: Column, g: Column, b: Column) -> Column:
    """Area left when the neighbours of bits 0-3 (left, right, below, above) and 4-7 (corners) trim."""
    sides = (g - b * (_bit(state, 0) + _bit(state, 1))) * (g - b * (_bit(state, 2) + _bit(state, 3)))
    corners = [_bit(state, d) * (1 - _bit(state, x)) * (1 - _bit(state, y)) for d, x, y in ((4, 0, 2), (5, 1, 2), (6, 0, 3), (7, 1, 3))]
    return sides - math.pi * b * b / 4 * (corners[0] + corners[1] + corners[2] + corners[3])


def state_probability(state: Column, q: Column) -> Column:
    n = F.bit_count(state)
    return F.pow(1 - q, n) * F.pow(q, 8 - n)


def paired_contrast(runs: DataFrame, one: str, other: str, floor: float) -> DataFrame:
    """(cell, pairs, tolerance_of, tolerance, contrast, parity) of runs (cell, model, draw, err).

    The tolerance is the deviation over draws of ``other``, fixed before any contrast is looked at, or
    that of ``one`` if it is below ``floor``.
    """
    sd = lambda model: F.stddev_samp(F.when(F.col("model") == model, F.col("err")))
    spread = runs.groupBy("cell").agg(sd(other).alias("s"), sd(one).alias("t"))
    enough = F.col("s") >= floor
    fixed = spread.select("cell", F.when(enough, other).otherwise(one).alias("tolerance_of"), F.when(enough, F.col("s")).otherwise(F.col("t")).alias("tolerance"))
    err = lambda model: F.max(F.when(F.col("model") == model, F.col("err")))
    paired = runs.groupBy("cell", "draw").agg((err(one) - err(other)).alias("d")).filter("d is not null")
    contrast = paired.groupBy("cell").agg(F.count("*").alias("pairs"), F.avg("d").alias("contrast"))
    return contrast.join(fixed, "cell").withColumn("parity", F.abs("contrast") <= F.col("tolerance"))


def branch(cells: DataFrame) -> DataFrame:
    """(n, t, strong, weak, between_n, branch) of cells with the least (lo) and most (hi) ratio of their models."""
    n = F.count("*")
    counts = cells.agg(n.alias("n"), F.when(n == 4, 3).otherwise(n).alias("t"), F.count_if(F.col("lo") >= 3).alias("strong"), F.count_if(F.col("hi") < 2).alias("weak"), F.count_if((F.col("lo") < 3) & (F.col("hi") >= 2)).alias("between_n"))
    return counts.withColumn("branch", F.when(F.col("strong") >= F.col("t"), "reinforces").when(F.col("weak") >= F.col("t"), "delimits").otherwise("partial"))


def guarded_counts(parts: DataFrame, rows: DataFrame, key: str, into: str) -> DataFrame:
    """(key, into): rows a part; raises if any of ``parts`` has none."""
    counted = parts.join(rows.groupBy(key).agg(F.count("*").alias(into)), key, "left")
    return counted.withColumn(into, F.when(F.col(into) > 0, F.col(into)).otherwise(F.raise_error(F.concat(F.lit("no rows in part "), F.col(key).cast("string")))))


def complete_runs(runs: DataFrame, logs: DataFrame, data: DataFrame) -> DataFrame:
    """(run, complete): a log, data, and data whose digest is the one declared."""
    both = runs.join(logs.distinct().withColumn("log", F.lit(True)), "run", "left").join(data, "run", "left")
    return both.select("run", (F.coalesce("log", F.lit(False)) & F.coalesce(F.col("sha256") == F.col("declared"), F.lit(False))).alias("complete"))


def extreme_ratio(rows: DataFrame, most: bool, rounds: int = 200) -> float | None:
    """The greatest or least sum(p e) / sum(p) over rows (e, lo, hi) with p between lo and hi.

    Dinkelbach's iterations, one aggregation each: rows beyond the current ratio take hi, the others lo.
    """
    now = rows.agg(F.try_divide(F.sum(F.col("lo") * F.col("e")), F.sum("lo"))).first()[0]
    for _ in range(rounds if now is not None else 0):
        beyond = F.col("e") > now if most else F.col("e") < now
        p = F.when(beyond, F.col("hi")).otherwise(F.col("lo"))
        new = rows.agg(F.sum(p * F.col("e")) / F.sum(p)).first()[0]
        if abs(new - now) <= 1e-13 * max(1.0, abs(now)):
            return new
        now = new
    return now


def thousands(x: Column) -> Column:
    """Whole numbers with a blank between each three digits."""
    return F.replace(F.format_number(x, 0), F.lit(","), F.lit(" "))


def power_of_ten(x: Column) -> Column:
    return F.concat(F.lit("10^"), F.floor(F.log10(x)).cast("string"))
