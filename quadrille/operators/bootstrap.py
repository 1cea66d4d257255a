"""Bootstraps as one aggregation: replicate weights by hash, sums by partial aggregation.

How often a unit is drawn into a replicate is a Poisson draw with mean 1 that a hash of (unit, replicate)
decides. A task turns its units into arrays with one weight a replicate and adds them up a group; what
leaves it is a row a group and replicate, whatever the number of units. Sums are of whole numbers, so no
order of addition shows in them. Ratios, errors and intervals follow from the replicates' rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRIME = 2147483647
REPLICATES = 400
#: Units that a task weighs at a time, and bytes of sums it holds before it hands them on.
UNITS, HELD_BYTES = 2048, 64 << 20
#: A hash not below the k-th of these is drawn more than k times.
CUTS = [int(_PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(11)]


def weights(units: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each unit is drawn into each replicate."""
    h = ((units % _PRIME)[:, None] * 48271 + (np.arange(replicates) + seed * replicates)[None, :] * 69621 + 1) % _PRIME
    return np.searchsorted(CUTS, (h * h % _PRIME * 16807 + h) % _PRIME, "right")


def weight_sql(unit: str, replicate: str, replicates: int = REPLICATES, seed: int = 0) -> str:
    """The same weight as an expression over bigint columns, for checks."""
    h = f"(({unit} % {_PRIME} * 48271 + ({replicate} + {seed * replicates}) * 69621 + 1) % {_PRIME})"
    mixed = f"(({h} * {h} % {_PRIME} * 16807 + {h}) % {_PRIME})"
    return "(" + " + ".join(f"(case when {mixed} >= {cut} then 1 else 0 end)" for cut in CUTS) + ")"


def replicate_sums(rows: DataFrame, by: list[str], unit: str, measures: list[str], replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(by, replicate, w, measures): sums of weights and of weighted measures, for every group and replicate.

    ``unit`` (a bigint from 0 on) is what is drawn; its rows share their weight. ``measures`` are bigints; nulls
    count as 0. Rows without a unit are left out. Groups are few enough for a row a group and replicate.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "replicate int", "w bigint", *(f"`{c}` bigint" for c in measures)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, len(batch), UNITS):
                part = batch.slice(lo, UNITS)
                drawn = weights(part[unit].to_numpy(), replicates, seed)
                values = [np.ones(len(part), np.int64), *(part[c].fill_null(0).to_numpy(zero_copy_only=False) for c in measures)]
                keys = list(zip(*[part[c].to_pylist() for c in by], strict=True)) if by else [()] * len(part)
                number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
                code = np.array([number[k] for k in keys])
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                sums = np.stack([np.add.reduceat(drawn[order] * v[order, None], starts) for v in values])
                for k, i in number.items():
                    held[k] = held[k] + sums[:, i] if k in held else sums[:, i]
            if len(held) * replicates * 8 * (1 + len(measures)) >= HELD_BYTES:
                yield from hand_on(held)
        yield from hand_on(held)

    def hand_on(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for key, sums in held.items():
            groups = [pa.array([x] * replicates, types[c]) for c, x in zip(by, key, strict=True)]
            yield pa.RecordBatch.from_arrays([*groups, pa.array(np.arange(replicates), pa.int32()), *(pa.array(s, pa.int64()) for s in sums)], names=[*by, "replicate", "w", *measures])
        held.clear()

    from pyspark.sql.pandas.types import to_arrow_schema

    types = {f.name: f.type for f in to_arrow_schema(rows.select(*by).schema)} if by else {}
    asked = rows.filter(F.col(unit).isNotNull()).select(*dict.fromkeys([*by, unit, *measures]))
    return asked.mapInArrow(gather, schema).groupBy(*by, "replicate").agg(*[F.sum(c).alias(c) for c in ("w", *measures)])


def spread(replicates: DataFrame, by: list[str], value: Column, level: float = 0.95) -> DataFrame:
    """(by, se, lo, hi) of ``value`` over the replicates: their deviation and an interval by percentiles.

    A group holds one row a replicate, so that exact percentiles need no more than these.
    """
    tails = [(1 - level) / 2, (1 + level) / 2]
    both = replicates.groupBy(*by).agg(F.stddev_samp(value).alias("se"), F.percentile(value, F.array(*[F.lit(t) for t in tails])).alias("ends"))
    return both.select(*by, "se", F.col("ends")[0].alias("lo"), F.col("ends")[1].alias("hi"))


def multisets(values: DataFrame, by: list[str], value: str, most: int = 8) -> DataFrame:
    """(by, picks, mean, weight): all draws with replacement of as many values as a group has, without order.

    ``weight`` counts the orders that give a multiset. Groups of more than ``most`` values, whose
    multisets are too many, are an error. Values are numbered in their order, nulls left out.
    """
    from pyspark.sql import Window

    known = values.filter(F.col(value).isNotNull()).select(*by, value)
    n = F.count("*").over(Window.partitionBy(*by))
    numbered = known.withColumns({"at": F.row_number().over(Window.partitionBy(*by).orderBy(value)), "n": n}).withColumn("n", F.when(F.col("n") <= most, F.col("n")).otherwise(F.raise_error(F.lit(f"more than {most} values"))))
    now = numbered.select(*by, "n", F.array("at").alias("picks"), F.col(value).alias("total"), F.col("at").alias("last"))
    for size in range(2, most + 1):
        grown = now.filter((F.col("n") >= size) & (F.size("picks") == size - 1)).alias("a").join(numbered.select(*[F.col(c).alias(f"b_{c}") for c in by], "at", F.col(value).alias("v")), [F.col(f"a.{c}").eqNullSafe(F.col(f"b_{c}")) for c in by] + [F.col("at") >= F.col("last")])
        grown = grown.select(*[F.col(f"a.{c}") for c in by], "a.n", F.concat("picks", F.array("at")).alias("picks"), (F.col("total") + F.col("v")).alias("total"), F.col("at").alias("last"))
        now = now.filter(F.col("n") == F.size("picks")).unionByName(grown)
    factorial = lambda k: F.factorial(k)
    twice = lambda x: F.size(F.filter("picks", lambda y: y == x))
    same = F.aggregate(F.array_distinct("picks"), F.lit(1).cast("bigint"), lambda s, x: s * factorial(twice(x)))
    return now.select(*by, "picks", (F.col("total") / F.col("n")).alias("mean"), (factorial(F.col("n")) / same).cast("bigint").alias("weight"))


def sign_test(positive: Column, negative: Column, most: int = 60) -> Column:
    """The two-sided exact binomial test of as many signs of either kind; null without any.

    Sums of at most ``most`` binomial coefficients, which are exact numbers; more signs are an error.
    """
    n, k = positive + negative, F.greatest(positive, negative)
    choose = lambda j: F.aggregate(F.sequence(F.lit(1), F.greatest(j, F.lit(1))), F.lit(1.0), lambda s, i: F.when(i <= j, s * (n - i + 1) / i).otherwise(s))
    tail = F.aggregate(F.sequence(k.cast("int"), n.cast("int")), F.lit(0.0), lambda s, j: s + choose(j)) * F.pow(F.lit(0.5), n)
    return F.when(n > most, F.raise_error(F.lit(f"more than {most} signs")).cast("double")).when(n == 0, None).when(positive == negative, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))
