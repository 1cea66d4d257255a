"""One unknown a group from a mean that grows with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators.shared import discard, materialise


def recovered(rows: DataFrame, by: list[str], value: Callable[[Column], Column], target: str, low: float, high: float, passes: int = 9, cuts: int = 16) -> DataFrame:
    """(by, c): where the group's mean of ``value(c)``, which grows with c, meets the group's mean of ``target``.

    Every pass asks each group for the means at ``cuts`` - 1 points of its interval in one aggregation and keeps
    the part in which they cross, so that ``passes`` jobs divide the interval ``passes`` times by ``cuts``, for
    all groups at once. A target beyond an end gives this end. Groups are few enough for a row each
    to be broadcast; null values and targets are left out of the means.
    """
    now = materialise(rows.groupBy(*by).agg(F.avg(target).alias("wanted")).withColumns({"low": F.lit(low), "high": F.lit(high)}), "interval")
    at = lambda k: F.col("low") + (F.col("high") - F.col("low")) * (k / cuts)
    for _ in range(passes):
        means = rows.join(F.broadcast(now), by).groupBy(*by, "wanted", "low", "high").agg(*[F.avg(value(at(k))).alias(f"m{k}") for k in range(1, cuts)])
        # The first point whose mean reaches the target ends the interval.
        first = F.coalesce(*[F.when(F.col(f"m{k}") >= F.col("wanted"), k) for k in range(1, cuts)], F.lit(cuts))
        edge = lambda side: F.col("low") + (F.col("high") - F.col("low")) * (first - side) / cuts
        last, now = now, materialise(means.select(*by, "wanted", edge(1).alias("low"), edge(0).alias("high")), "interval")
        discard(last)
    return now.select(*by, ((F.col("low") + F.col("high")) / 2).alias("c"))
