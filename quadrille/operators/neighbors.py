"""Distance joins by hash buckets: within a radius, nearest, and k nearest.

The plane is cut into square buckets as wide as the radius. One side is repeated into the buckets
around its own, the other is not, and the join is on equal buckets: a merge join whose partitions hold
places, not a product of both sides. The hint is there because Spark takes the repeated rows for one
and would broadcast tables of any size. Distances are compared squared.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geo import cell_of
from quadrille.operators.shared import materialise


def bucketed(points: DataFrame, x: str, y: str, side: float, around: int = 0) -> DataFrame:
    """Add bx and by; with ``around``, one row for each bucket of that ring and within."""
    own = points.withColumns({"bx": cell_of(F.col(x), float(side)), "by": cell_of(F.col(y), float(side))})
    if not around:
        return own
    ring = F.array(*[F.lit(k) for k in range(-around, around + 1)])
    return own.withColumn("bx", F.explode(F.transform(ring, lambda k: F.col("bx") + k))).withColumn("by", F.explode(F.transform(ring, lambda k: F.col("by") + k)))


def within(left: DataFrame, right: DataFrame, radius: float, strict: bool = True) -> DataFrame:
    """Pairs (all columns of both sides, d2) nearer than ``radius``. Columns: lx, ly and rx, ry are the positions."""
    a = bucketed(left, "lx", "ly", radius)
    b = bucketed(right, "rx", "ry", radius, around=1)
    d2 = (F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")) + (F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry"))
    joined = a.join(b.hint("merge"), ["bx", "by"]).withColumn("d2", d2).drop("bx", "by")
    return joined.filter(F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius)


def without_near(left: DataFrame, right: DataFrame, radius: float, equal: Column | None = None) -> DataFrame:
    """Rows of ``left`` that have no row of ``right`` at a distance below ``radius``: a hashed anti-join."""
    a = bucketed(left, "lx", "ly", radius).alias("a")
    b = bucketed(right, "rx", "ry", radius, around=1).alias("b")
    d2 = (F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")) + (F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry"))
    on = (F.col("a.bx") == F.col("b.bx")) & (F.col("a.by") == F.col("b.by")) & (d2 < radius * radius)
    if equal is not None:
        on &= equal
    return a.join(b, on, "left_anti").drop("bx", "by")


def top_k(pairs: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows a group; Spark keeps only k a group on the map side. ``rank`` counts from 1."""
    from pyspark.sql import Window

    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def nearest_cells(right: DataFrame, other: str, width: int, height: int) -> DataFrame:
    """(cx, cy, side, near): the plane from 0 in as many cells as there are points, each with all that can be nearest to a place in it.

    ``right`` (``other``, rx, ry) has about as many candidates a cell as a place has neighbours, however many
    points there are: those no further from the cell's middle than its nearest one and the cell's diagonal.
    """
    n = max(1, right.count())
    side = max(1, math.ceil(math.sqrt(width * height / n)))
    across, up = -(-width // side), -(-height // side)
    middles = right.sparkSession.range(across * up).selectExpr("id as cell", f"(id div {up}) * {side} + {side // 2} as lx", f"(id % {up}) * {side} + {side // 2} as ly")
    first = materialise(k_nearest(middles, right, "cell", other, 1).select("cell", F.sqrt(F.col("d2").cast("double")).alias("d")), "nearest-of-cells")
    reach = first.agg(F.max("d")).first()[0]
    diagonal = side * math.sqrt(2) + 2
    met = within(middles.join(first, "cell"), right, (reach or 0.0) + diagonal, strict=False).filter(F.sqrt(F.col("d2").cast("double")) <= F.col("d") + diagonal)
    near = met.groupBy("cell").agg(F.collect_list(F.struct("rx", "ry")).alias("near"))
    return near.selectExpr(f"cell div {up} as cx", f"cell % {up} as cy", f"cast({side} as bigint) as side", f"cast({n} as bigint) as points", "near")


def strongest(left: DataFrame, right: DataFrame, key: str, other: str, radius: float, k: int, power: Callable[[Column, Column], Column], least: float | None = None) -> DataFrame:
    """The k rows of ``right`` of most ``power`` within ``radius`` of each row of ``left``: (key, other, power, rank).

    ``power`` (of a row's ``base`` and the distance) falls with distance and rises with ``base``, so that
    nothing beyond a ring has more than the largest base has at its edge. Rings grow until a row's k-th
    power is above that, or until the radius; rows that are done are written and look no further.
    Ties go to the smaller ``other``. Powers of ``least`` or below don't count.
    """
    ends = right.agg(F.count("*"), F.min("rx"), F.max("rx"), F.min("ry"), F.max("ry"), F.max("base")).first()
    count, top = ends[0] or 0, float(ends[5] or 0)
    dense = math.sqrt(3 * k * max((ends[2] or 0) - (ends[1] or 0), 1) * max((ends[4] or 0) - (ends[3] or 0), 1) / (math.pi * max(count, 1)))
    reach, rest, done = min(float(dense), float(radius)), left, []
    while True:
        pairs = within(rest, right, reach, strict=False).withColumn("power", power(F.col("base"), F.sqrt(F.col("d2").cast("double"))))
        if least is not None:
            pairs = pairs.filter(F.col("power") > least)
        best = materialise(top_k(pairs.select(key, other, "power"), [key], [F.desc("power"), F.col(other)], k), "strongest")
        if reach >= radius:
            done.append(best)
            break
        to_come = power(F.lit(top), F.lit(reach))
        full = best.groupBy(key).agg(F.count("*").alias("n"), F.min("power").alias("last")).filter((F.col("n") == k) & (F.col("last") > to_come)).select(key)
        done.append(best.join(full, key, "left_semi"))
        rest = materialise(rest.join(full, key, "left_anti"), "rest")
        if rest.isEmpty():
            break
        reach = min(2 * reach, float(radius))
    return reduce(DataFrame.unionByName, done)


def k_nearest(left: DataFrame, right: DataFrame, key: str, other: str, k: int, side: float | None = None, limit: float | None = None) -> DataFrame:
    """The k nearest rows of ``right`` for each row of ``left``, up to the distance ``limit`` if there is one; all if there are fewer.

    Rings of growing radius: rows that found k within a radius are done, the rest look twice as far,
    until the radius covers all points. The first radius is ``side``, or what holds about 2 k points at
    the mean density. What is left and what is done are written after each ring. Ties go to the
    smaller ``other``.
    """
    ends = right.agg(F.count("*"), F.min("rx"), F.max("rx"), F.min("ry"), F.max("ry")).first()
    own = left.agg(F.min("lx"), F.max("lx"), F.min("ly"), F.max("ly")).first()
    if not ends[0] or own[0] is None:
        return top_k(within(left, right, 1.0, strict=False), [key], [F.col("d2"), F.col(other)], k)
    width, height = max(ends[2], own[1]) - min(ends[1], own[0]), max(ends[4], own[3]) - min(ends[3], own[2])
    most = math.hypot(width, height) + 1 if limit is None else float(limit)
    dense = math.sqrt(2 * k * max(ends[2] - ends[1], 1) * max(ends[4] - ends[3], 1) / (math.pi * ends[0]))
    radius, rest, done = min(float(side or dense), most), left, []
    while True:
        pairs = within(rest, right, radius, strict=False)
        best = materialise(top_k(pairs, [key], [F.col("d2"), F.col(other)], k), "nearest")
        if radius >= most:
            done.append(best)
            break
        full = best.groupBy(key).count().filter(F.col("count") == k).select(key)
        done.append(best.join(full, key, "left_semi"))
        rest = materialise(rest.join(full, key, "left_anti"), "rest")
        if rest.isEmpty():
            break
        radius = min(2 * radius, most)
    return reduce(DataFrame.unionByName, done)
