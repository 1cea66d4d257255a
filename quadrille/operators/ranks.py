"""Ranks and exact quantiles within groups, whatever part of the rows one group holds.

Rows are cut into ranges of (group, value), ranked within each range, and the ranges' starts are added
up over a table of one row a group and range. No task holds a group, nor a map of its values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators.shared import materialise


def ranked(rows: DataFrame, group: list[str], order: list[str], into: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in the order of each group; ``order`` should leave no ties open."""
    cut = materialise(rows.repartitionByRange(*group, *order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = cut.groupBy(*group, "range").agg(F.count("*").alias("n"))
    starts = counts.select(*group, "range", (F.sum("n").over(Window.partitionBy(*group).orderBy("range")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy(*group, "range").orderBy(*order))
    return cut.withColumn(into, at.cast("bigint")).join(F.broadcast(starts), [*group, "range"]).withColumn(into, F.col(into) + F.col("before")).drop("range", "before")


def quantiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column a share): interpolated quantiles of the values that aren't null."""
    known = rows.filter(F.col(value).isNotNull()).select(*group, value)
    counts = known.groupBy(*group).agg(F.count("*").alias("n"))
    placed = ranked(known, group, [value]).join(F.broadcast(counts), group)
    picks: list[Column] = []
    for name, share in shares.items():
        at = share * (F.col("n") - 1) + 1
        low, part = F.floor(at), at - F.floor(at)
        picks.append((F.sum(F.when(F.col("rank") == low, F.col(value) * (1 - part))) + F.coalesce(F.sum(F.when((F.col("rank") == low + 1) & (part > 0), F.col(value) * part)), F.lit(0.0))).alias(name))
    return placed.groupBy(*group).agg(*picks)


def segment_quantiles(rows: DataFrame, values: dict[str, tuple[Column, dict[str, Column]]], shares: dict[str, float]) -> DataFrame:
    """(kind, segment, n, a column a share): interpolated quantiles of several values over overlapping segments.

    ``values`` names each value and the conditions of its segments. All are cut into ranges once. Counts a
    range and segment say which ranges hold the wanted ranks; only these are sorted, and of them only those
    with more than one value. A row in many segments is one row until then. Null values count nowhere;
    segments without values are absent.
    """
    each = [F.struct(F.lit(kind).alias("kind"), x.cast("double").alias("x"), F.filter(F.array(*[F.when(where, F.lit(name)) for name, where in segments.items()]), lambda s: s.isNotNull()).alias("segments")) for kind, (x, segments) in values.items()]
    long = rows.select(F.explode(F.array(*each)).alias("v")).select("v.*").filter("x is not null and size(segments) > 0")
    cut = materialise(long.repartitionByRange("kind", "x").withColumn("range", F.spark_partition_id()), "value-ranges")
    key = ["kind", "segment"]
    opened = cut.select("kind", "range", "x", F.explode("segments").alias("segment"))
    counts = opened.groupBy(*key, "range").agg(F.count("*").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    own = Window.partitionBy(*key)
    placed = counts.withColumns({"before": F.sum("m").over(own.orderBy("range")) - F.col("m"), "n": F.sum("m").over(own)})
    ends = []
    for name, share in shares.items():
        at = share * (F.col("n") - 1) + 1
        low, part = F.floor(at), at - F.floor(at)
        ends += [F.struct(F.lit(name).alias("share"), low.alias("rank"), (1 - part).alias("weight")), F.struct(F.lit(name).alias("share"), (low + 1).alias("rank"), part.alias("weight"))]
    wanted = placed.withColumn("w", F.explode(F.array(*ends))).filter("w.weight > 0 and w.rank > before and w.rank <= before + m")
    picks = materialise(wanted.select(*key, "n", "range", "lo", "hi", F.col("w.share").alias("share"), (F.col("w.rank") - F.col("before")).alias("at"), F.col("w.weight").alias("weight")), "wanted-ranks")
    # Ranges with a single value need no order: it is the value of any rank within.
    flat = picks.filter("lo = hi").select(*key, "n", "share", "weight", F.col("lo").alias("x"))
    asked = picks.filter("lo < hi")
    sorted_ = opened.join(F.broadcast(asked.select(*key, "range").distinct()), [*key, "range"]).withColumn("at", F.row_number().over(Window.partitionBy(*key, "range").orderBy("x")))
    found = sorted_.join(F.broadcast(asked), [*key, "range", "at"]).select(*key, "n", "share", "weight", "x")
    sums = [F.sum(F.when(F.col("share") == name, F.col("weight") * F.col("x"))).alias(name) for name in shares]
    return flat.unionByName(found).groupBy(*key, "n").agg(*sums)


def median(n: Column) -> Column:
    """The ranks, and their weights, of the interpolated median of n values, as ``drawn_values`` wants them."""
    at = (n - 1) * 0.5 + 1
    low, part = F.floor(at), at - F.floor(at)
    one = lambda rank, weight: F.struct(F.lit("m").alias("name"), rank.alias("rank"), weight.alias("weight"))
    return F.array(one(low, 1 - part), one(low + 1, part))


def drawn_values(rows: DataFrame, members: DataFrame, by: list[str], value: str, wanted: Callable[[Column], Column] = median, sizes: DataFrame | None = None, bins: int = 4096) -> DataFrame:
    """(seed, by, n, name, x): values by rank over the units that each draw takes, whatever the number of draws.

    ``rows`` (block_id, by, value) are counted once by block and bin of their value, and draws (``members``: seed,
    block_id) add up these counts. ``wanted`` makes structs (name, rank, weight) of n, the number of a draw's values,
    and of the columns of ``sizes`` (seed, by, others); x is the weighted sum. Only rows of the bins that hold a
    wanted rank meet the draws, unless the bin has but one value.
    """
    known = rows.filter(F.col(value).isNotNull()).select("block_id", *by, F.col(value).alias("x"))
    ends = materialise(known.groupBy(*by).agg(F.min("x").alias("least"), F.max("x").alias("most")), "ends")
    share = F.floor((F.col("x") - F.col("least")) / (F.col("most") - F.col("least")) * bins)
    cut = known.join(F.broadcast(ends), by).select("block_id", *by, "x", F.when(F.col("most") > F.col("least"), F.least(share, F.lit(bins - 1))).otherwise(0).alias("bin"))
    counts = materialise(cut.groupBy("block_id", *by, "bin").agg(F.count("*").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi")), "bins")
    drawn = counts.join(F.broadcast(members.select("seed", "block_id")), "block_id").groupBy("seed", *by, "bin").agg(F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own = Window.partitionBy("seed", *by)
    placed = drawn.withColumns({"before": F.sum("m").over(own.orderBy("bin")) - F.col("m"), "n": F.sum("m").over(own)})
    if sizes is not None:
        placed = placed.join(F.broadcast(sizes), ["seed", *by])
    asked = placed.withColumn("w", F.explode(wanted(F.col("n")))).filter("w.weight > 0 and w.rank > before and w.rank <= before + m")
    key = ["seed", *by, "bin"]
    picks = materialise(asked.select(*key, "n", "lo", "hi", "w.name", (F.col("w.rank") - F.col("before")).cast("bigint").alias("at"), "w.weight"), "wanted-ranks")
    # A bin with one value needs no order.
    flat = picks.filter("lo = hi").select("seed", *by, "n", "name", "weight", F.col("lo").alias("x"))
    open_ = picks.filter("lo < hi")
    near = materialise(cut.join(F.broadcast(open_.select(*by, "bin").distinct()), [*by, "bin"]), "near-wanted")
    opened = near.join(F.broadcast(members.select("seed", "block_id")), "block_id").join(F.broadcast(open_.select(*key).distinct()), key)
    found = ranked(opened.select(*key, "x"), key, ["x"], "at").join(F.broadcast(open_.select(*key, "n", "name", "weight", "at")), [*key, "at"]).select("seed", *by, "n", "name", "weight", "x")
    return flat.unionByName(found).groupBy("seed", *by, "n", "name").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))


def smallest(rows: DataFrame, group: list[str], value: str, tie: str, n: str, span: int, bins: int = 1 << 14) -> DataFrame:
    """The n rows of each group of least ``value``, a whole number from 0 and below ``span``; ties to the smaller ``tie``.

    ``n`` is a column, the same in all rows of a group. Bins are counted first; only the bin in which a group's n-th row lies is sorted.
    """
    cut = rows.withColumn("bin", F.floor(F.col(value) / (span / bins)))
    counts = cut.groupBy(*group, "bin").agg(F.count("*").alias("m"), F.first(n).alias("most"))
    placed = counts.withColumn("before", F.sum("m").over(Window.partitionBy(*group).orderBy("bin")) - F.col("m"))
    last = placed.filter("before < most").groupBy(*group).agg(F.max(F.struct("bin", F.col("before").alias("under"))).alias("last"))
    met = cut.join(F.broadcast(materialise(last.select(*group, "last.*").withColumnRenamed("bin", "last"), "last-bins")), group).filter("bin <= last")
    under = met.filter("bin < last")
    order = Window.partitionBy(*group).orderBy(value, tie)
    within = met.filter("bin = last").withColumn("at", F.row_number().over(order)).filter(F.col("at") + F.col("under") <= F.col(n))
    return under.select(*rows.columns).unionByName(within.select(*rows.columns))
