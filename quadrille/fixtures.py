"""Bridge views: the driver's tables as gridded nodes, antennas and seeded draws.

Positions are whole metres, so that all engines compare distances exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import propagation as P
from quadrille.operators import neighbors
from quadrille.operators.shared import materialise

FREQUENCY = 900.0
BLOCK_M, BUFFER_M = 10_000, 2_000
#: A node is a sentinel if the squared distance to its antenna times the number of antennas is above this, so that
#: about as many nodes are covered whatever the number of antennas.
REACH = 360_000_000
POWER_DBM = 43.0
SEEDS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Width and height of the domain in metres.
DOMAIN = (60_000, 59_999)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers as antennas."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey as ant_id", "(s_suppkey * 15485863 + 7) % 60000 as ax", "(s_suppkey * 32452843 + 11) % 59999 as ay")


_cells: dict[tuple[str, str], tuple[DataFrame, int]] = {}


def antenna_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The antennas that can be nearest, by cell of the domain, and a cell's side: written once a session, as all nodes ask for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cells:
        cells = materialise(neighbors.nearest_cells(sites(spark, sf_dir).selectExpr("ant_id", "ax as rx", "ay as ry"), "ant_id", *DOMAIN), "antenna-cells")
        _cells[key] = cells, cells.select("side").first()[0]
    return _cells[key]


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as node_id",
        "(o_orderkey * 7919 + 13) % 60000 as x_m",
        "(o_orderkey * 104729 + 57) % 59999 as y_m",
        "cast(round(o_totalprice * 100) as bigint) % 2000 / 100.0D as fade",
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, x_m, y_m, fade, gx, gy, block_id: what needs no antenna."""
    gx, gy = F.floor(F.col("x_m") / BLOCK_M), F.floor(F.col("y_m") / BLOCK_M)
    return positions(spark, sf_dir).withColumns({"gx": gx, "gy": gy}).withColumn("block_id", F.col("gx") * 6 + F.col("gy"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, x_m, y_m, gx, gy, block_id, d2, dist_m, is_sentinel, path_loss, rssi.

    ``d2`` is the squared distance to the nearest of all antennas, of which a node looks at its cell's candidates.
    """
    cells, side = antenna_cells(spark, sf_dir)
    square = lambda a: (F.col("x_m") - a["rx"]) * (F.col("x_m") - a["rx"]) + (F.col("y_m") - a["ry"]) * (F.col("y_m") - a["ry"])
    met = places(spark, sf_dir).withColumns({"cx": F.expr(f"x_m div {side}"), "cy": F.expr(f"y_m div {side}")}).join(cells, ["cx", "cy"])
    placed = met.withColumn("d2", F.array_min(F.transform("near", square)))
    dist = F.sqrt(F.col("d2").cast("double"))
    loss = F.when(F.col("d2") * F.col("points") > REACH, P.UNSET_PATH_LOSS).otherwise(F.round(P.free_space(dist, F.lit(FREQUENCY)) + F.col("fade"), 6))
    return (
        placed.withColumns({"dist_m": dist, "path_loss": loss})
        .withColumns({"is_sentinel": F.col("path_loss") >= P.SENTINEL_PATH_LOSS, "rssi": F.when(F.col("path_loss") >= P.SENTINEL_PATH_LOSS, P.SENTINEL_RSSI).otherwise(F.round(POWER_DBM - F.col("path_loss"), 6))})
        .select("node_id", "x_m", "y_m", "gx", "gy", "block_id", "d2", "dist_m", "is_sentinel", "path_loss", "rssi")
    )


#: Height and width of a pixel of ``pixels``.
PIXEL_M = (30, 28)


def raster_sizes(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """(pixels a row, pixels a block's side, metres of the buffer): all follow from the number of orders."""
    width = math.isqrt(max(1, table(spark, sf_dir, "orders").count()))
    side = (width + 5) // 6
    return width, side, 6 * side


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, row, col, block_id, cents: orders as a raster in row-major order of their keys."""
    width, side, _ = raster_sizes(spark, sf_dir)
    placed = table(spark, sf_dir, "orders").selectExpr("o_orderkey as node_id", f"o_orderkey div {width} as row", f"o_orderkey % {width} as col", "cast(round(o_totalprice * 100) as bigint) as cents")
    return placed.selectExpr("node_id", "row", "col", f"(col div {side}) * 10 + row div {side} as block_id", "cents")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with terrain and spectral features that follow from their number."""
    ramp = lambda k, m, shift, scale: f"((node_id * {k}) % {m} - {shift}) / {scale}"
    return nodes(spark, sf_dir).selectExpr(
        "*",
        f"{ramp(37, 1000, 0, '10.0D')} as elevation", f"{ramp(13, 100, 0, '250.0D')} as slope",
        f"{ramp(31, 201, 100, '100.0D')} as ndvi", f"{ramp(17, 201, 100, '100.0D')} as ndwi",
        f"{ramp(7, 160, 0, '1.0D')} as tri_m", f"{ramp(11, 50, 0, '10.0D')} as roughness",
        f"{ramp(19, 100, 0, '100.0D')} as b02", f"{ramp(23, 100, 0, '100.0D')} as b03", f"{ramp(29, 100, 0, '100.0D')} as b04", f"{ramp(41, 100, 0, '100.0D')} as b08",
        f"round(rssi + {ramp(43, 2001, 1000, '100.0D')}, 6) as rssi_pred", f"round(path_loss + {ramp(47, 2001, 1000, '100.0D')}, 6) as pl_pred",
    )


def draws(blocks: DataFrame, seeds: int | DataFrame = SEEDS) -> DataFrame:
    """(seed, block_id, pos): a permutation of ``blocks`` a seed, by integer arithmetic alone.

    A row for each block and seed, both few by design.
    """
    spark = blocks.sparkSession
    number = spark.range(seeds).withColumnRenamed("id", "seed") if isinstance(seeds, int) else seeds
    p = 2147483647
    hashed = blocks.select(F.col("block_id").cast("bigint").alias("block_id")).distinct().join(F.broadcast(number)).selectExpr("seed", "block_id", f"(block_id * 48271 + seed * 69621 + 1) % {p} as h1").selectExpr("seed", "block_id", f"((h1 * h1) % {p} * 16807 + h1) % {p} as h2")
    return hashed.selectExpr("seed", "block_id", "row_number() over (partition by seed order by h2, block_id) as pos")


_SQL_RAMP = "cast((node_id * {}) % {} - {} as double) / {}"
SITES_SQL = "sites as (select s_suppkey as ant_id, (s_suppkey * 15485863 + 7) % 60000 as ax, (s_suppkey * 32452843 + 11) % 59999 as ay from supplier)"
#: The same views for the oracle: CTEs without the leading ``with``.
NODES_SQL = f"""
ant as (select s_suppkey as ant_id, (s_suppkey * 15485863 + 7) % 60000 as ax, (s_suppkey * 32452843 + 11) % 59999 as ay from supplier),
pos0 as (select o_orderkey as node_id, (o_orderkey * 7919 + 13) % 60000 as x_m, (o_orderkey * 104729 + 57) % 59999 as y_m, cast(cast(round(o_totalprice * 100) as bigint) % 2000 as double) / 100.0 as fade from orders),
near0 as (select node_id, x_m, y_m, any_value(fade) as fade, min((x_m - ax) * (x_m - ax) + (y_m - ay) * (y_m - ay)) as d2 from pos0, ant group by node_id, x_m, y_m),
pl0 as (select *, sqrt(cast(d2 as double)) as dist_m, case when d2 * (select count(*) from ant) > {REACH} then 300.0::double else round(20 * log10(greatest(sqrt(cast(d2 as double)) / 1000.0, 0.001)) + 20 * log10(900.0::double) + 32.44::double + fade, 6) end as path_loss from near0),
nodes as (select node_id, x_m, y_m, cast(floor(x_m / {BLOCK_M}.0) as bigint) as gx, cast(floor(y_m / {BLOCK_M}.0) as bigint) as gy, cast(floor(x_m / {BLOCK_M}.0) as bigint) * 6 + cast(floor(y_m / {BLOCK_M}.0) as bigint) as block_id, d2, dist_m, path_loss >= 299 as is_sentinel, path_loss, case when path_loss >= 299 then -110.0::double else round(43.0::double - path_loss, 6) end as rssi from pl0)"""
FEATURES_SQL = NODES_SQL + f""",
feats as (select *, {_SQL_RAMP.format(37, 1000, 0, 10)} as elevation, {_SQL_RAMP.format(13, 100, 0, 250)} as slope, {_SQL_RAMP.format(31, 201, 100, 100)} as ndvi, {_SQL_RAMP.format(17, 201, 100, 100)} as ndwi, {_SQL_RAMP.format(7, 160, 0, 1)} as tri_m, {_SQL_RAMP.format(11, 50, 0, 10)} as roughness, {_SQL_RAMP.format(19, 100, 0, 100)} as b02, {_SQL_RAMP.format(23, 100, 0, 100)} as b03, {_SQL_RAMP.format(29, 100, 0, 100)} as b04, {_SQL_RAMP.format(41, 100, 0, 100)} as b08, round(rssi + {_SQL_RAMP.format(43, 2001, 1000, 100)}, 6) as rssi_pred, round(path_loss + {_SQL_RAMP.format(47, 2001, 1000, 100)}, 6) as pl_pred from nodes)"""
PIXELS_SQL = """
size0 as (select cast(floor(sqrt(count(*))) as bigint) as width from orders), size1 as (select width, (width + 5) // 6 as side, 6 * ((width + 5) // 6) as buffer from size0),
raster0 as (select o_orderkey as node_id, o_orderkey // width as row, o_orderkey % width as col, side, buffer, cast(round(o_totalprice * 100) as bigint) as cents from orders, size1),
nodes as (select node_id, row, col, (col // side) * 10 + row // side as block_id, cents, buffer from raster0)"""
DRAWS_SQL = f"""
blocks as (select distinct block_id from nodes),
h1s as (select seed, block_id, (block_id * 48271 + seed * 69621 + 1) % 2147483647 as h1 from blocks, (select cast(unnest(range({SEEDS})) as bigint) as seed)),
draws as (select seed, block_id, row_number() over (partition by seed order by ((h1 * h1) % 2147483647 * 16807 + h1) % 2147483647, block_id) as pos from h1s),
cuts as (select count(*) as n, greatest(1, cast(round_even(0.70::double * count(*), 0) as bigint)) as tr0, greatest(1, cast(round_even(0.15::double * count(*), 0) as bigint)) as va0 from blocks),
cut2 as (select case when tr0 + va0 >= n then n - 2 else tr0 end as n_tr, case when tr0 + va0 >= n then 1 else va0 end as n_va from cuts),
roles as (select seed, block_id, case when pos <= n_tr then 'train' when pos <= n_tr + n_va then 'val' else 'test' end as role from draws, cut2)"""
