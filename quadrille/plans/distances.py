"""Distances on rasters and between the parts of a split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.fixtures import BUFFER_M, DRAWS_SQL, PIXEL_M, PIXELS_SQL, draws, pixels, places, raster_sizes
from quadrille.operators import buffer, distance, partition, ranks
from quadrille.operators.shared import materialise
from quadrille.plans.base import query
from quadrille.plans.blocks import _TRIM

_ROW, _COL = PIXEL_M
_D2 = f"(a.row - b.row) * (a.row - b.row) * {_ROW * _ROW} + (a.col - b.col) * (a.col - b.col) * {_COL * _COL}"


@query(f"with {PIXELS_SQL}, src as (select row, col from nodes where cents % 97 = 0) select a.node_id, (select cast(min({_D2}) as bigint) from src b) as d2 from nodes a")
def r05_distance_transform(spark, sf):
    """Squared distance of each pixel to the nearest marked one, however far."""
    every = materialise(pixels(spark, sf), "pixels")
    marked = every.filter("cents % 97 = 0").select("row", "col")
    found = distance.distance_transform(every.select("node_id", "row", "col"), marked, [], _ROW, _COL)
    return found.select("node_id", F.col("d2").cast("bigint").alias("d2"))


def raster_trim(spark, sf) -> DataFrame:
    """(seed, node_id, row, col, block_id, role, kept, to_train) of validation and test pixels of each draw.

    Validation is trimmed against training, test against training and what is left of validation; a pixel
    at the buffer's distance stays. ``to_train`` is the squared distance to training.
    """
    _, _, reach = raster_sizes(spark, sf)
    every = materialise(pixels(spark, sf), "pixels")
    roles = partition.roles(draws(every.select("block_id")))
    placed = every.select("node_id", "row", "col", "block_id").join(F.broadcast(roles), "block_id")
    open_ = materialise(distance.distance_transform(placed.filter("role <> 'train'"), placed.filter("role = 'train'").select("seed", "row", "col"), ["seed"], _ROW, _COL), "to-train").withColumnRenamed("d2", "to_train")
    far = F.coalesce(F.col("to_train") >= reach * reach, F.lit(True))
    val = open_.filter("role = 'val'").withColumn("kept", far)
    left = val.filter("kept").select("seed", "row", "col")
    test = distance.distance_transform(open_.filter("role = 'test'"), left, ["seed"], _ROW, _COL, float(reach))
    test = test.withColumn("kept", far & F.coalesce(F.col("d2") >= reach * reach, F.lit(True))).drop("d2")
    return val.unionByName(test)


_RASTER_TRIM = f"""{PIXELS_SQL},{DRAWS_SQL},
hb as (select any_value(buffer) as b, any_value(buffer) // {min(PIXEL_M)} + 1 as h from nodes),
p as (select seed, node_id, row, col, block_id, role, row // h as kr, col // h as kc, b * b as b2 from nodes join roles using (block_id), hb),
off as (select x - 1 as dr, y - 1 as dc from range(3) t(x), range(3) u(y)),
tr as (select seed, row, col, kr + dr as kr, kc + dc as kc from p, off where role = 'train'),
va as (select * from p a where role = 'val' and not exists (select 1 from tr b where b.seed = a.seed and b.kr = a.kr and b.kc = a.kc and {_D2} < a.b2)),
near_to as (select * from tr union all select seed, row, col, kr + dr, kc + dc from va, off),
te as (select * from p a where role = 'test' and not exists (select 1 from near_to b where b.seed = a.seed and b.kr = a.kr and b.kc = a.kc and {_D2} < a.b2)),
d as (select a.seed, a.node_id, cast(min({_D2}) as double) as d2 from te a join (select seed, row, col from p where role = 'train') b on b.seed = a.seed group by 1, 2)"""


@query(f"with {_RASTER_TRIM}, n as (select seed, count(*) filter (where role = 'val') as n_val, count(*) filter (where role = 'test') as n_test from p group by seed), v as (select seed, count(*) as n_val_kept, count(distinct block_id) as blocks_val from va group by seed), t as (select seed, count(*) as n_test_kept, count(distinct block_id) as blocks_test from te group by seed), m as (select seed, min(d2) as d2_min, max(d2) as d2_max, median(d2) as d2_median from d group by seed) select n.seed, n_val, n_test, coalesce(n_val_kept, 0) as n_val_kept, coalesce(n_test_kept, 0) as n_test_kept, coalesce(blocks_val, 0) as blocks_val, coalesce(blocks_test, 0) as blocks_test, d2_min, d2_max, d2_median from n left join v on v.seed = n.seed left join t on t.seed = n.seed left join m on m.seed = n.seed")
def j03_raster_trim(spark, sf):
    """Pixels and blocks before and after trimming by distance transforms, and the distances from test to training."""
    rows = materialise(raster_trim(spark, sf), "raster-trim")
    of = lambda role: F.col("role") == role
    kept = lambda role: of(role) & F.col("kept")
    counts = rows.groupBy("seed").agg(
        F.count_if(of("val")).alias("n_val"), F.count_if(of("test")).alias("n_test"), F.count_if(kept("val")).alias("n_val_kept"), F.count_if(kept("test")).alias("n_test_kept"),
        F.count_distinct(F.when(kept("val"), F.col("block_id"))).alias("blocks_val"), F.count_distinct(F.when(kept("test"), F.col("block_id"))).alias("blocks_test"),
        F.min(F.when(kept("test"), F.col("to_train"))).alias("d2_min"), F.max(F.when(kept("test"), F.col("to_train"))).alias("d2_max"),
    )
    return counts.join(ranks.quantiles(rows.filter(kept("test")), ["seed"], "to_train", {"d2_median": 0.5}), "seed", "left")


@query(f"with {_RASTER_TRIM} select seed, node_id, role from va union all select seed, node_id, role from te")
def j03_raster_trim_members(spark, sf):
    return raster_trim(spark, sf).filter("kept").select("seed", "node_id", "role")


PAIRS = [("train", "val"), ("train", "test"), ("val", "test")]


def role_distances(rows: DataFrame, roles: DataFrame, sets: DataFrame) -> DataFrame:
    """(seed, a, b, d2): the least squared distance between the members of two roles, in every draw."""
    member, judged = buffer.judged_classes(roles, sets)
    points = materialise(rows.join(member.hint("merge"), "node_id").select(F.col("class").alias("grp"), "x_m", "y_m"), "points")
    members = materialise(judged.filter("kept").select("seed", F.col("role").alias("kind"), F.col("class").alias("grp")), "members")
    return distance.closest_pairs(members, points, ["seed"], rows.sparkSession.createDataFrame(PAIRS, "a string, b string"))


@query(f"with {_TRIM}, m as (select p.seed, role, x_m, y_m from placed p join nodes n using (node_id) where role = 'train' union all select k.seed, k.role, x_m, y_m from kept k join nodes n using (node_id) where kept), w(a, b) as (values ('train', 'val'), ('train', 'test'), ('val', 'test')) select l.seed, w.a, w.b, min((l.x_m - r.x_m) * (l.x_m - r.x_m) + (l.y_m - r.y_m) * (l.y_m - r.y_m)) as d2, min((l.x_m - r.x_m) * (l.x_m - r.x_m) + (l.y_m - r.y_m) * (l.y_m - r.y_m)) >= {BUFFER_M * BUFFER_M} as holds from w join m l on l.role = w.a join m r on r.role = w.b and r.seed = l.seed group by 1, 2, 3")
def b10_role_distances(spark, sf):
    """The least distance of each pair of roles a draw, and whether it respects the buffer."""
    rows = materialise(places(spark, sf).select("node_id", "block_id", "x_m", "y_m"), "places")
    found = role_distances(rows, partition.roles(draws(rows.select("block_id"))), materialise(buffer.near_sets(rows, BUFFER_M), "near-sets"))
    return found.select("seed", "a", "b", "d2", (F.col("d2") >= BUFFER_M * BUFFER_M).alias("holds"))
