"""Distance joins, top-K, parents, edges, pairings and sets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.fixtures import FREQUENCY, NODES_SQL, PIXELS_SQL, SITES_SQL, nodes, pixels, places, raster_sizes, sites, table
from quadrille.functions import propagation as P
from quadrille.functions import stats
from quadrille.operators import graph, neighbors, reach
from quadrille.operators.shared import materialise
from quadrille.plans.base import query

RADIUS_M, BEST = 15_000, 5
_R2 = RADIUS_M * RADIUS_M
_D2 = "(n.x_m - a.ax) * (n.x_m - a.ax) + (n.y_m - a.ay) * (n.y_m - a.ay)"


def _left(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.col("x_m").alias("lx"), F.col("y_m").alias("ly"))


def _right(rows: DataFrame) -> DataFrame:
    return rows.select("ant_id", F.col("ax").alias("rx"), F.col("ay").alias("ry"))


@query(f"with {NODES_SQL}, {SITES_SQL} select n.node_id, round(sqrt(cast(min({_D2}) as double)), 6) as d_min from nodes n, sites a group by 1")
def j04_distance_to_set(spark, sf):
    """Distance to the nearest of a set of points, by rings of growing radius."""
    found = neighbors.k_nearest(_left(nodes(spark, sf), "node_id"), _right(sites(spark, sf)), "node_id", "ant_id", 1)
    return found.select("node_id", F.round(F.sqrt(F.col("d2").cast("double")), 6).alias("d_min"))


@query(f"with {NODES_SQL}, {SITES_SQL} select n.node_id, arg_min(a.ant_id, struct_pack(d := {_D2}, a := a.ant_id)) as ant_id, min({_D2}) as d2 from nodes n, sites a group by 1")
def j05_nearest_antenna(spark, sf):
    found = neighbors.k_nearest(_left(nodes(spark, sf), "node_id"), _right(sites(spark, sf)), "node_id", "ant_id", 1)
    return found.select("node_id", "ant_id", "d2")


#: Power of the strongest antennas; each antenna has up to nine less. Within RADIUS_M none gets down to -150.
POWER = 43


def free_space_millionths(d2: np.ndarray) -> np.ndarray:
    """Free-space loss at squared distances, in whole millionths of a decibel; works in place."""
    np.sqrt(d2, out=d2)
    d2 /= 1000.0
    np.maximum(d2, 0.001, out=d2)
    np.log(d2, out=d2)
    d2 *= 20_000_000 / math.log(10)
    d2 += (20 * math.log10(FREQUENCY) + 32.44) * 1_000_000
    return np.rint(d2, out=d2)


def strong_within(level: float, power: float) -> int:
    """The greatest squared distance within RADIUS_M at which an antenna of ``power`` is received at ``level`` or above; -1 for none."""
    low, high = -1, _R2
    while low < high:
        d2 = (low + high + 1) // 2
        loss = 20 * math.log10(max(math.sqrt(d2) / 1000.0, 0.001)) + 20 * math.log10(FREQUENCY) + 32.44
        low, high = (d2, high) if round(power - loss, 6) >= level else (low, d2 - 1)
    return low


def _strongest(spark, sf, k: int) -> DataFrame:
    power = lambda base, distance: F.round(base - P.free_space(distance, F.lit(FREQUENCY)), 6)
    right = _right(sites(spark, sf)).withColumn("base", (43.0 - F.col("ant_id") % 10).cast("double"))
    return neighbors.strongest(_left(nodes(spark, sf), "node_id"), right, "node_id", "ant_id", RADIUS_M, k, power, -150.0)


_REACH = f"{SITES_SQL}, reach as (select n.node_id, a.ant_id, {_D2} as d2, round(43.0::double - a.ant_id % 10 - (20 * log10(greatest(sqrt(cast({_D2} as double)) / 1000.0, 0.001)) + 20 * log10(900.0::double) + 32.44::double), 6) as rssi from nodes n, sites a where {_D2} <= {_R2})"


@query(f"with {NODES_SQL}, {_REACH} select node_id, ant_id, rssi, cast(row_number() over (partition by node_id order by rssi desc, ant_id) as integer) as rank from reach where rssi > -150 qualify row_number() over (partition by node_id order by rssi desc, ant_id) <= {BEST}")
def j06_range_join_top_k(spark, sf):
    """Antennas within a radius, the best five by received power a node; ties to the smaller id."""
    return _strongest(spark, sf, BEST).select("node_id", "ant_id", F.col("power").alias("rssi"), F.col("rank").cast("int").alias("rank"))


@query(f"with {NODES_SQL}, {_REACH} select node_id, arg_max(ant_id, struct_pack(r := rssi, a := -ant_id)) as ant_id, max(rssi) as rssi from reach where rssi > -150 group by node_id")
def j07_argmax_join(spark, sf):
    return _strongest(spark, sf, 1).select("node_id", "ant_id", F.col("power").alias("rssi"))


_POINTS = "pts as (select p_partkey as pt, (p_partkey * 48271 + 11) % 60000 as px, (p_partkey * 69621 + 7) % 59999 as py from part)"


def _points(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey as pt", "(p_partkey * 48271 + 11) % 60000 as px", "(p_partkey * 69621 + 7) % 59999 as py")


def _eight_nearest(points: DataFrame, placed: DataFrame) -> DataFrame:
    left = points.select("pt", F.col("px").alias("lx"), F.col("py").alias("ly"))
    right = placed.select("node_id", F.col("x_m").alias("rx"), F.col("y_m").alias("ry"))
    found = neighbors.k_nearest(left, right, "pt", "node_id", 8)
    return found.select("pt", "node_id", "d2", F.round(1 / (F.col("d2") + 1e-6), 12).alias("weight"), F.col("rank").cast("int").alias("rank"))


@query(f"with {NODES_SQL}, {_POINTS}, d as (select pt, node_id, (px - x_m) * (px - x_m) + (py - y_m) * (py - y_m) as d2 from pts, nodes) select pt, node_id, d2, round(1 / (d2 + 1e-6), 12) as weight, cast(row_number() over (partition by pt order by d2, node_id) as integer) as rank from d qualify row_number() over (partition by pt order by d2, node_id) <= 8")
def j08_k_nearest_weights(spark, sf):
    """Eight nearest nodes of every measured point, with inverse square weights."""
    return _eight_nearest(_points(spark, sf), nodes(spark, sf))


@query()
def j08_k_nearest_weights_of_all_points(spark, sf):
    return _eight_nearest(_points(spark, sf), nodes(spark, sf))


@query(f"with {_POINTS}, q as (select pt, px, py, case pt % 3 when 0 then 2400 when 1 then 1800 else 1200 end as r from pts), d as (select a.pt as src, b.pt as dst, (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) as d2, least(a.r, b.r) as r from q a, q b where a.pt <> b.pt and abs(a.px - b.px) <= 2400 and abs(a.py - b.py) <= 2400), k as (select * from d where d2 <= 2400 * 2400 qualify row_number() over (partition by src order by d2, dst) <= 32), e as (select src, dst from k where d2 <= r * r) select src, dst from e union select dst, src from e")
def j09_adaptive_radius_edges(spark, sf):
    """Among the 32 nearest, neighbours within both ends' radii, made symmetric.

    A point finds itself, too, so 33 are sought; rings grow no further than these need.
    """
    rows = _points(spark, sf).withColumn("r", F.when(F.col("pt") % 3 == 0, 2400).when(F.col("pt") % 3 == 1, 1800).otherwise(1200))
    left = rows.select(F.col("pt").alias("src"), F.col("px").alias("lx"), F.col("py").alias("ly"), F.col("r").alias("r1"))
    right = rows.select(F.col("pt").alias("dst"), F.col("px").alias("rx"), F.col("py").alias("ry"), F.col("r").alias("r2"))
    found = neighbors.k_nearest(left, right, "src", "dst", 33, limit=2400).filter("src <> dst").drop("rank")
    near = neighbors.top_k(found, ["src"], [F.col("d2"), F.col("dst")], 32)
    r = F.least("r1", "r2")
    edges = materialise(near.filter(F.col("d2") <= r * r).select("src", "dst"), "edges")
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


@query("select l_orderkey, l_linenumber, o_custkey, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey")
def j11_parent_join(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "o_orderpriority")


_LATTICE = f"{PIXELS_SQL}, px as (select node_id as i, row as r, col as c, width from nodes cross join size1), lat as (select p.i as src, q.i as dst, round(sqrt(cast(abs(q.r - p.r) + abs(q.c - p.c) as double)) * 30.0, 6) as dist from px p cross join range(3) u(a) cross join range(3) v(b) join px q on q.r = p.r + a - 1 and q.c = p.c + b - 1)"


def _lattice(spark, sf) -> DataFrame:
    """Edges among the pixels there are: the raster may have gaps and an open last row."""
    width, _, _ = raster_sizes(spark, sf)
    every = pixels(spark, sf)
    edges = graph.lattice_edges(every.select("row", "col"), None, width, 30.0)
    return edges.join(every.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst", "dist")


def _members(spark, sf) -> DataFrame:
    return pixels(spark, sf).filter("(node_id * 7919) % 10 < 7").select("node_id")


@query(f"with {_LATTICE} select src, dst, dist from lat")
def j12_lattice_edges(spark, sf):
    return _lattice(spark, sf).select("src", "dst", F.round("dist", 6).alias("dist"))


@query(f"with {_LATTICE}, m as (select i as node_id, row_number() over (order by i) - 1 as local from px where (i * 7919) % 10 < 7) select a.local as src, b.local as dst from lat join m a on a.node_id = src join m b on b.node_id = dst")
def j13_induced_subgraph(spark, sf):
    """Edges among members, with members numbered anew in order."""
    members = _members(spark, sf)
    local = graph.numbered(members)
    inner = graph.induced(_lattice(spark, sf), members)
    a, b = local.select(F.col("node_id").alias("src"), F.col("local").alias("a")), local.select(F.col("node_id").alias("dst"), F.col("local").alias("b"))
    return inner.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


@query("select count(*) as edges, count(distinct l_partkey) as parts from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey < 5)")
def j14_bipartite_subset(spark, sf):
    some = table(spark, sf, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf, "lineitem").join(some, "l_suppkey", "left_semi").agg(F.count("*").alias("edges"), F.countDistinct("l_partkey").alias("parts"))


@query(f"with {_LATTICE}, q as (select i, row_number() over (order by i) - 1 as local from px where r < width // 2 and c < width // 2) select a.local as src, b.local as dst from lat join q a on a.i = src join q b on b.i = dst")
def j15_quadrant_edges(spark, sf):
    """Edges within a quadrant, from global to local numbers by arithmetic on row and column."""
    width, _, _ = raster_sizes(spark, sf)
    half = width // 2
    split = lambda c: (F.floor(F.col(c) / width), F.col(c) % width)
    (r1, c1), (r2, c2) = split("src"), split("dst")
    inside = (r1 < half) & (c1 < half) & (r2 < half) & (c2 < half)
    return _lattice(spark, sf).filter(inside).select((r1 * half + c1).alias("src"), (r2 * half + c2).alias("dst"))


@query(f"with {_LATTICE}, e as (select src, dst from lat where (src * 31 + dst) % 11 <> 0) select src, dst from e anti join (select dst as src, src as dst from e) using (src, dst)")
def j16_missing_reverses(spark, sf):
    return graph.asymmetric(_lattice(spark, sf).filter("(src * 31 + dst) % 11 <> 0").select("src", "dst"))


@query("select l_partkey as src, l_suppkey as dst, count(*) as count, l_partkey = l_suppkey as self_loop from lineitem group by 1, 2 having count(*) > 1 or l_partkey = l_suppkey")
def j17_repeated_edges(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return edges.groupBy("src", "dst").count().filter("count > 1 or src = dst").withColumn("self_loop", F.col("src") == F.col("dst"))


@query("with g as (select o_custkey % 40 as city, o_orderkey % 3 as seed, min(o_orderkey) as run, min(o_orderstatus) as hash from orders where o_orderkey % 2 = 0 group by 1, 2), m as (select o_custkey % 45 as city, o_orderkey % 3 as seed, min(o_orderkey) as run, min(o_orderstatus) as hash from orders where o_orderkey % 2 = 1 group by 1, 2) select coalesce(g.city, m.city) as city, coalesce(g.seed, m.seed) as seed, g.run as run_a, m.run as run_b, case when g.run is null then 'no_a' when m.run is null then 'no_b' when g.hash <> m.hash then 'hash' else 'ok' end as reason from g full join m on g.city = m.city and g.seed = m.seed")
def j21_pairing_with_reasons(spark, sf):
    """Runs of two kinds by key; those without a partner, or with another hash, stay with the reason."""
    orders = table(spark, sf, "orders")
    side = lambda odd, m, tag: orders.filter(F.col("o_orderkey") % 2 == odd).groupBy((F.col("o_custkey") % m).alias("city"), (F.col("o_orderkey") % 3).alias("seed")).agg(F.min("o_orderkey").alias(f"run_{tag}"), F.min("o_orderstatus").alias(f"hash_{tag}"))
    reason = F.when(F.col("run_a").isNull(), "no_a").when(F.col("run_b").isNull(), "no_b").when(F.col("hash_a") != F.col("hash_b"), "hash").otherwise("ok")
    return side(0, 40, "a").join(side(1, 45, "b"), ["city", "seed"], "full").select("city", "seed", "run_a", "run_b", reason.alias("reason"))


@query("with l as (select o_orderkey, (select max(l_linenumber) from lineitem where l_orderkey = o_orderkey) as m from orders) select o_orderkey as node_id, l.m is not null as covered, x.l_extendedprice as value from l left join (select l_orderkey, l_linenumber, max(l_extendedprice) as l_extendedprice from lineitem group by 1, 2) x on x.l_orderkey = o_orderkey and x.l_linenumber = l.m")
def j22_scatter_last_write(spark, sf):
    """Batch results brought to node order, the latest batch winning, with a coverage mark."""
    last = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("node_id")).agg(F.max_by("l_extendedprice", F.struct("l_linenumber", "l_extendedprice")).alias("value"), F.lit(True).alias("c"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("node_id")).join(last, "node_id", "left").select("node_id", F.coalesce("c", F.lit(False)).alias("covered"), "value")


@query("with b as (select n_nationkey as q, n_nationkey * 7 % 40 as x0, n_nationkey * 7 % 40 + 10 as x1, n_nationkey * 11 % 30 as y0, n_nationkey * 11 % 30 + 8 as y1 from nation) select a.q as q1, c.q as q2, cast((least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) as bigint) as area from b a join b c on a.q < c.q where least(a.x1, c.x1) > greatest(a.x0, c.x0) and least(a.y1, c.y1) > greatest(a.y0, c.y0)")
def j23_box_overlaps(spark, sf):
    """Overlapping boxes: both are cut into tiles as wide as the largest box, and boxes of a tile meet."""
    boxes = table(spark, sf, "nation").selectExpr("n_nationkey as q", "n_nationkey * 7 % 40 as x0", "n_nationkey * 7 % 40 + 10 as x1", "n_nationkey * 11 % 30 as y0", "n_nationkey * 11 % 30 + 8 as y1")
    tiled = boxes.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / 10), F.floor(F.col("x1") / 10))))
    a, c = tiled.alias("a"), tiled.alias("c")
    w = F.least("a.x1", "c.x1") - F.greatest("a.x0", "c.x0")
    h = F.least("a.y1", "c.y1") - F.greatest("a.y0", "c.y0")
    joined = a.join(c, (F.col("a.tx") == F.col("c.tx")) & (F.col("a.q") < F.col("c.q"))).filter((w > 0) & (h > 0))
    return joined.select(F.col("a.q").alias("q1"), F.col("c.q").alias("q2"), (w * h).cast("bigint").alias("area")).distinct()


@query(f"with {NODES_SQL} select distinct x_m // 500 as x, y_m // 500 as y from nodes where x_m < 30000 intersect select ax // 500, ay // 500 from (select (p_partkey * 48271 + 11) % 60000 as ax, (p_partkey * 69621 + 7) % 59999 as ay from part)")
def j24_coincident_places(spark, sf):
    a = nodes(spark, sf).filter("x_m < 30000").selectExpr("x_m div 500 as x", "y_m div 500 as y")
    return a.intersect(_points(spark, sf).selectExpr("px div 500", "py div 500"))


@query("with a as (select s_suppkey as pos, round(s_acctbal, 2) as v from supplier), b as (select s_suppkey as pos, round(s_acctbal, 2) + case when s_suppkey % 10 = 0 then 0.01 else 0 end as v from supplier) select count(*) as n, count(*) filter (where a.v is null or b.v is null) as unmatched, count(*) filter (where abs(a.v - b.v) > 0.001) as off, round(max(abs(a.v - b.v)), 6) as largest from a full join b on a.pos = b.pos")
def j25_aligned_metadata(spark, sf):
    """Two tables by ordinal: rows without a partner, values further apart than the tolerance, largest error."""
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey as pos", "round(s_acctbal, 2) as v")
    other = rows.select("pos", (F.col("v") + F.when(F.col("pos") % 10 == 0, 0.01).otherwise(0.0)).alias("w"))
    gap = F.abs(F.col("v") - F.col("w"))
    return rows.join(other, "pos", "full").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull() | F.col("w").isNull()).alias("unmatched"), F.count_if(gap > 0.001).alias("off"), F.round(F.max(gap), 6).alias("largest"))


@query(f"with {_LATTICE}, m as (select i as node_id from px where (i * 7919) % 10 < 7), e as (select src, dst from lat where src <> dst), f as (select src, count(*) as d from e group by 1), g as (select src, count(*) as dv, count(*) filter (where dst not in (select node_id from m)) as outer_n from e where src in (select node_id from m) group by 1) select outer_n > 0 as border, count(*) as n, cast(sum(d) as bigint) as full_degree, cast(sum(dv - outer_n) as bigint) as kept_degree, round(1 - cast(sum(dv - outer_n) as double) / sum(d), 9) as loss from g join f using (src) group by 1")
def a23_a24_degree_preservation(spark, sf):
    """Degrees before and after restricting to members, inner nodes and those with an edge to the outside apart."""
    edges = _lattice(spark, sf).filter("src <> dst").select("src", "dst")
    members = _members(spark, sf)
    inner = graph.degrees(graph.induced(edges, members)).withColumnRenamed("degree", "k")
    both = graph.degrees(edges).join(members, "node_id", "left_semi").join(inner, "node_id", "left").select("node_id", "degree", F.coalesce("k", F.lit(0)).alias("k"))
    return both.groupBy((F.col("degree") > F.col("k")).alias("border")).agg(F.count("*").alias("n"), F.sum("degree").alias("full_degree"), F.sum("k").alias("kept_degree"), F.round(1 - F.sum("k").cast("double") / F.sum("degree"), 9).alias("loss"))


@query(f"with {_LATTICE} select round(max(dist), 6) as longest, round(avg(dist), 6) as mean, round(quantile_cont(dist, 0.99), 6) as p99 from lat where src <> dst")
def a25_edge_lengths(spark, sf):
    return _lattice(spark, sf).filter("src <> dst").agg(F.round(F.max("dist"), 6).alias("longest"), F.round(F.avg("dist"), 6).alias("mean"), F.round(F.percentile("dist", 0.99), 6).alias("p99"))


@query(f"with {NODES_SQL}, {_REACH} select node_id, {stats.exact_mean_sql('rssi')} as mean from reach group by node_id")
def g1_mean_of_neighbours(spark, sf):
    """One step of mean aggregation from antennas to nodes, in whole millionths; every pair counts, none is a row."""
    left = places(spark, sf).select(F.col("node_id").alias("key"), F.col("x_m").alias("lx"), F.col("y_m").alias("ly"))
    right = sites(spark, sf).select(F.col("ax").alias("rx"), F.col("ay").alias("ry"), ((POWER - F.col("ant_id") % 10) * 1_000_000).alias("base"))
    found = reach.sums_within(left, right, RADIUS_M, free_space_millionths)
    return found.select(F.col("key").alias("node_id"), stats.exact_mean_of(F.col("total"), F.col("n")).alias("mean"))


@query(f"with {NODES_SQL}, c as (select quantile_cont(x_m, 0.5) as cx, quantile_cont(y_m, 0.5) as cy from nodes), d as (select node_id, greatest(abs(x_m - cx), abs(y_m - cy)) as h from nodes, c), r as (select h, count(*) over (order by h range between unbounded preceding and current row) as below from d), w as (select max(h) as h from r where below <= 500) select node_id from d, w where d.h <= w.h")
def f4_contiguous_window(spark, sf):
    """The largest square around the median centre that holds at most 500 nodes; ties fall out together."""
    rows = nodes(spark, sf)
    centre = rows.agg(F.median("x_m").alias("cx"), F.median("y_m").alias("cy"))
    half = rows.join(F.broadcast(centre)).select("node_id", F.greatest(F.abs(F.col("x_m") - F.col("cx")), F.abs(F.col("y_m") - F.col("cy"))).alias("h"))
    first = half.groupBy("h").agg(F.count("*").alias("n")).orderBy("h").limit(501)  # at most 500 nodes have at most 500 distances
    width = first.withColumn("below", F.sum("n").over(Window.orderBy("h"))).filter("below <= 500").agg(F.max("h").alias("w"))
    return half.join(F.broadcast(width), F.col("h") <= F.col("w")).select("node_id")
