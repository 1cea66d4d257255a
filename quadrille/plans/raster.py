"""Terrain stencils on a grid of one-kilometre cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.fixtures import FEATURES_SQL, features
from quadrille.functions import stats
from quadrille.operators import stencil
from quadrille.plans.base import query

CELL_M = 1000
_CELLS = f"with {FEATURES_SQL}, cells as (select y_m // {CELL_M} as row, x_m // {CELL_M} as col, {stats.exact_mean_sql('elevation')} as v from feats group by 1, 2)"


def _cells(spark, sf) -> DataFrame:
    return features(spark, sf).groupBy(F.expr(f"y_m div {CELL_M}").alias("row"), F.expr(f"x_m div {CELL_M}").alias("col")).agg(stats.exact_mean(F.col("elevation")).alias("v"))


def _side(a: str, b: str) -> str:
    return f"coalesce(({b}.v - {a}.v) / 2, {b}.v - c.v, c.v - {a}.v, 0.0::double)"


@query(f"""{_CELLS}, g as (
select c.row, c.col, {_side('w', 'e')} as gx, {_side('s', 'n')} as gy, coalesce(e.v, c.v) + coalesce(w.v, c.v) + coalesce(n.v, c.v) + coalesce(s.v, c.v) - 4 * c.v as k
from cells c left join cells e on e.row = c.row and e.col = c.col + 1 left join cells w on w.row = c.row and w.col = c.col - 1
left join cells n on n.row = c.row + 1 and n.col = c.col left join cells s on s.row = c.row - 1 and s.col = c.col)
select row, col, round(gx, 7) as gx, round(gy, 7) as gy, round(sqrt(gx * gx + gy * gy), 6) as slope, round(k, 6) as curvature, round(ln(1 + abs(k) * 100 + 1), 6) as flow from g""")
def r01_r04_gradient(spark, sf):
    """Gradient, slope and curvature with one-sided edges, and the flow proxy that follows from them.

    Halves of whole millionths have seven decimals, so that no rounding is left open.
    """
    seen = stencil.around(_cells(spark, sf)).groupBy("row", "col").agg(stencil.at(0, 0).alias("c"), stencil.at(0, 1).alias("e"), stencil.at(0, -1).alias("w"), stencil.at(1, 0).alias("n"), stencil.at(-1, 0).alias("s")).filter("c is not null")
    gx, gy = stencil.slope(F.col("w"), F.col("c"), F.col("e")), stencil.slope(F.col("s"), F.col("c"), F.col("n"))
    k = sum((F.coalesce(F.col(x), F.col("c")) for x in "wns"), F.coalesce("e", "c")) - 4 * F.col("c")
    return seen.select("row", "col", gx.alias("gx"), gy.alias("gy"), k.alias("k")).select("row", "col", F.round("gx", 7).alias("gx"), F.round("gy", 7).alias("gy"), F.round(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), 6).alias("slope"), F.round("k", 6).alias("curvature"), F.round(F.log1p(F.abs("k") * 100 + 1), 6).alias("flow"))


@query(f"""{_CELLS}, g as (
select c.row, c.col, {_side('w', 'e')} as gx, {_side('s', 'n')} as gy
from cells c left join cells e on e.row = c.row and e.col = c.col + 1 left join cells w on w.row = c.row and w.col = c.col - 1
left join cells n on n.row = c.row + 1 and n.col = c.col left join cells s on s.row = c.row - 1 and s.col = c.col)
select row, col, round(cos(atan2(-gx, gy)), 6) as aspect_cos, round(sin(atan2(-gx, gy)), 6) as aspect_sin, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) as slope_deg from g where gx <> 0 or gy <> 0""")
def r01_aspect(spark, sf):
    """The direction a slope faces, as cosine and sine, and its angle; level cells face nowhere and are left out."""
    seen = stencil.around(_cells(spark, sf)).groupBy("row", "col").agg(stencil.at(0, 0).alias("c"), stencil.at(0, 1).alias("e"), stencil.at(0, -1).alias("w"), stencil.at(1, 0).alias("n"), stencil.at(-1, 0).alias("s")).filter("c is not null")
    both = seen.select("row", "col", stencil.slope(F.col("w"), F.col("c"), F.col("e")).alias("gx"), stencil.slope(F.col("s"), F.col("c"), F.col("n")).alias("gy")).filter("gx <> 0 or gy <> 0")
    facing = F.atan2(-F.col("gx"), F.col("gy"))
    return both.select("row", "col", F.round(F.cos(facing), 6).alias("aspect_cos"), F.round(F.sin(facing), 6).alias("aspect_sin"), F.round(F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))), 6).alias("slope_deg"))


@query(f"{_CELLS} select c.row, c.col, round(sum(o.v) / 9, 6) as mean_zero_padded, round(max(o.v) - min(o.v), 6) as ruggedness, count(*) as present, round(c.v - sum(o.v) / 9, 6) as position_index from cells c join cells o on o.row between c.row - 1 and c.row + 1 and o.col between c.col - 1 and c.col + 1 group by c.row, c.col, c.v")
def r02_r03_window(spark, sf):
    """Three by three: the mean counts missing cells as zero, the range only cells that are there."""
    seen = stencil.around(_cells(spark, sf)).groupBy("row", "col").agg(stencil.at(0, 0).alias("c"), F.sum("v").alias("t"), F.max("v").alias("hi"), F.min("v").alias("lo"), F.count("*").alias("present")).filter("c is not null")
    return seen.select("row", "col", F.round(F.col("t") / 9, 6).alias("mean_zero_padded"), F.round(F.col("hi") - F.col("lo"), 6).alias("ruggedness"), "present", F.round(F.col("c") - F.col("t") / 9, 6).alias("position_index"))
