"""Projections and filters: coordinates, propagation formulas, indices, strings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.fixtures import FEATURES_SQL, NODES_SQL, PIXELS_SQL, features, nodes, pixels, raster_sizes, sites, table
from quadrille.functions import geo
from quadrille.functions import propagation as P
from quadrille.functions import stats
from quadrille.plans.base import query

LON0, LAT0 = -49.5, -22.5
_LON, _LAT = f"({LON0} + x_m / 100000.0)", f"({LAT0} + y_m / 100000.0)"


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _geo(spark, sf) -> DataFrame:
    return nodes(spark, sf).withColumns({"lon": F.lit(LON0) + F.col("x_m") / 100000.0, "lat": F.lit(LAT0) + F.col("y_m") / 100000.0})


@query(f"with {NODES_SQL}, o as (select min({_LON}) as lon0, min({_LAT}) as lat0 from nodes) select node_id, round(({_LON} - lon0) * 111000.0 * cos(radians({_LAT})), 4) as x, round(({_LAT} - lat0) * 111000.0, 4) as y from nodes, o")
def p01_equirectangular(spark, sf):
    rows = _geo(spark, sf)
    origin = rows.agg(F.min("lon").alias("lon0"), F.min("lat").alias("lat0"))  # one row
    x, y = geo.equirectangular(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    return rows.join(F.broadcast(origin)).select("node_id", _r(x, 4).alias("x"), _r(y, 4).alias("y"))


@query(f"with {NODES_SQL}, g as (select node_id, {_LON} as lon, {_LAT} as lat from nodes) select node_id, round(2 * 6371000.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians({LAT0} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({LAT0})) * pow(sin(radians({LON0} - lon) / 2), 2))))), 3) as metres from g")
def p02_haversine(spark, sf):
    return _geo(spark, sf).select("node_id", _r(geo.haversine(F.col("lat"), F.col("lon"), F.lit(LAT0), F.lit(LON0)), 3).alias("metres"))


@query(f"with {NODES_SQL} select 'degrees' as kind, max(abs({_LON})) <= 181 as is_geographic from nodes union all select 'metres', max(abs(x_m)) <= 181 from nodes")
def p03_crs_detection(spark, sf):
    rows = _geo(spark, sf)
    degrees = rows.agg(geo.is_geographic(F.col("lon")).alias("is_geographic")).select(F.lit("degrees").alias("kind"), "is_geographic")
    return degrees.unionByName(rows.agg(geo.is_geographic(F.col("x_m")).alias("is_geographic")).select(F.lit("metres").alias("kind"), "is_geographic"))


@query(f"with {NODES_SQL}, m as (select max(gy) + 1 as r from nodes) select node_id, gx, gy, gx * r + gy as block from nodes, m")
def p04_grid_assignment(spark, sf):
    rows = nodes(spark, sf)
    most = rows.agg((F.max("gy") + 1).alias("r"))  # one row
    return rows.join(F.broadcast(most)).select("node_id", "gx", "gy", geo.block_id(F.col("gx"), F.col("gy"), F.col("r")).alias("block"))


@query(f"with {NODES_SQL} select node_id, round(20 * log10(greatest(dist_m / 1000.0, 0.001)) + 20 * log10(1800.0::double) + 32.44, 6) as loss from nodes")
def p05_free_space(spark, sf):
    return nodes(spark, sf).select("node_id", _r(P.free_space(F.col("dist_m"), F.lit(1800.0))).alias("loss"))


_HATA = "69.55 + 26.16 * log10(f) - 13.82 * log10(30.0::double) - a + (44.9 - 6.55 * log10(30.0::double)) * log10(greatest(dist_m / 1000.0, 0.001))"
_LARGE = f"with {NODES_SQL}, h as (select node_id, f, {_HATA} as urban from (select node_id, dist_m, f, case when f <= 300 then 8.29 * pow(log10(1.54 * 1.5::double), 2) - 1.1 else 3.2 * pow(log10(11.75 * 1.5::double), 2) - 4.97 end as a from nodes, (select unnest([250.0::double, 900.0::double]) as f)))"


def _by_frequency(spark, sf, *f: float) -> DataFrame:
    return nodes(spark, sf).withColumn("f", F.explode(F.array(*map(F.lit, f))))


@query(_LARGE + " select node_id, f, round(urban, 6) as loss from h")
def p06_hata_urban(spark, sf):
    return _by_frequency(spark, sf, 250.0, 900.0).select("node_id", "f", _r(P.hata_large_city(F.col("dist_m"), F.col("f"), F.lit(30.0), F.lit(1.5))).alias("loss"))


@query(_LARGE + " select node_id, f, round(urban - 2 * pow(log10(f / 28.0), 2) - 5.4, 6) as loss from h")
def p07_hata_suburban(spark, sf):
    return _by_frequency(spark, sf, 250.0, 900.0).select("node_id", "f", _r(P.hata_large_city(F.col("dist_m"), F.col("f"), F.lit(30.0), F.lit(1.5), "suburban")).alias("loss"))


@query(_LARGE + " select node_id, f, round(urban - 4.78 * pow(log10(f), 2) + 18.33 * log10(f) - 40.94, 6) as loss from h")
def p08_hata_rural(spark, sf):
    return _by_frequency(spark, sf, 250.0, 900.0).select("node_id", "f", _r(P.hata_large_city(F.col("dist_m"), F.col("f"), F.lit(30.0), F.lit(1.5), "rural")).alias("loss"))


_COST = "46.3 + 33.9 * log10(f) - 13.82 * log10(30.0::double) - ((1.1 * log10(f) - 0.7) * 1.5 - (1.56 * log10(f) - 0.8)) + (44.9 - 6.55 * log10(30.0::double)) * log10(greatest(dist_m / 1000.0, 0.001))"


@query(f"with {NODES_SQL} select node_id, round({_COST} + 3.0, 6) as urban, round({_COST}, 6) as suburban from (select *, 1800.0::double as f from nodes)")
def p09_cost231(spark, sf):
    own = lambda urban: _r(P.cost231(F.col("dist_m"), F.lit(1800.0), F.lit(30.0), F.lit(1.5), urban))
    return nodes(spark, sf).select("node_id", own(True).alias("urban"), own(False).alias("suburban"))


@query(f"with {NODES_SQL} select node_id, round(20 * log10(0.001::double) + 20 * log10(900.0::double) + 32.44 + 35.0 * log10(greatest(dist_m, 1.0)), 6) as loss from nodes")
def p10_log_distance(spark, sf):
    return nodes(spark, sf).select("node_id", _r(P.log_distance(F.col("dist_m"), F.lit(900.0))).alias("loss"))


@query(
    f"with {NODES_SQL}, b as (select node_id, dist_m, 900.0::double as f, 3.2 * pow(log10(11.75 * 1.5::double), 2) - 4.97 as a from nodes), m as (select node_id, 'fspl' as model, 20 * log10(greatest(dist_m / 1000.0, 0.001)) + 20 * log10(f) + 32.44 as pl from b union all select node_id, 'okumura_hata_urban', {_HATA} from b union all select node_id, 'okumura_hata_suburban', {_HATA} - 2 * pow(log10(f / 28.0), 2) - 5.4 from b union all select node_id, 'okumura_hata_rural', {_HATA} - 4.78 * pow(log10(f), 2) + 18.33 * log10(f) - 40.94 from b union all select node_id, 'cost231_urban', {_COST} + 3.0 from b union all select node_id, 'cost231_suburban', {_COST} from b union all select node_id, 'log_distance', 20 * log10(0.001::double) + 20 * log10(f) + 32.44 + 35.0 * log10(greatest(dist_m, 1.0)) from b) select model, count(*) as n, round(avg(pl), 6) as path_loss, round(avg(30.0 - pl), 6) as rssi, count(*) filter (where round(30.0 - pl, 9) > -100) as covered from m group by model"
)
def p11_model_dispatch(spark, sf):
    picked = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), loss(F.col("dist_m"), F.lit(900.0)).alias("pl")) for m, loss in P.MODELS.items()])).alias("x")
    rows = nodes(spark, sf).select(picked).select("x.*").withColumn("rssi", 30.0 - F.col("pl"))
    return rows.groupBy("model").agg(F.count("*").alias("n"), _r(F.avg("pl")).alias("path_loss"), _r(F.avg("rssi")).alias("rssi"), F.count_if(F.round("rssi", 9) > -100).alias("covered"))


_SMALL = "69.55 + 26.16 * log10(g) - 13.82 * log10(30.0::double) - ((1.1 * log10(g) - 0.7) * 1.5 - (1.56 * log10(g) - 0.8)) + (44.9 - 6.55 * log10(30.0::double)) * log10(greatest(dist_m / 1000.0, 0.001))"
_SMALL_SUB = f"({_SMALL} - 2 * pow(log10(g / 28.0), 2) - 5.4)"
_FS = "(select unnest([100.0::double, 900.0::double, 2600.0::double]) as f)"


@query(f"with {NODES_SQL} select node_id, f, round({_SMALL}, 6) as urban, round({_SMALL_SUB}, 6) as suburban from (select *, least(2000.0, greatest(150.0, f)) as g from nodes, {_FS})")
def p12_hata_small_city(spark, sf):
    own = lambda e: _r(P.hata_small_city(F.col("dist_m"), F.col("f"), F.lit(30.0), F.lit(1.5), e))
    return _by_frequency(spark, sf, 100.0, 900.0, 2600.0).select("node_id", "f", own("urban").alias("urban"), own("suburban").alias("suburban"))


@query(f"with {NODES_SQL} select node_id, f0 as f, round({_COST}, 6) as loss from (select *, least(2000.0, greatest(1500.0, f0)) as f from nodes, (select unnest([100.0::double, 900.0::double, 2600.0::double]) as f0))")
def p13_cost231_clipped(spark, sf):
    return _by_frequency(spark, sf, 100.0, 900.0, 2600.0).select("node_id", "f", _r(P.cost231_clipped(F.col("dist_m"), F.col("f"), F.lit(30.0), F.lit(1.5))).alias("loss"))


_VEG = "least(40.0, greatest(0.0, 0.25 * pow(f0, 0.39) * pow(least(dist_m * least(1.0, greatest(0.0, (ndvi + 1) / 2)) * 0.3, 400.0), 0.25)))"
_TERRAIN = "least(30.0, greatest(0.0, slope * 20 + case when slope > 0.1 then (slope - 0.1) * 30 else 0.0 end))"


@query(
    f"with {FEATURES_SQL} select node_id, f0 as f, round(case when f0 <= 1500 then {_SMALL_SUB} else {_COST} end + {_VEG} + {_TERRAIN}, 6) as loss from (select *, least(2000.0, greatest(150.0, f0)) as g, least(2000.0, greatest(1500.0, f0)) as f from feats, (select unnest([900.0::double, 1800.0::double]) as f0))"
)
def p14_combined_loss(spark, sf):
    rows = features(spark, sf).withColumn("f", F.explode(F.array(F.lit(900.0), F.lit(1800.0))))
    return rows.select("node_id", "f", _r(P.combined_loss(F.col("dist_m"), F.col("f"), F.lit(30.0), F.lit(1.5), F.col("ndvi"), F.col("slope"))).alias("loss"))


@query(f"with {NODES_SQL} select case when rssi >= -70 then 5 when rssi >= -85 then 4 when rssi >= -100 then 3 when rssi >= -110 then 2 else 1 end as class, count(*) as n, min(rssi) as lo, max(rssi) as hi from nodes group by 1")
def p15_coverage_class(spark, sf):
    return nodes(spark, sf).groupBy(P.coverage_class(F.col("rssi")).alias("class")).agg(F.count("*").alias("n"), F.min("rssi").alias("lo"), F.max("rssi").alias("hi"))


@query("select p_partkey, case when f > 1800 then 'urban' when f > 800 then 'suburban' else 'rural' end as environment from (select p_partkey, (p_partkey * 37) % 2700 as f from part)")
def p16_environment(spark, sf):
    return table(spark, sf, "part").select("p_partkey", P.environment_of((F.col("p_partkey") * 37) % 2700).alias("environment"))


@query("select p_partkey, round(case when w * 1000 > 0 and log10(nullif(w * 1000, 0)) >= 0 then 10 * log10(nullif(w * 1000, 0)) else 30.0 end, 6) as dbm, case when h > 0 then h else 30.0 end as height from (select p_partkey, cast(p_partkey % 50 as double) / 10000.0 as w, cast(p_partkey % 7 - 2 as double) as h from part)")
def p17_antenna_defaults(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", "p_partkey % 50 / 10000.0D as w", "cast(p_partkey % 7 - 2 as double) as h")
    return rows.select("p_partkey", _r(P.watts_to_dbm(F.col("w"))).alias("dbm"), P.positive_height(F.col("h")).alias("height"))


_KNIFE = "greatest(0.0, case when v < -0.7 then 0.0 when v <= 0 then -20 * log10(greatest(0.5 - 0.62 * v, 1e-9)) when v <= 1 then -20 * log10(greatest(0.5 * exp(-0.95 * v), 1e-9)) when v <= 2.4 then -20 * log10(greatest(0.4 - sqrt(greatest(0.1184 - pow(0.38 - 0.1 * v, 2), 1e-9)), 1e-9)) else -20 * log10(greatest(0.225 / greatest(v, 1e-6), 1e-9)) end)"


@query(f"select p_partkey, round({_KNIFE}, 6) as loss from (select p_partkey, cast(p_partkey % 500 - 100 as double) / 100.0 as v from part)")
def p18_knife_edge(spark, sf):
    return table(spark, sf, "part").select("p_partkey", _r(P.knife_edge((F.col("p_partkey") % 500 - 100) / 100.0)).alias("loss"))


@query(f"with {FEATURES_SQL} select node_id, round(least(40.0, greatest(0.0, dist_m * least(1.0, greatest(0.0, ndvi - 0.5)) * 0.2 * least(1.0, greatest(0.0, ndvi)) * pow(1800.0::double / 1000 / 1.8, 0.4))), 6) as margin from feats")
def p19_shadow_margin(spark, sf):
    return features(spark, sf).select("node_id", _r(P.shadow_margin(F.col("ndvi"), F.col("dist_m"), 1800.0)).alias("margin"))


_FRESNEL = "least(80.0, greatest(0.0, greatest({tri}, 0.0) * 0.5 + {rough} * 0.5)) * sqrt(2 * (2 * greatest(dist_m / 2, 1.0)) / ((3e8 / (1800.0::double * 1e6)) * greatest(dist_m / 2, 1.0) * greatest(dist_m / 2, 1.0) + 1e-9))"


def _diffraction_sql(tri: str, rough: str) -> str:
    return f"select node_id, least(40.0, greatest(0.0, {_KNIFE})) as loss from (select node_id, {_FRESNEL.format(tri=tri, rough=rough)} as v from feats)"


@query(f"with {FEATURES_SQL} select node_id, round(loss, 6) as loss from ({_diffraction_sql('tri_m', 'roughness')})")
def p20_diffraction(spark, sf):
    return features(spark, sf).select("node_id", _r(P.diffraction(F.col("tri_m"), F.col("roughness"), F.col("dist_m"), 1800.0)).alias("loss"))


@query(
    f"with {FEATURES_SQL}, n as (select node_id, is_sentinel, path_loss, rssi, {_TERRAIN} as at_new, least(30.0, greatest(0.0, drawn * 20 + case when drawn > 0.1 then (drawn - 0.1) * 30 else 0.0 end)) as at_old from (select *, cast(node_id % 14 + 2 as double) / 100.0 as drawn from feats)), dif as ({_diffraction_sql('tri_m', 'roughness * 10')}) select node_id, round(case when is_sentinel then path_loss else path_loss + at_new - at_old end, 6) as path_loss, round(case when is_sentinel then rssi else rssi - (at_new - at_old) end, 6) as rssi, round(loss, 6) as diffraction from n join dif using (node_id)"
)
def p21_target_correction(spark, sf):
    """Terrain loss of a drawn slope replaced by that of the real one, on covered rows only; diffraction anew."""
    rows = features(spark, sf).withColumn("drawn", (F.col("node_id") % 14 + 2) / 100.0)
    delta = F.when(F.col("is_sentinel"), 0.0).otherwise(P.terrain_attenuation(F.col("slope")) - P.terrain_attenuation(F.col("drawn")))
    return rows.select("node_id", _r(F.col("path_loss") + delta).alias("path_loss"), _r(F.col("rssi") - delta).alias("rssi"), _r(P.diffraction(F.col("tri_m"), F.col("roughness") * 10, F.col("dist_m"), 1800.0)).alias("diffraction"))


@query(
    f"with {FEATURES_SQL} select node_id, round(least(1.0, greatest(-1.0, (b08 - b04) / (b08 + b04 + 1e-6))), 6) as v_ndvi, round(least(1.0, greatest(-1.0, (b03 - b08) / (b03 + b08 + 1e-6))), 6) as v_ndwi, round(least(1.0, greatest(-1.0, ((b04 + b02) - (b08 + b03)) / ((b04 + b02) + (b08 + b03) + 1e-6))), 6) as v_bsi, round(least(1.0, greatest(0.0, 1 - sqrt((b02 * b02 + b03 * b03 + b04 * b04) / 3))), 6) as v_shadow from feats"
)
def p22_spectral_indices(spark, sf):
    b = [F.col(c) for c in ("b02", "b03", "b04", "b08")]
    return features(spark, sf).select("node_id", _r(P.normalised_difference(b[3], b[2])).alias("v_ndvi"), _r(P.normalised_difference(b[1], b[3])).alias("v_ndwi"), _r(P.bare_soil_index(*b)).alias("v_bsi"), _r(P.shadow_index(*b[:3])).alias("v_shadow"))


@query(f"with {FEATURES_SQL}, s as (select avg(elevation) as m, stddev_pop(elevation) as d from feats) select node_id, round((elevation - m) / case when d < 1e-6 then 1.0 else d end, 6) as z from feats, s")
def p23_z_score(spark, sf):
    rows = features(spark, sf)
    own = rows.agg(F.avg("elevation").alias("m"), F.stddev_pop("elevation").alias("d"))  # one row
    return rows.join(F.broadcast(own)).select("node_id", _r(stats.z_score(F.col("elevation"), F.col("m"), F.col("d"))).alias("z"))


@query(f"with {PIXELS_SQL} select node_id, round(-49.5::double + col * 0.01::double, 9) as lon, round(-22.5::double - row * 0.01::double, 9) as lat from nodes")
def p25_pixel_positions(spark, sf):
    lon, lat = geo.pixel_position(F.col("row"), F.col("col"), -49.5, -22.5, 0.01, -0.01)
    return pixels(spark, sf).select("node_id", _r(lon, 9).alias("lon"), _r(lat, 9).alias("lat"))


@query(f"with {PIXELS_SQL} select node_id, round(-22.0::double - row * 0.5 / (width - 1), 9) as lat, round(-50.0::double + col * 0.5 / (width - 1), 9) as lon from nodes cross join size1")
def p26_synthetic_grid(spark, sf):
    """A grid of evenly spaced columns and rows, whose first row is the northernmost."""
    width, _, _ = raster_sizes(spark, sf)
    return pixels(spark, sf).select("node_id", _r(F.lit(-22.0) - F.col("row") * 0.5 / (width - 1), 9).alias("lat"), _r(F.lit(-50.0) + F.col("col") * 0.5 / (width - 1), 9).alias("lon"))


@query(f"with {PIXELS_SQL} select (row // 3) * ((width + 2) // 3) + col // 3 as parent, count(*) as children, min(node_id) as first from nodes cross join size1 group by 1")
def p27_parent_pixel(spark, sf):
    width, _, _ = raster_sizes(spark, sf)
    return pixels(spark, sf).groupBy(geo.parent_pixel(F.col("row"), F.col("col"), 3, (width + 2) // 3).alias("parent")).agg(F.count("*").alias("children"), F.min("node_id").alias("first"))


#: Names to numbers; all others share the last one.
SEGMENTS = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2}
OTHER_SEGMENT = 9


@query("select c_custkey, case c_mktsegment when 'AUTOMOBILE' then 0 when 'BUILDING' then 1 when 'FURNITURE' then 2 else 9 end as segment_id from customer")
def p28_name_to_id(spark, sf):
    known = F.create_map(*[F.lit(x) for pair in SEGMENTS.items() for x in pair])
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(F.try_element_at(known, F.col("c_mktsegment")), F.lit(OTHER_SEGMENT)).alias("segment_id"))


@query(r"select c_custkey, lower(regexp_extract(c_name, '^([A-Za-z]+)[#_-]?(\d+)$', 1)) as stem, cast(regexp_extract(c_name, '^([A-Za-z]+)[#_-]?(\d+)$', 2) as varchar) as number from customer")
def p29_label_extraction(spark, sf):
    part = lambda k: F.regexp_extract("c_name", r"^([A-Za-z]+)[#_-]?(\d+)$", k)
    return table(spark, sf, "customer").select("c_custkey", F.lower(part(1)).alias("stem"), part(2).alias("number"))


@query(r"select page_id, case when starts_with(p, 'C:\data') then '/mnt/data' || replace(substr(p, 8), '\', '/') else replace(p, '\', '/') end as path from (select page_id, case when page_id % 2 = 0 then 'C:\data\runs\' else 'D:\x\' end || cast(page_id as varchar) || '\run.json' as p from pages)")
def p30_path_translation(spark, sf):
    p = F.concat(F.when(F.col("page_id") % 2 == 0, "C:\\data\\runs\\").otherwise("D:\\x\\"), F.col("page_id").cast("string"), F.lit("\\run.json"))
    slashed = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    return table(spark, sf, "pages").select("page_id", F.when(p.startswith("C:\\data"), F.concat(F.lit("/mnt/data"), slashed(F.substr(p, F.lit(8))))).otherwise(slashed(p)).alias("path"))


@query("select c_custkey, printf('%.2f', case when round(c_acctbal, 2) = 0 then 0.0 else round(c_acctbal, 2) end) as fixed, printf('%.2f to %.2f', c_acctbal - 1, c_acctbal + 1) as span from customer")
def p31_number_formats(spark, sf):
    x = F.round("c_acctbal", 2)
    return table(spark, sf, "customer").select("c_custkey", F.format_string("%.2f", F.when(x == 0, 0.0).otherwise(x)).alias("fixed"), F.format_string("%.2f to %.2f", F.col("c_acctbal") - 1, F.col("c_acctbal") + 1).alias("span"))


@query(f"with {NODES_SQL} select node_id, cast(least(x_m % 10000, 10000 - x_m % 10000, y_m % 10000, 10000 - y_m % 10000) as double) as d from nodes")
def p32_edge_distance(spark, sf):
    return nodes(spark, sf).select("node_id", geo.edge_distance(F.col("x_m"), F.col("y_m"), 10_000).cast("double").alias("d"))


@query(f"with {FEATURES_SQL} select node_id, round(least(300.0, greatest(40.0, 40.0 + ln(1 + exp(ndvi * 5)))), 6) as path_loss, round(-140.0 + 110.0 / (1 + exp(-(rssi_pred + 85.0) / 20.0)), 6) as rssi from feats")
def p33_output_clamps(spark, sf):
    """Softplus with a floor and a ceiling; a sigmoid scaled to the range of received powers."""
    soft = P.clip(40.0 + F.log1p(F.exp(F.col("ndvi") * 5)), 40, 300)
    return features(spark, sf).select("node_id", _r(soft).alias("path_loss"), _r(-140.0 + 110.0 / (1 + F.exp(-(F.col("rssi_pred") + 85.0) / 20.0))).alias("rssi"))


@query(f"with {NODES_SQL} select is_sentinel, count(*) as n, min(path_loss) as lo, max(path_loss) as hi from nodes group by is_sentinel")
def f1_valid_and_sentinel(spark, sf):
    return nodes(spark, sf).groupBy("is_sentinel").agg(F.count("*").alias("n"), F.min("path_loss").alias("lo"), F.max("path_loss").alias("hi"))


@query(f"with {NODES_SQL} select node_id, x_m, y_m from nodes where x_m >= 30000 and x_m < 60000 and y_m >= 0 and y_m < 30000")
def f2_quadrant_window(spark, sf):
    return nodes(spark, sf).filter("x_m >= 30000 and x_m < 60000 and y_m >= 0 and y_m < 30000").select("node_id", "x_m", "y_m")


@query(f"with {NODES_SQL}, d as (select count(*) as n, bool_or(isnan(path_loss) or isinf(path_loss) or path_loss is null) as bad from nodes) select n, coalesce(bad, false) as has_non_finite from d")
def f5_finite_guard(spark, sf):
    x = F.col("path_loss")
    return nodes(spark, sf).agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.isnan(x) | x.isNull() | (F.abs(x) == math.inf)), F.lit(False)).alias("has_non_finite"))


@query("select count(*) as n, sum(ax) as ax, sum(ay) as ay from (select (s_suppkey*15485863+7)%60000 as ax, (s_suppkey*32452843+11)%59999 as ay from supplier)")
def f0_antennas(spark, sf):
    return sites(spark, sf).agg(F.count("*").alias("n"), F.sum("ax").alias("ax"), F.sum("ay").alias("ay"))
