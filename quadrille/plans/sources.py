"""Sources and sinks over files that are written from the test tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.fixtures import NODES_SQL, nodes, table
from quadrille.operators.shared import materialise, shared_dir
from quadrille.plans.base import query
from quadrille.sources import raster, records, tables

_BOX = (-22.0, -21.0, -50.0, -49.0)
_TEXTS = {
    "city": "case s_suppkey % 3 when 0 then 'Lins' when 1 then 'LINS' else 'Bauru' end",
    "lat": "case when s_suppkey % 13 = 0 then 'x' else cast(-22.5 + (s_suppkey * 37 % 200) / 100.0 as string) end",
    "lon": "case when s_suppkey % 17 = 0 then '' else cast(-50.5 + (s_suppkey * 91 % 200) / 100.0 as string) end",
    "height_m": "cast(s_suppkey % 7 * 10 - 10 as string)",
    "freq_mhz": "case when s_suppkey % 11 = 0 then 'n/a' else cast(s_suppkey * 450 % 3000 as string) end",
    "watts": "cast(s_suppkey % 9 / 4.0 as string)",
    "gain_dbi": "cast(s_suppkey % 5 * 4 - 4 as string)",
}
_ANT_SQL = """raw as (select case s_suppkey % 3 when 0 then 'Lins' when 1 then 'LINS' else 'Bauru' end as city,
  case when s_suppkey % 13 = 0 then null else -22.5::double + (s_suppkey * 37 % 200) / 100.0::double end as lat,
  case when s_suppkey % 17 = 0 then null else -50.5::double + (s_suppkey * 91 % 200) / 100.0::double end as lon,
  cast(s_suppkey % 7 * 10 - 10 as double) as height_m, case when s_suppkey % 11 = 0 then null else cast(s_suppkey * 450 % 3000 as double) end as freq_mhz,
  s_suppkey % 9 / 4.0::double as watts, cast(s_suppkey % 5 * 4 - 4 as double) as gain_dbi from supplier)"""
_CITY_SQL = f"""with {_ANT_SQL} select city, round(coalesce(lat, 0), 6) as lat, round(coalesce(lon, 0), 6) as lon, case when height_m <= 0 then 30.0::double else height_m end as height_m, freq_mhz, watts, {{gain}} as gain_dbi,
  round(case when 10 * log10(watts * 1000) < 0 then 30.0::double else 10 * log10(watts * 1000) end, 6) as dbm, case when freq_mhz > 1800 then 'urban' when freq_mhz > 800 then 'suburban' else 'rural' end as environment
  from raw where upper(city) = 'LINS' and coalesce(freq_mhz, 0) > 0 and watts > 0"""


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _antenna_file(spark, sf) -> str:
    """The suppliers as an antenna file; the separator in a header name is part of the format."""
    path = _path(spark, "antennas")
    rows = table(spark, sf, "supplier").select(*[F.expr(_TEXTS[new]).alias(old) for old, new in tables.ANTENNA_HEADER.items()])
    tables.write_csv(rows, path)
    return path


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in ("lat", "lon", "dbm")})


@query(_CITY_SQL.format(gain="gain_dbi"))
def s01_antenna_csv(spark, sf):
    return _rounded(tables.antennas(spark, _antenna_file(spark, sf), "lins"))


@query(_CITY_SQL.format(gain="case when gain_dbi <= 0 then 12.0::double else gain_dbi end"))
def s03_antenna_csv_prototype(spark, sf):
    """The same scan, but gains that aren't positive become 12 dBi."""
    return _rounded(tables.antennas(spark, _antenna_file(spark, sf), "lins", tables.PROTOTYPE_GAIN_DBI))


@query(f"with {_ANT_SQL}, b as (select * from raw where lat between -22.2 and -20.8 and lon between -50.2 and -48.8), f as (select band, count(*) filter (where abs(freq_mhz - band) <= 200) >= 5 as enough from b, (select unnest([900.0, 99999.0]) as band) group by band) select distinct cast(f.band as double) as band, round(lat, 6) as lat, round(lon, 6) as lon from b, f where not enough or abs(freq_mhz - band) <= 200")
def s02_antenna_box(spark, sf):
    """Positions around a box: one band that may have enough antennas, and one that has none, so all stay."""
    path = _antenna_file(spark, sf)
    one = lambda band: tables.antenna_positions(spark, path, _BOX, band).select(F.lit(band).alias("band"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
    return one(900.0).unionByName(one(99999.0))


@query("with l as (select -23.0::double + (p_partkey * 37 % 300) / 100.0::double as lat, -51.0::double + (p_partkey * 91 % 300) / 100.0::double as lon, p_size as elevation from part) select round(lat, 6) as lat, round(lon, 6) as lon, elevation from l where round(lat, 6) between -22 and -21 and round(lon, 6) between -50 and -49")
def s04_lidar_box(spark, sf):
    path = _path(spark, "lidar")
    rows = table(spark, sf, "part").selectExpr("round(-23.0D + (p_partkey * 37 % 300) / 100.0D, 6) as lat", "round(-51.0D + (p_partkey * 91 % 300) / 100.0D, 6) as lon", "cast(p_size as float) as elevation")
    tables.write_csv(rows, path)
    return tables.lidar(spark, path, _BOX).select("lat", "lon", F.col("elevation").cast("int").alias("elevation"))


@query(f"with {NODES_SQL} select node_id, rssi, is_sentinel from nodes")
def s05_tensor_columns(spark, sf):
    path = _path(spark, "tensor")
    nodes(spark, sf).write.parquet(path)
    return tables.tensor(spark, path, "node_id", "rssi", "is_sentinel")


_PIXELS = "px as (select o_orderkey // 100 as r, o_orderkey % 100 as c, case when o_orderkey % 7 = 0 then -9999 else o_orderkey % 901 end as v from orders)"


def _pixels(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey div 100 as row", "o_orderkey % 100 as col", "case when o_orderkey % 7 = 0 then -9999 else o_orderkey % 901 end as v")


@query(f"with {_PIXELS}, w as (select r, c - 10 as c, v from px where r >= 0 and r < 12 and c >= 10 and c < 60) select r as row, c as col, round(case when v = -9999 then (select avg(v) from w where v <> -9999) else v end, 6) as v from w")
def s06_raster_window(spark, sf):
    return raster.fill_gaps(raster.window(_pixels(spark, sf), -5, 12, 10, 60)).withColumn("v", F.round("v", 6))


@query(f"with {_PIXELS}, t as (select 0 as tile, r as row, c as col, v from px union all select 1, r + 3, c + 50, v * 2 from px union all select 2, r + 5, c + 20, v * 3 from px) select row, col, arg_max(v, tile) as v from t group by 1, 2")
def s07_mosaic(spark, sf):
    """Three overlapping tiles; where they meet the last one stands."""
    one = _pixels(spark, sf)
    tile = lambda k, r, c, by: one.select(F.lit(k).alias("tile"), F.lit(r).alias("row0"), F.lit(c).alias("col0"), "row", "col", (F.col("v") * by).alias("v"))
    return raster.mosaic(tile(0, 0, 0, 1).unionByName(tile(1, 3, 50, 2)).unionByName(tile(2, 5, 20, 3)))


@query(f"with {_PIXELS}, a as (select r // 3 as row, c // 3 as col, v * 20 as v from px) select row, col, round(greatest(least(cast(sum(v) as double) / count(v) / 10000.0, 1.0), 0.0), 9) as v from a group by 1, 2")
def s08_accumulated_raster(spark, sf):
    scaled = _pixels(spark, sf).withColumn("v", F.col("v") * 20)
    return raster.accumulate(scaled, 100, 100, 300, 300).withColumn("v", F.round("v", 9))


@query("select event_id, json_extract_string(props, '$.k') as k, cast(user_id as varchar) as nested, cast(null as varchar) as missing from events")
def s09_dotted_paths(spark, sf):
    path = _path(spark, "records")
    table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", F.from_json("props", "k int").alias("props"), F.struct(F.struct(F.col("user_id").alias("id")).alias("user")).alias("run"))).alias("value")).select("value").write.text(path)
    record = F.col("value")
    return spark.read.text(path).select(records.dotted(record, "event_id").cast("bigint").alias("event_id"), records.dotted(record, "props.k").alias("k"), records.dotted(record, "run.user.id").alias("nested"), records.dotted(record, "run.nothing.id").alias("missing"))


@query("select o_orderkey, o_orderstatus from orders where o_orderkey % 10 > 1")
def s10_json_lines(spark, sf):
    """Lines cut off in the middle and blank ones are passed over."""
    path = _path(spark, "lines")
    line = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    damaged = F.when(F.col("o_orderkey") % 10 == 0, F.substring(line, 1, 9)).when(F.col("o_orderkey") % 10 == 1, "").otherwise(line)
    table(spark, sf, "orders").select(damaged.alias("value")).write.text(path)
    return records.json_lines(spark, path, "o_orderkey bigint, o_orderstatus string")


@query("select 'run' || n_nationkey as label, case when n_nationkey % 2 = 0 then 'even' else 'odd' end as grp, n_name as name from nation where n_nationkey < 20")
def s11_found_runs(spark, sf):
    """Records found by their folders' names, which hold group and label; other files are left out."""
    path = _path(spark, "runs")
    rows = table(spark, sf, "nation").select(F.concat(F.when(F.col("n_nationkey") >= 20, "note").when(F.col("n_nationkey") % 2 == 0, "even_run").otherwise("odd_run"), F.col("n_nationkey").cast("string")).alias("folder"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("value"))
    rows.repartition("folder").write.partitionBy("folder").text(path)
    found = records.found_files(spark, path, r"folder=(?:even|odd)_(run\d+)/")
    return found.select("label", F.regexp_extract("path", r"folder=(even|odd)_", 1).alias("grp"), records.dotted(F.trim("text"), "name").alias("name"))


@query("with p as (select l_suppkey as run, l_linenumber as version, l_orderkey as idx, l_quantity as pred from lineitem) select run, version, idx, pred from p where (run, version) in (select run, max(version) from p group by run)")
def s12_newest_predictions(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_suppkey as run", "l_linenumber as version", "l_orderkey as idx", "l_quantity as pred")
    return tables.newest_predictions(rows, "run", "version")


@query("with t as (select c_mktsegment as segment, count(*) as n from customer group by 1) select segment || ',' || n as line from t union all select segment || ' & ' || n || ' \\\\' from t")
def s13_published_table(spark, sf):
    """A table as CSV, read back, and as lines of a tabular."""
    rows = materialise(table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")), "table")
    path = _path(spark, "published")
    tables.write_csv(rows, path)
    back = spark.read.option("header", "true").csv(path).select(F.concat_ws(",", "segment", "n").alias("line"))
    return back.unionByName(tables.tex_rows(rows, ["segment", "n"]))


@query("select cast(n_nationkey as bigint) as epoch, n_name as note from nation union all select cast(r_regionkey + 100 as bigint), r_name from region")
def s15_appended_log(spark, sf):
    path = _path(spark, "log")
    tables.write_csv(table(spark, sf, "nation").selectExpr("n_nationkey as epoch", "n_name as note"), path, "append")
    tables.write_csv(table(spark, sf, "region").selectExpr("r_regionkey + 100 as epoch", "r_name as note"), path, "append")
    return spark.read.schema("epoch bigint, note string").option("header", "true").csv(path)


@query("select n_nationkey as cell, case when n_nationkey % 3 = 0 then 'before' else 'now' end as made from nation")
def s17_resumed_output(spark, sf):
    """Cells with an output of status ok are kept; the others, failed ones among them, are made anew."""
    path = _path(spark, "cells")
    cells = table(spark, sf, "nation").selectExpr("n_nationkey as cell")
    cells.filter("cell % 3 < 2").selectExpr("cell", "case when cell % 3 = 0 then 'ok' else 'error' end as status", "'before' as made").write.parquet(path)
    done = spark.read.parquet(path)
    new = tables.remaining(cells, done, "cell").selectExpr("cell", "'ok' as status", "'now' as made")
    new.write.parquet(path + "-new")
    return done.unionByName(spark.read.parquet(path + "-new")).filter("status = 'ok'").select("cell", "made")
