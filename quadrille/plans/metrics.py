"""Errors of predictions by partition, population, ring and block; profiles, ranks and losses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.fixtures import DRAWS_SQL, FEATURES_SQL, FREQUENCY, NODES_SQL, PIXELS_SQL, draws, features, nodes, pixels, places, raster_sizes, sites, table
from quadrille.functions import propagation as P
from quadrille.functions import geo, stats
from quadrille.operators import partition, ranks, reach
from quadrille.plans.base import query
from quadrille.plans.blocks import populations
from quadrille.plans.joins import _REACH, POWER, RADIUS_M, strong_within

_FEATS = f"with {FEATURES_SQL}"
_ROLED = f"with {FEATURES_SQL}, {DRAWS_SQL}, p as (select * from feats join roles using (block_id))"
_POPS = "(select unnest(['valid', 'sentinel', 'all']) as pop) where (pop = 'all' or (pop = 'valid') = (not is_sentinel))"


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def _roled(spark, sf) -> DataFrame:
    rows = features(spark, sf)
    return rows.join(F.broadcast(partition.roles(draws(rows.select("block_id")))), "block_id")


def _errors(guess: str, truth: str, tag: str, where: Column | None = None) -> list[Column]:
    e = F.col(guess) - F.col(truth)
    e = e if where is None else F.when(where, e)
    return [stats.exact_mean(F.abs(e)).alias(f"mae_{tag}"), _r(F.sqrt(F.avg(e * e))).alias(f"rmse_{tag}"), stats.exact_mean(e).alias(f"bias_{tag}"), _r(F.percentile(F.abs(e), 0.9)).alias(f"p90_{tag}")]


def _errors_sql(guess: str, truth: str, tag: str, where: str = "true") -> str:
    e, f = f"({guess} - {truth})", f"filter (where {where})"
    return f"{stats.exact_mean_sql(f'abs{e}', where)} as mae_{tag}, round(sqrt(avg({e} * {e}) {f}), 6) as rmse_{tag}, {stats.exact_mean_sql(e, where)} as bias_{tag}, round(quantile_cont(abs{e}, 0.9) {f}, 6) as p90_{tag}"


@query(f"{_ROLED} select seed, role, count(*) as n, {_errors_sql('rssi_pred', 'rssi', 'rssi')}, {_errors_sql('pl_pred', 'path_loss', 'pl', 'not is_sentinel')} from p group by 1, 2")
def a01_errors_by_role(spark, sf):
    """Received power on all nodes of a partition, path loss on its valid ones."""
    return _roled(spark, sf).groupBy("seed", "role").agg(F.count("*").alias("n"), *_errors("rssi_pred", "rssi", "rssi"), *_errors("pl_pred", "path_loss", "pl", ~F.col("is_sentinel")))


@query(f"{_FEATS} select pop, count(*) as n, {_errors_sql('rssi_pred', 'rssi', 'rssi')} from feats, {_POPS} group by pop")
def a02_errors_by_population(spark, sf):
    return populations(features(spark, sf)).groupBy("pop").agg(F.count("*").alias("n"), *_errors("rssi_pred", "rssi", "rssi"))


@query(f"{_FEATS} select block_id, round(sum(abs(rssi_pred - rssi)), 4) as s, count(*) as m from feats group by 1")
def a11_block_sums(spark, sf):
    return features(spark, sf).groupBy("block_id").agg(_r(F.sum(F.abs(F.col("rssi_pred") - F.col("rssi"))), 4).alias("s"), F.count("*").alias("m"))


@query(f"{_ROLED}, b as (select block_id, sum(abs(rssi_pred - rssi)) as s, count(*) as m from feats group by 1), f as (select seed, block_id, (pos - 1) // 6 as fold from draws), g as (select seed, fold, sum(s) as s, sum(m) as m from b join f using (block_id) group by 1, 2) select seed, count(*) as folds, round(sum(s) / sum(m), 6) as pooled, round(min(s / m), 6) as least, round(max(s / m), 6) as most from g group by 1")
def a12_fold_pooled_error(spark, sf):
    """Sums by block once, then by fold of each draw, then pooled: draws touch block rows only."""
    rows = features(spark, sf)
    blocks = rows.groupBy("block_id").agg(F.sum(F.abs(F.col("rssi_pred") - F.col("rssi"))).alias("s"), F.count("*").alias("m"))
    folds = partition.folds(draws(rows.select("block_id")), 6, exact=True)
    by_fold = folds.join(blocks, "block_id").groupBy("seed", "fold").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    each = F.col("s") / F.col("m")
    return by_fold.groupBy("seed").agg(F.count("*").alias("folds"), _r(F.sum("s") / F.sum("m")).alias("pooled"), _r(F.min(each)).alias("least"), _r(F.max(each)).alias("most"))


@query(
    f"{_FEATS} select count(*) as n, {_errors_sql('rssi_pred', 'rssi', 'all')}, {_errors_sql('rssi_pred', 'rssi', 'dense', 'ndvi > 0.5')}, {_errors_sql('rssi_pred', 'rssi', 'bare', 'ndvi < 0.2')}, {_errors_sql('rssi_pred', 'rssi', 'water', 'ndwi > 0.3')}, {_errors_sql('rssi_pred', 'rssi', 'near', 'dist_m < 5000')}, {_errors_sql('rssi_pred', 'rssi', 'mid', 'dist_m >= 5000 and dist_m < 15000')}, {_errors_sql('rssi_pred', 'rssi', 'far', 'dist_m >= 15000')} from feats"
)
def a16_f06_segment_diagnostics(spark, sf):
    """All segments of vegetation, water and distance in one aggregation."""
    d = F.col("dist_m")
    segments = {"all": F.lit(True), "dense": F.col("ndvi") > 0.5, "bare": F.col("ndvi") < 0.2, "water": F.col("ndwi") > 0.3, "near": d < 5000, "mid": (d >= 5000) & (d < 15000), "far": d >= 15000}
    return features(spark, sf).agg(F.count("*").alias("n"), *[c for tag, where in segments.items() for c in _errors("rssi_pred", "rssi", tag, where)])


def _mixed_sql(x: str, y: str) -> str:
    return f"case when count(*) < 5 or stddev_samp({x}) < 1e-8 or stddev_samp({y}) < 1e-8 then 0.0 else greatest(-1.0, least(1.0, covar_pop({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})))) end"


#: Targets and predictions of the diagnostics beside those that features have, as SQL for either engine.
_DIAGNOSED = "*, greatest(ndvi, 0.0) * 20 as shadow, greatest(ndvi, 0.0) * 18 + slope as shadow_pred, roughness * 3 as diffr, roughness * 2.5 + tri_m / 100 as diffr_pred, case when node_id % 3 = 0 then 1e0 else 0e0 end as has_lidar, 1 - (b02 + b03 + b04) / 3 as shade, abs(pl_pred - path_loss) as pl_err, abs(rssi_pred - rssi) as rssi_err, 20 * log10(greatest(dist_m / 1000.0, 0.001)) + 20 * log10(1800.0) + 32.44 as fs"
_RINGS = {"near": "dist_m < 5000", "mid": "dist_m >= 5000 and dist_m < 15000", "far": "dist_m >= 15000"}
_COVERS = {"vegetation": "ndvi > 0.5", "open_area": "ndvi < 0.2", "water": "ndwi > 0.3"}
_THRESHOLDS = (85, 90, 95, 100)
_CORRELATED = {"dist_rssi": ("dist_m", "rssi_err"), "elevation_pl": ("elevation", "pl_err"), "slope_pl": ("slope", "pl_err"), "ndvi_rssi": ("ndvi", "rssi_err"), "roughness_pl": ("roughness", "pl_err"), "has_lidar": ("has_lidar", "rssi_err"), "b08": ("b08", "rssi_err"), "shadow_idx_rssi": ("shade", "rssi_err")}


def _share(condition: str) -> str:
    return f"avg(case when {condition} then 1e0 else 0e0 end)"


def _diagnostics() -> dict[str, str]:
    """Every metric that is no quantile, as an aggregate that both engines read."""
    own = {
        "rssi_pred_std": "stddev_samp(rssi_pred)", "path_loss_pred_std": "stddev_samp(pl_pred)",
        "rssi_target_std": "case when stddev_samp(rssi) > 1e-8 then stddev_samp(rssi) else 1.0 end",
        "distribution_fidelity": "stddev_samp(rssi_pred) / case when stddev_samp(rssi) > 1e-8 then stddev_samp(rssi) else 1.0 end",
        "physics_fspl_compliance": _share("pl_pred >= fs"), "physics_rssi_range_ok": _share("rssi_pred >= -140 and rssi_pred <= -30"),
        "physics_distance_gradient": _mixed_sql("rssi_pred", "(-dist_m)"), "physics_shadowing_ndvi_corr": _mixed_sql("shadow_pred", "ndvi"), "physics_diffraction_roughness_corr": _mixed_sql("diffr_pred", "roughness"),
        "physics_vegetation_compliance": "avg(rssi_err) filter (where ndvi > 0.5) / (avg(rssi_err) + 1e-8)",
        "physics_path_loss_bias": "avg(pl_pred - path_loss)", "physics_rssi_bias": "avg(rssi_pred - rssi)",
        "coverage_spread": f"100 * {_share('rssi_pred > -85')} - 100 * {_share('rssi_pred > -95')}",
    }
    own |= {f"mae_ring_{tag}": f"avg(pl_err) filter (where {where})" for tag, where in _RINGS.items()}
    own |= {f"coverage_at_{t}dbm": f"100 * {_share(f'rssi_pred > -{t}')}" for t in _THRESHOLDS}
    own |= {f"corr_{name}_error": _mixed_sql(x, y) for name, (x, y) in _CORRELATED.items()}
    for tag, guess, truth in (("pl", "pl_pred", "path_loss"), ("rssi", "rssi_pred", "rssi")):
        own |= {f"{tag}_mae": f"avg(abs({guess} - {truth}))", f"{tag}_rmse": f"sqrt(avg(({guess} - {truth}) * ({guess} - {truth})))", f"{tag}_bias": f"avg({guess} - {truth})", f"{tag}_std_pred": f"stddev_samp({guess})"}
    for tag in ("shadow", "diffr"):
        own |= {f"{tag}_mae": f"avg(abs({tag}_pred - {tag}))", f"{tag}_std_pred": f"stddev_samp({tag}_pred)"}
    return own


_METRICS = _diagnostics()
_P90 = {f"p90_ring_{t}": w for t, w in _RINGS.items()} | {f"p90_{t}": w for t, w in _COVERS.items()} | {"pl_p90": "true"}
_PLACES = {"p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90}
_WIDE_SQL = ", ".join([*(f"cast({x} as double) as {name}" for name, x in _METRICS.items()), *(f"quantile_cont(rssi_pred, {q}) as rssi_pred_{name}" for name, q in _PLACES.items()), *(f"quantile_cont(pl_err, 0.9) filter (where {w}) as {name}" for name, w in _P90.items()), "quantile_cont(rssi_err, 0.9) as rssi_p90"])


@query(f"{_FEATS}, d as (select {_DIAGNOSED} from feats), w as (select {_WIDE_SQL} from d), u as (unpivot w on columns(*) into name metric value value) select metric, round(value, 5) as value from u where value is not null")
def a16_target_diagnostics(spark, sf):
    """All metrics of the five phases, a row each: one wide aggregation, and one cut for the quantiles of all segments."""
    rows = features(spark, sf).selectExpr(*_split_columns(_DIAGNOSED))
    wide = rows.agg(*[F.expr(f"cast({x} as double)").alias(name) for name, x in _METRICS.items()])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in _METRICS])).alias("m")).select("m.*")
    every = F.lit(True)
    cuts = ranks.segment_quantiles(rows, {"rssi_pred": (F.col("rssi_pred"), {"all": every}), "rssi_err": (F.col("rssi_err"), {"all": every}), "pl_err": (F.col("pl_err"), {name: F.expr(w) for name, w in _P90.items()})}, _PLACES)
    of_level = [F.struct(F.lit(f"rssi_pred_{p}").alias("metric"), F.col(p).alias("value")) for p in _PLACES]
    named = F.when(F.col("kind") == "rssi_pred", F.array(*of_level)).otherwise(F.array(F.struct(F.when(F.col("kind") == "rssi_err", "rssi_p90").otherwise(F.col("segment")).alias("metric"), F.col("p90").alias("value"))))
    quantiles = cuts.select(F.explode(named).alias("m")).select("m.*")
    return long.unionByName(quantiles).filter("value is not null").select("metric", F.round("value", 5).alias("value"))


def _split_columns(select: str) -> list[str]:
    """The select list's items; commas within brackets don't part them."""
    out, depth = [""], 0
    for c in select:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


_QS = (0.10, 0.25, 0.75, 0.90)


@query(f"{_FEATS} select is_sentinel, " + ", ".join(f"round(quantile_cont(rssi_pred, {q}) - quantile_cont(rssi, {q}), 6) as d{int(q * 100)}" for q in _QS) + ", round(stddev_samp(rssi_pred) / nullif(stddev_samp(rssi), 0), 6) as sd_ratio from feats group by 1")
def a17_distribution_fidelity(spark, sf):
    gap = [_r(F.percentile("rssi_pred", q) - F.percentile("rssi", q)).alias(f"d{int(q * 100)}") for q in _QS]
    return features(spark, sf).groupBy("is_sentinel").agg(*gap, _r(F.try_divide(F.stddev_samp("rssi_pred"), F.stddev_samp("rssi"))).alias("sd_ratio"))


@query(f"{_FEATS}, v as (select *, 20 * log10(greatest(dist_m / 1000.0, 0.001)) + 20 * log10(900.0::double) + 32.44 as fs, log10(greatest(dist_m, 1.0)) as ld from feats where not is_sentinel) select round(avg(case when pl_pred >= fs then 1.0 else 0.0 end), 6) as above_free_space, round(max(pl_pred) - min(pl_pred), 6) as spread, round({_mixed_sql('pl_pred', 'ld')}, 6) as gradient_pred, round({_mixed_sql('path_loss', 'ld')}, 6) as gradient_true, round(avg(pl_pred) filter (where ndvi > 0.5) / nullif(avg(pl_pred) filter (where ndvi < 0.2), 0), 6) as vegetation_ratio from v")
def a18_physics_metrics(spark, sf):
    """On valid nodes: share not below free space, range, gradients over log distance, vegetation ratio."""
    rows = features(spark, sf).filter("not is_sentinel").withColumns({"fs": P.free_space(F.col("dist_m"), F.lit(FREQUENCY)), "ld": F.log10(F.greatest("dist_m", F.lit(1.0)))})
    of = lambda where: F.avg(F.when(where, F.col("pl_pred")))
    return rows.agg(
        _r(F.avg(F.when(F.col("pl_pred") >= F.col("fs"), 1.0).otherwise(0.0))).alias("above_free_space"),
        _r(F.max("pl_pred") - F.min("pl_pred")).alias("spread"),
        _r(stats.pearson_mixed_divisors(F.col("pl_pred"), F.col("ld"))).alias("gradient_pred"),
        _r(stats.pearson_mixed_divisors(F.col("path_loss"), F.col("ld"))).alias("gradient_true"),
        _r(F.try_divide(of(F.col("ndvi") > 0.5), of(F.col("ndvi") < 0.2))).alias("vegetation_ratio"),
    )


_LEVELS = (-70, -85, -100)


@query(f"{_FEATS} select case when dist_m < 5000 then 'near' when dist_m < 15000 then 'mid' else 'far' end as ring, count(*) as n, round(avg(abs(rssi_pred - rssi)), 6) as mae, round(quantile_cont(abs(rssi_pred - rssi), 0.9), 6) as p90, round(max(rssi_pred) - min(rssi_pred), 6) as spread, " + ", ".join(f"round(avg(case when rssi_pred > {t} then 1.0 else 0.0 end), 6) as above_{-t}" for t in _LEVELS) + " from feats group by 1")
def a19_rings(spark, sf):
    ring = F.when(F.col("dist_m") < 5000, "near").when(F.col("dist_m") < 15000, "mid").otherwise("far")
    e = F.abs(F.col("rssi_pred") - F.col("rssi"))
    return features(spark, sf).groupBy(ring.alias("ring")).agg(F.count("*").alias("n"), _r(F.avg(e)).alias("mae"), _r(F.percentile(e, 0.9)).alias("p90"), _r(F.max("rssi_pred") - F.min("rssi_pred")).alias("spread"), *[_r(F.avg(F.when(F.col("rssi_pred") > t, 1.0).otherwise(0.0))).alias(f"above_{-t}") for t in _LEVELS])


_FEATURES = ("elevation", "slope", "ndvi", "ndwi", "tri_m", "roughness", "b02", "b08")


@query(f"{_FEATS} select is_sentinel, " + ", ".join(f"round({_mixed_sql(f, 'abs(rssi_pred - rssi)')}, 6) as r_{f}" for f in _FEATURES) + " from feats group by 1")
def a20_feature_error_correlations(spark, sf):
    e = F.abs(F.col("rssi_pred") - F.col("rssi"))
    return features(spark, sf).groupBy("is_sentinel").agg(*[_r(stats.pearson_mixed_divisors(F.col(f), e)).alias(f"r_{f}") for f in _FEATURES])


@query(f"{_FEATS} select (x_m // 3000) * 20 + y_m // 3000 as pixel, count(*) as points, round(avg(elevation), 6) as mean from feats group by 1")
def a21_points_to_pixels(spark, sf):
    return features(spark, sf).groupBy(F.expr("(x_m div 3000) * 20 + y_m div 3000").alias("pixel")).agg(F.count("*").alias("points"), _r(F.avg("elevation")).alias("mean"))


@query(f"with {PIXELS_SQL} select (row // 3) * ((width + 2) // 3) + col // 3 as parent, round(cast(sum(cents) as double) / count(*), 6) as mean from nodes cross join size1 group by 1")
def a22_block_mean(spark, sf):
    width, _, _ = raster_sizes(spark, sf)
    parent = geo.parent_pixel(F.col("row"), F.col("col"), 3, (width + 2) // 3)
    return pixels(spark, sf).groupBy(parent.alias("parent")).agg(_r(F.sum("cents").cast("double") / F.count("*")).alias("mean"))


@query(f"{_FEATS}, c as (select *, pl_pred - 60 as raw, least(250.0, greatest(60.0, pl_pred - 60)) as held from feats) select is_sentinel, count(*) as n, round(avg(case when raw < 60 or raw > 250 then 1.0 else 0.0 end), 6) as out_of_range, round(quantile_cont(abs(raw - held), 0.99), 6) as p99_excess, round(avg(abs(raw - path_loss)), 6) as mae_raw, round(avg(abs(held - path_loss)), 6) as mae_held from c group by 1")
def a26_clamp_diagnostics(spark, sf):
    """How often and how far a raw output leaves its range, and what clamping does to the error."""
    rows = features(spark, sf).withColumn("raw", F.col("pl_pred") - 60).withColumn("held", P.clip(F.col("raw"), 60, 250))
    out = (F.col("raw") < 60) | (F.col("raw") > 250)
    return rows.groupBy("is_sentinel").agg(F.count("*").alias("n"), _r(F.avg(F.when(out, 1.0).otherwise(0.0))).alias("out_of_range"), _r(F.percentile(F.abs(F.col("raw") - F.col("held")), 0.99)).alias("p99_excess"), _r(F.avg(F.abs(F.col("raw") - F.col("path_loss")))).alias("mae_raw"), _r(F.avg(F.abs(F.col("held") - F.col("path_loss")))).alias("mae_held"))


#: Where the classes 5 to 2 begin.
_CLASS_LEVELS = (-70, -85, -100, -110)
_CLASS = "case when rssi >= -70 then 5 when rssi >= -85 then 4 when rssi >= -100 then 3 when rssi >= -110 then 2 else 1 end"


@query(f"with {NODES_SQL}, {_REACH} select ant_id, count(*) as n, " + ", ".join(f"round(100.0 * count(*) filter (where {_CLASS} = {k}) / count(*), 6) as class_{k}" for k in range(1, 6)) + " from reach where rssi > -150 group by 1")
def a27_class_shares(spark, sf):
    """Shares of an antenna's nodes by class: power falls with distance, so that a class is a ring around the antenna."""
    of_power = [F.array(*[F.lit(strong_within(level, POWER - k)) for level in (*_CLASS_LEVELS, -math.inf)]) for k in range(10)]
    right = sites(spark, sf).select(F.col("ant_id").alias("key"), F.col("ax").alias("rx"), F.col("ay").alias("ry"), F.element_at(F.array(*of_power), (F.col("ant_id") % 10 + 1).cast("int")).alias("limits"))
    left = places(spark, sf).select(F.col("x_m").alias("lx"), F.col("y_m").alias("ly"))
    found = reach.counts_within(left, right, len(_CLASS_LEVELS) + 1, RADIUS_M)
    n, within = F.col("n"), lambda k: F.get("counts", F.lit(5 - k)) - (F.get("counts", F.lit(4 - k)) if k < 5 else 0)
    return found.select(F.col("key").alias("ant_id"), "counts", F.get("counts", F.lit(4)).alias("n")).select("ant_id", "n", *[_r(100.0 * within(k) / n).alias(f"class_{k}") for k in range(1, 6)])


@query("select p_size, count(*) as n from part group by 1 order by n desc, p_size limit 6")
def a28_commonest_values(spark, sf):
    """The six commonest values; a top-k report."""
    return table(spark, sf, "part").groupBy("p_size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_size").limit(6)


@query(f"{_FEATS} " + " union all ".join(f"select '{f}' as name, round(min({f}), 6) as lo, round(max({f}), 6) as hi, round(avg(case when {f} <> 0 then 1.0 else 0.0 end), 6) as nonzero, min({f}) = max({f}) as constant from feats" for f in (*_FEATURES, "is_sentinel * 0.0")).replace("'is_sentinel * 0.0'", "'zero'").replace("is_sentinel * 0.0", "cast(0 as double)"))
def a29_column_profile(spark, sf):
    """One aggregation over all columns, unpivoted to a row a column after it."""
    columns = {f: F.col(f) for f in _FEATURES} | {"zero": F.lit(0.0)}
    parts = [F.struct(F.lit(name).alias("name"), _r(F.min(c)).alias("lo"), _r(F.max(c)).alias("hi"), _r(F.avg(F.when(c != 0, 1.0).otherwise(0.0))).alias("nonzero"), (F.min(c) == F.max(c)).alias("constant")) for name, c in columns.items()]
    return features(spark, sf).agg(F.array(*parts).alias("x")).select(F.inline("x"))


@query("select o_orderpriority as grp, count(*) as files, cast(sum(o_orderkey) as bigint) as bytes from orders group by 1")
def a30_group_totals(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count("*").alias("files"), F.sum("o_orderkey").alias("bytes"))


@query(f"{_FEATS}, m as (select pop, median(rssi) as c from feats, {_POPS} group by pop) select f.pop, round(quantile_cont(rssi, 0.75) - quantile_cont(rssi, 0.25), 6) as iqr, round(stddev_pop(rssi), 6) as sd, round(avg(abs(rssi - c)), 6) as mae_median from (select rssi, pop from feats, {_POPS}) f join m on m.pop = f.pop group by f.pop")
def a31_negative_control(spark, sf):
    """Spread of the target and the error of its own median, a predictor without any input."""
    rows = populations(features(spark, sf)).select("pop", "rssi")
    centre = rows.groupBy("pop").agg(F.median("rssi").alias("c"))
    return rows.join(F.broadcast(centre), "pop").groupBy("pop").agg(_r(F.percentile("rssi", 0.75) - F.percentile("rssi", 0.25)).alias("iqr"), _r(F.stddev_pop("rssi")).alias("sd"), _r(F.avg(F.abs(F.col("rssi") - F.col("c")))).alias("mae_median"))


@query("select o_custkey % 20 as run, arg_min(o_orderkey, struct_pack(m := round(o_totalprice / 1000), e := o_orderkey)) as best_epoch, min(round(o_totalprice / 1000)) as mae from orders group by 1")
def a32_best_epoch(spark, sf):
    """The epoch of least validation error a run, the first of equals."""
    mae = F.round(F.col("o_totalprice") / 1000)
    return table(spark, sf, "orders").groupBy((F.col("o_custkey") % 20).alias("run")).agg(F.min_by("o_orderkey", F.struct(mae, F.col("o_orderkey"))).alias("best_epoch"), F.min(mae).alias("mae"))


# ---- ranks and order statistics ------------------------------------------------------------------


@query(f"{_FEATS}, r as (select block_id, row_number() over (partition by block_id order by rssi, node_id) as a, row_number() over (partition by block_id order by rssi_pred, node_id) as b from feats) select block_id, count(*) as n, round(case when count(*) >= 3 then corr(a, b) end, 6) as rho from r group by 1")
def w03_e16_ordinal_spearman(spark, sf):
    """Correlation of ordinal ranks; ties get different ranks, in order of node."""
    rank = lambda c: F.row_number().over(Window.partitionBy("block_id").orderBy(c, "node_id")).cast("double")
    ranked = features(spark, sf).select("block_id", rank("rssi").alias("a"), rank("rssi_pred").alias("b"))
    return ranked.groupBy("block_id").agg(F.count("*").alias("n"), _r(stats.pearson(F.col("a"), F.col("b"))).alias("rho"))


@query("with d as (select o_custkey % 25 as run, o_orderkey // 25 as draw, bool_and(o_orderstatus <> 'P' or o_orderkey % 3 > 0) as done from orders group by 1, 2), f as (select run, min(draw) filter (where not done) as gap from d group by 1) select d.run, cast(count(*) filter (where f.gap is null or d.draw < f.gap) as bigint) as prefix from d join f using (run) group by 1")
def w04_complete_prefix(spark, sf):
    """How many draws are complete before a run's first gap: two aggregations, no running window."""
    done = F.bool_and((F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 3 > 0))
    rows = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 25).alias("run"), F.floor(F.col("o_orderkey") / 25).alias("draw")).agg(done.alias("done"))
    gap = rows.groupBy("run").agg(F.min(F.when(~F.col("done"), F.col("draw"))).alias("gap"))
    return rows.join(gap, "run").groupBy("run").agg(F.count_if(F.col("gap").isNull() | (F.col("draw") < F.col("gap"))).alias("prefix"))


@query(f"{_FEATS}, r as (select block_id, rssi_pred, row_number() over (partition by block_id order by rssi_pred) as k, count(*) over (partition by block_id) as n from feats) select block_id, max(rssi_pred) filter (where k = cast(floor(0.3::double * (n - 1)) as bigint) + 1) as lower, max(rssi_pred) filter (where k = cast(ceil(0.3::double * (n - 1)) as bigint) + 1) as higher from r group by 1")
def w05_quantile_lower_higher(spark, sf):
    """The order statistics on both sides of a quantile; neither interpolates."""
    by = Window.partitionBy("block_id")
    ranked = features(spark, sf).select("block_id", "rssi_pred", F.row_number().over(by.orderBy("rssi_pred")).alias("k"), F.count("*").over(by).alias("n"))
    at = lambda f: F.max(F.when(F.col("k") == f(F.lit(0.3) * (F.col("n") - 1)) + 1, F.col("rssi_pred")))
    return ranked.groupBy("block_id").agg(at(F.floor).alias("lower"), at(F.ceil).alias("higher"))


@query(f"{_FEATS}, b as (select block_id, sum(rssi_pred - rssi) as s, count(*) as m from feats group by 1), t as (select sum(s) as s, sum(m) as m from b) select block_id, round((t.s - b.s) / (t.m - b.m), 6) as without from b, t")
def w06_leave_one_out(spark, sf):
    """The mean without each block: totals minus its own."""
    own = features(spark, sf).groupBy("block_id").agg(F.sum(F.col("rssi_pred") - F.col("rssi")).alias("s"), F.count("*").alias("m"))
    total = own.agg(F.sum("s").alias("ts"), F.sum("m").alias("tm"))  # one row
    return own.join(F.broadcast(total)).select("block_id", _r((F.col("ts") - F.col("s")) / (F.col("tm") - F.col("m"))).alias("without"))


@query("with t as (select c_nationkey as nation, count(*) as blocks from customer group by 1), c as (select nation, m, n, abs(m * n - blocks) as off, abs(m - n) as skew from t, range(4, 40) a(m), range(4, 40) b(n)) select nation, cast(arg_min(m, struct_pack(off := off, skew := skew, m := m)) as bigint) as m, cast(arg_min(n, struct_pack(off := off, skew := skew, m := m)) as bigint) as n from c group by nation")
def w07_best_lattice(spark, sf):
    """Of all m x n lattices that nearest to a number of blocks, here a nation's customers, the squarest of equals."""
    sizes = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("blocks"))
    side = F.sequence(F.lit(4).cast("bigint"), F.lit(39).cast("bigint"))
    both = sizes.withColumn("m", F.explode(side)).withColumn("n", F.explode(side))
    rank = F.struct(F.abs(F.col("m") * F.col("n") - F.col("blocks")), F.abs(F.col("m") - F.col("n")), F.col("m"))
    return both.groupBy("nation").agg(F.min_by("m", rank).alias("m"), F.min_by("n", rank).alias("n"))


@query("select distinct p_size from part order by p_size limit 20")
def w08_first_distinct_values(spark, sf):
    return table(spark, sf, "part").select("p_size").distinct().orderBy("p_size").limit(20)


# ---- losses as aggregates ------------------------------------------------------------------------


@query(f"{_FEATS} select is_sentinel, round(avg(case when abs(rssi_pred - rssi) <= 5 then 0.5 * (rssi_pred - rssi) * (rssi_pred - rssi) else 5.0 * (abs(rssi_pred - rssi) - 2.5) end), 6) as huber, round(avg(greatest(0.0, 20 * log10(greatest(dist_m / 1000.0, 0.001)) + 20 * log10(900.0::double) + 32.44 - pl_pred)), 6) as below_free_space, round(greatest(0.0, var_samp(rssi) - var_samp(rssi_pred)), 6) as variance_lost from feats group by 1")
def m1_loss_terms(spark, sf):
    """Huber's loss, the hinge below free space, and lost variance."""
    e = F.col("rssi_pred") - F.col("rssi")
    hinge = F.greatest(F.lit(0.0), P.free_space(F.col("dist_m"), F.lit(FREQUENCY)) - F.col("pl_pred"))
    return features(spark, sf).groupBy("is_sentinel").agg(_r(F.avg(stats.huber(e))).alias("huber"), _r(F.avg(hinge)).alias("below_free_space"), _r(F.greatest(F.lit(0.0), F.var_samp("rssi") - F.var_samp("rssi_pred"))).alias("variance_lost"))
