"""Scoring by a stored model, calibration of several models, tallies and guarded correlations."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.fixtures import FEATURES_SQL, FREQUENCY, features, nodes
from quadrille.functions import propagation as P
from quadrille.functions import stats
from quadrille.operators import ranks, scoring, solve
from quadrille.operators.shared import materialise
from quadrille.plans.base import query
from quadrille.plans.blocks import _DRIFT, _TRIM, _kept, drift, levels, populations, tested, trained
from quadrille.plans.scalar import _COST, _FRESNEL, _HATA, _KNIFE, _diffraction_sql

#: A linear model of the received power: fixed, as the query's rows must be.
WEIGHTS = {"elevation": 0.25, "slope": -3.5, "ndvi": 1.75, "tri_m": -0.0625}
INTERCEPT = -95.5


def _load(content: bytes) -> tuple[np.ndarray, float]:
    model = json.loads(content)
    return np.array([model["weights"][c] for c in model["columns"]]), model["intercept"]


def _predict(model: tuple[np.ndarray, float], x: np.ndarray) -> np.ndarray:
    return x @ model[0] + model[1]


_LINEAR = " + ".join(f"{w}::double * {c}" for c, w in WEIGHTS.items())


@query(f"with {FEATURES_SQL}, f as (select node_id, case when node_id % 7 = 0 then null else ndvi end as ndvi, elevation, slope, tri_m from feats) select node_id, round({INTERCEPT}::double + {_LINEAR}, 6) as score from f")
def m02_scoring_hook(spark, sf):
    """Every node by a linear model from the shared folder; a row with an unknown feature has no score."""
    path, digest = scoring.publish(spark, json.dumps({"columns": list(WEIGHTS), "weights": WEIGHTS, "intercept": INTERCEPT}).encode())
    rows = features(spark, sf).withColumn("ndvi", F.when(F.col("node_id") % 7 != 0, F.col("ndvi"))).select("node_id", *WEIGHTS)
    return scoring.score(rows, list(WEIGHTS), path, digest, _load, _predict).select("node_id", F.round("score", 6).alias("score"))


_LOSSES = f"""f0 as (select node_id, block_id, rssi, is_sentinel, dist_m, 900.0::double as f, 3.2 * pow(log10(11.75 * 1.5::double), 2) - 4.97 as a from nodes),
ml as (select *, 'fspl' as model, 20 * log10(greatest(dist_m / 1000.0, 0.001)) + 20 * log10(f) + 32.44 as pl from f0 union all select *, 'hata_rural', {_HATA} - 4.78 * pow(log10(f), 2) + 18.33 * log10(f) - 40.94 from f0 union all select *, 'cost231_suburban', {_COST} from f0),
cal3 as (select seed, model, median(round(rssi + pl, 6)) as oa, median(round(rssi + pl, 6)) filter (where not is_sentinel) as ob from ml join roles using (block_id) where role = 'train' group by 1, 2),
te3 as (select k.seed, m.model, pop, m.rssi, m.pl from kept k join ml m using (node_id), (select unnest(['valid', 'sentinel', 'all']) as pop) where k.kept and k.role = 'test' and (pop = 'all' or (pop = 'valid') = (not m.is_sentinel)))"""


def model_losses(rows: DataFrame) -> DataFrame:
    """Each row once a model, with the model's loss ``pl`` at its distance."""
    d, f, high, low = F.col("dist_m"), F.lit(FREQUENCY), F.lit(30.0), F.lit(1.5)
    losses = {"fspl": P.free_space(d, f), "hata_rural": P.hata_large_city(d, f, high, low, "rural"), "cost231_suburban": P.cost231(d, f, high, low, False)}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), loss.alias("pl")) for name, loss in losses.items()]))
    return rows.withColumn("m", each).select(*rows.columns, "m.model", "m.pl")


@query(f"with {_TRIM}, {_LOSSES} select seed, model, pop, count(*) as n, round(any_value(oa), 6) as offset_all, round(any_value(ob), 6) as offset_valid, round(avg(abs(oa - pl - rssi)), 4) as mae_all, round(avg(abs(ob - pl - rssi)), 4) as mae_valid from te3 join cal3 using (seed, model) group by 1, 2, 3")
def a04_calibration_of_models(spark, sf):
    """Median offsets of three models from all and from valid training nodes, and the errors that follow."""
    rows = levels(spark, sf)
    level = F.round(F.col("rssi") + F.col("pl"), 6)
    key = ["seed", "model"]
    kinds = F.explode(F.array(F.struct(F.lit("oa").alias("kind"), level.alias("x")), F.struct(F.lit("ob").alias("kind"), F.when(~F.col("is_sentinel"), level).alias("x"))))
    middles = ranks.drawn_values(model_losses(rows).select("block_id", "model", kinds.alias("v")).select("block_id", "model", "v.*"), trained(rows), ["model", "kind"], "x")
    offsets = middles.groupBy(*key).agg(*[F.max(F.when(F.col("kind") == k, F.col("x"))).alias(k) for k in ("oa", "ob")])
    test = model_losses(tested(rows))
    miss = lambda o: F.avg(F.abs(F.col(o) - F.col("pl") - F.col("rssi")))
    found = populations(test).join(F.broadcast(offsets), key).groupBy(*key, "pop").agg(F.count("*").alias("n"), F.max("oa").alias("oa"), F.max("ob").alias("ob"), miss("oa").alias("ma"), miss("ob").alias("mb"))
    return found.select(*key, "pop", "n", F.round("oa", 6).alias("offset_all"), F.round("ob", 6).alias("offset_valid"), F.round("ma", 4).alias("mae_all"), F.round("mb", 4).alias("mae_valid"))


@query(f"with {_DRIFT}, t as (select seed, max(round(mae_constant, 9)) filter (where pop = 'valid') as cv, max(round(mae_all, 9)) filter (where pop = 'valid') as av, max(round(mae_valid, 9)) filter (where pop = 'valid') as bv, max(round(mae_constant, 9)) filter (where pop = 'all') as ct, max(round(mae_all, 9)) filter (where pop = 'all') as att, max(round(mae_valid, 9)) filter (where pop = 'all') as bt from drift group by seed) select count(*) as nv, count(*) filter (where av < cv) as fa, count(*) filter (where bv < cv) as fb, count(*) filter (where ct < att) as ca, count(*) filter (where ct < bt) as cb from t where cv is not null and av is not null and bv is not null")
def a07_inversion_tally(spark, sf):
    """Draws with valid nodes; those where free space wins on them, by either calibration; those where the constant wins on all."""
    of = lambda name, pop: F.max(F.when(F.col("pop") == pop, F.round(name, 9)))
    draws = drift(spark, sf).groupBy("seed").agg(*[of(f"mae_{k}", pop).alias(f"{t}{pop[0]}") for pop in ("valid", "all") for t, k in (("c", "constant"), ("a", "all"), ("b", "valid"))])
    known = draws.filter("cv is not null and av is not null and bv is not null")
    return known.agg(F.count("*").alias("nv"), F.count_if(F.expr("av < cv")).alias("fa"), F.count_if(F.expr("bv < cv")).alias("fb"), F.count_if(F.expr("ca < aa")).alias("ca"), F.count_if(F.expr("ca < ba")).alias("cb"))


@query(f"with {FEATURES_SQL} select block_id, is_sentinel, count(*) as n, case when count(*) >= 3 and var_pop(rssi) > 0 and var_pop(rssi_pred) > 0 then round(corr(rssi, rssi_pred), 6) end as r from feats group by 1, 2")
def e16_guarded_pearson(spark, sf):
    """Correlation a block and kind; null for few nodes or a constant level, as all sentinels have."""
    return features(spark, sf).groupBy("block_id", "is_sentinel").agg(F.count("*").alias("n"), F.round(stats.pearson(F.col("rssi"), F.col("rssi_pred")), 6).alias("r"))


@query(f"with {_TRIM}, c as (select k.seed, cast(sum(x_m) as double) / count(*) as cx, cast(sum(y_m) as double) / count(*) as cy, count(*) as n from kept k join nodes n using (node_id) where kept and k.role = 'test' group by 1) select a.seed as s1, b.seed as s2, round(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)), 6) as drift from c a join c b on a.seed < b.seed")
def e34_centroid_drift(spark, sf):
    """How far apart the centroids of two draws' kept test nodes are; the pairs are of draws."""
    rows = nodes(spark, sf).select("node_id", "x_m", "y_m")
    mean = lambda c: F.sum(c).cast("double") / F.count("*")
    found = materialise(_kept(spark, sf).filter("kept and role = 'test'").join(rows, "node_id").groupBy("seed").agg(mean("x_m").alias("cx"), mean("y_m").alias("cy")), "centroids")
    a, b = found.alias("a"), found.alias("b")
    step = lambda c: (F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}"))
    return a.join(b, F.col("a.seed") < F.col("b.seed")).select(F.col("a.seed").alias("s1"), F.col("b.seed").alias("s2"), F.round(F.sqrt(step("cx") + step("cy")), 6).alias("drift"))


_TRI_STD = 25.0
_RESPONSE = f"least(40.0, greatest(0.0, {_KNIFE}))"


@query(f"with recursive {FEATURES_SQL}, dif as ({_diffraction_sql('tri_m', 'roughness')}), t as (select block_id, tri_m / {_TRI_STD}::double as z, roughness, dist_m, loss as target from feats join dif using (node_id) where loss > 0 and loss < 39.9), b(i, block_id, lo, hi) as (select 0, block_id, 0.001::double, 5000.0::double from (select distinct block_id from t) union all select i + 1, block_id, case when m < w then (lo + hi) / 2 else lo end, case when m < w then hi else (lo + hi) / 2 end from (select i, block_id, lo, hi, avg({_RESPONSE}) as m, avg(target) as w from (select b.i, b.block_id, b.lo, b.hi, target, {_FRESNEL.format(tri='z * (b.lo + b.hi) / 2', rough='roughness')} as v from b join t on t.block_id = b.block_id where b.i < 60) group by 1, 2, 3, 4)) select block_id, round((lo + hi) / 2, 4) as c from b where i = 60")
def e39_recovered_scale(spark, sf):
    """The deviation by which roughness was divided, a block: the one that gives the known mean diffraction again."""
    known = P.diffraction(F.col("tri_m"), F.col("roughness"), F.col("dist_m"), 1800.0)
    rows = features(spark, sf).select("block_id", (F.col("tri_m") / _TRI_STD).alias("z"), "roughness", "dist_m", known.alias("target")).filter("target > 0 and target < 39.9")
    again = lambda c: P.diffraction(F.col("z") * c, F.col("roughness"), F.col("dist_m"), 1800.0)
    return solve.recovered(materialise(rows, "responding"), ["block_id"], again, "target", 0.001, 5000.0).select("block_id", F.round("c", 4).alias("c"))
