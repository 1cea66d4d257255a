"""Variance components, contrasts and closed forms: over repeated runs, over draws, and by formula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.fixtures import BLOCK_M, BUFFER_M, NODES_SQL, draws, nodes, places, table
from quadrille.functions import design
from quadrille.operators import buffer, partition
from quadrille.operators.shared import materialise
from quadrille.plans.base import query
from quadrille.plans.blocks import _BASE, _DRIFT, _PAIRS, _roles, calibration, drift, levels, tested

#: Runs of two models in four cells: five draws with three seeds each.
_RUNS = "runs as (select l_partkey % 4 as cell, case when l_orderkey % 2 = 0 then 'graph' else 'perceptron' end as model, l_suppkey % 5 as draw, l_linenumber % 3 as seed, avg(l_quantity) as err from lineitem group by 1, 2, 3, 4)"


def _runs(spark, sf) -> DataFrame:
    model = F.when(F.col("l_orderkey") % 2 == 0, "graph").otherwise("perceptron")
    return table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 4).alias("cell"), model.alias("model"), (F.col("l_suppkey") % 5).alias("draw"), (F.col("l_linenumber") % 3).alias("seed")).agg(F.avg("l_quantity").alias("err"))


def _rounded(*columns: str, digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


@query(f"with {_RUNS}, a as (select cell, model, stddev_samp(err) filter (where seed = 0) as sd_draws, stddev_samp(err) filter (where draw = 0) as sd_seeds from runs group by 1, 2) select cell, model, round(sd_draws, 6) as sd_draws, round(sd_seeds, 6) as sd_seeds, round(sd_draws / nullif(sd_seeds, 0), 6) as ratio from a")
def e12_draws_against_seeds(spark, sf):
    """The deviation over draws of one seed against that over seeds of one draw; null if the latter is 0."""
    of = lambda c: F.stddev_samp(F.when(c, F.col("err")))
    found = _runs(spark, sf).groupBy("cell", "model").agg(of(F.col("seed") == 0).alias("sd_draws"), of(F.col("draw") == 0).alias("sd_seeds"))
    return found.withColumn("ratio", F.try_divide("sd_draws", "sd_seeds")).select("cell", "model", *_rounded("sd_draws", "sd_seeds", "ratio"))


@query(f"with {_RUNS}, d as (select cell, model, draw, avg(err) as mu, count(*) as k, var_pop(err) * count(*) as ss from runs group by 1, 2, 3), q as (select cell, model, count(*) as n, max(k) as k, max(k) * var_samp(mu) as between_ms, sum(ss) / (count(*) * (max(k) - 1)) as within_ms from d group by 1, 2) select cell, model, n, k, round(between_ms, 6) as between_ms, round(within_ms, 6) as within_ms, round((between_ms - within_ms) / k, 6) as raw_draw_variance, round(greatest(0, (between_ms - within_ms) / k), 6) as draw_variance, greatest(0, (between_ms - within_ms) / k) >= within_ms as draw_not_less from q")
def e13_nested_variance(spark, sf):
    """Variance between draws and between seeds within a draw; draws without exactly three seeds are an error."""
    draws = _runs(spark, sf).groupBy("cell", "model", "draw").agg(F.avg("err").alias("mu"), F.count("*").alias("k"), (F.var_pop("err") * F.count("*")).alias("ss"))
    sums = draws.groupBy("cell", "model").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("k"), F.var_samp("mu").alias("v"), F.sum("ss").alias("ss"))
    checked = sums.withColumn("k", F.when((F.col("least") == 3) & (F.col("k") == 3), F.col("k")).otherwise(F.raise_error(F.lit("each draw needs three seeds"))))
    squares = checked.select("cell", "model", "n", "k", (F.col("k") * F.col("v")).alias("between_ms"), (F.col("ss") / (F.col("n") * (F.col("k") - 1))).alias("within_ms"))
    raw = (F.col("between_ms") - F.col("within_ms")) / F.col("k")
    found = squares.withColumns({"raw_draw_variance": raw, "draw_variance": F.greatest(F.lit(0.0), raw)})
    return found.select("cell", "model", "n", "k", *_rounded("between_ms", "within_ms", "raw_draw_variance", "draw_variance"), (F.col("draw_variance") >= F.col("within_ms")).alias("draw_not_less"))


@query(f"with {_RUNS}, r as (select cell, model, draw, avg(err) as mu from runs group by 1, 2, 3), c as (select cell, model, seed, avg(err) as mu from runs group by 1, 2, 3), s as (select cell, model, count(distinct draw) as a, count(distinct seed) as b, var_pop(err) * count(*) as ss_all from runs group by 1, 2), x as (select s.*, b * (select var_pop(mu) * count(*) from r where r.cell = s.cell and r.model = s.model) as ss_d, a * (select var_pop(mu) * count(*) from c where c.cell = s.cell and c.model = s.model) as ss_s from s), m as (select *, ss_d / (a - 1) as ms_d, ss_s / (b - 1) as ms_s, (ss_all - ss_d - ss_s) / ((a - 1) * (b - 1)) as ms_r from x) select cell, model, round(ms_d, 6) as ms_draw, round(ms_s, 6) as ms_seed, round(ms_r, 6) as ms_rest, round(greatest(0, (ms_d - ms_r) / b), 6) as draw_variance, round(greatest(0, (ms_s - ms_r) / a), 6) as seed_variance from m")
def e14_two_way_variance(spark, sf):
    """Draws and seeds crossed, one run each: mean squares and variance components, cut off at 0."""
    runs = materialise(_runs(spark, sf), "runs")
    side = lambda by, name: runs.groupBy("cell", "model", by).agg(F.avg("err").alias("mu")).groupBy("cell", "model").agg((F.var_pop("mu") * F.count("*")).alias(name), F.count("*").alias(f"n_{by}"))
    total = runs.groupBy("cell", "model").agg((F.var_pop("err") * F.count("*")).alias("ss_all"))
    a, b = F.col("n_draw"), F.col("n_seed")
    both = total.join(side("draw", "ss_d"), ["cell", "model"]).join(side("seed", "ss_s"), ["cell", "model"]).withColumns({"ss_d": b * F.col("ss_d"), "ss_s": a * F.col("ss_s")})
    squares = both.withColumns({"ms_draw": F.col("ss_d") / (a - 1), "ms_seed": F.col("ss_s") / (b - 1), "ms_rest": (F.col("ss_all") - F.col("ss_d") - F.col("ss_s")) / ((a - 1) * (b - 1))})
    part = lambda ms, n: F.greatest(F.lit(0.0), (F.col(ms) - F.col("ms_rest")) / n)
    return squares.withColumns({"draw_variance": part("ms_draw", b), "seed_variance": part("ms_seed", a)}).select("cell", "model", *_rounded("ms_draw", "ms_seed", "ms_rest", "draw_variance", "seed_variance"))


@query(f"with {_RUNS}, t as (select cell, stddev_samp(err) filter (where model = 'perceptron') as sd_p, stddev_samp(err) filter (where model = 'graph') as sd_g from runs where seed = 0 group by 1), c as (select g.cell, count(*) as pairs, avg(g.err - p.err) as contrast from runs g join runs p on g.cell = p.cell and g.draw = p.draw and g.seed = p.seed where g.seed = 0 and g.model = 'graph' and p.model = 'perceptron' group by 1) select cell, pairs, case when sd_p >= 2.0 then 'perceptron' else 'graph' end as tolerance_of, round(case when sd_p >= 2.0 then sd_p else sd_g end, 6) as tolerance, round(contrast, 6) as contrast, abs(contrast) <= case when sd_p >= 2.0 then sd_p else sd_g end as parity from c join t using (cell)")
def e36_paired_contrast(spark, sf):
    """Graph less perceptron by draw, against a tolerance fixed by the perceptron's own spread, or the graph's if that is below the floor."""
    return design.paired_contrast(_runs(spark, sf).filter("seed = 0"), "graph", "perceptron", 2.0).select("cell", "pairs", "tolerance_of", *_rounded("tolerance", "contrast"), "parity")


@query(f"with {_RUNS}, s as (select cell, model, stddev_samp(err) filter (where seed = 0) as d, stddev_samp(err) filter (where draw = 0) as s from runs group by 1, 2), c as (select cell, min(d / s) as lo, max(d / s) as hi from s group by 1), n as (select count(*) as n, case when count(*) = 4 then 3 else count(*) end as t, count(*) filter (where lo >= 3) as strong, count(*) filter (where hi < 2) as weak, count(*) filter (where lo < 3 and hi >= 2) as between_n from c) select n, t, strong, weak, between_n, case when strong >= t then 'reinforces' when weak >= t then 'delimits' else 'partial' end as branch from n")
def e37_branch(spark, sf):
    """Cells by the ratio of both models' draw and seed spreads, counted against the threshold of three cells of four."""
    of = lambda c: F.stddev_samp(F.when(c, F.col("err")))
    ratios = _runs(spark, sf).groupBy("cell", "model").agg(F.try_divide(of(F.col("seed") == 0), of(F.col("draw") == 0)).alias("r"))
    return design.branch(ratios.groupBy("cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi")))


@query(f"with {_DRIFT}, w as (select v.seed, cast(v.n as double) / a.n as x, v.mae_constant as y, cast(v.n as double) / a.n * v.mae_constant as z from drift v join drift a on a.seed = v.seed where v.pop = 'valid' and a.pop = 'all'), q as (select count(*) as draws, var_pop(z) as vz, avg(y) * avg(y) * var_pop(x) as comp, avg(x) * avg(x) * var_pop(y) as cond from w) select draws, round(vz, 6) as variance, round(comp / nullif(vz, 0), 6) as composition, round(cond / nullif(vz, 0), 6) as conditional, round((vz - comp - cond) / nullif(vz, 0), 6) as remainder from q")
def e17_variance_of_product(spark, sf):
    """Share of valid nodes times their error: how much of the product's variance over draws each factor makes."""
    rows = drift(spark, sf).groupBy("seed").agg(*[F.max(F.when(F.col("pop") == p, F.col(c))).alias(a) for p, c, a in (("valid", "n", "nv"), ("all", "n", "na"), ("valid", "mae_constant", "y"))]).filter("nv > 0")
    x, y = F.col("nv") / F.col("na"), F.col("y")
    sums = rows.select(x.alias("x"), y.alias("y")).agg(F.count("*").alias("draws"), F.var_pop(F.col("x") * F.col("y")).alias("variance"), (F.avg("y") * F.avg("y") * F.var_pop("x")).alias("comp"), (F.avg("x") * F.avg("x") * F.var_pop("y")).alias("cond"))
    v = F.col("variance")
    return sums.select("draws", F.round(v, 6).alias("variance"), F.round(F.try_divide("comp", v), 6).alias("composition"), F.round(F.try_divide("cond", v), 6).alias("conditional"), F.round(F.try_divide(v - F.col("comp") - F.col("cond"), v), 6).alias("remainder"))


@query(f"with {_DRIFT}, m as (select seed, median(rssi) as mv from nodes join roles using (block_id) where role = 'train' and not is_sentinel group by 1), l as (select seed, c0 as name, cast(c0 as double) as level from cal, (select unnest(['-100', '-110', '-120', '-130']) as c0) union all select seed, 'valid median', mv from m union all select seed, 'median', c from cal) select l.seed, name, round(avg(abs(level - rssi)), 4) as mae from l join te on te.seed = l.seed where te.pop = 'valid' group by 1, 2")
def e10_level_sensitivity(spark, sf):
    """Errors on valid test nodes if the constant were another sentinel level, or refitted on valid training nodes."""
    rows = levels(spark, sf)
    middles = materialise(calibration(rows), "calibration")
    whole = middles.select("seed", F.lit("median").alias("name"), F.col("c").alias("level"))
    valid = middles.filter("cv is not null").select("seed", F.lit("valid median").alias("name"), F.col("cv").alias("level"))
    fixed = F.explode(F.array(*[F.struct(F.lit(str(c)).alias("name"), F.lit(float(c)).alias("level")) for c in (-100, -110, -120, -130)]))
    guesses = whole.unionByName(valid).unionByName(whole.select("seed", fixed.alias("x")).select("seed", "x.*"))
    test = tested(rows).filter("not is_sentinel").select("seed", "rssi")
    return test.join(F.broadcast(guesses), "seed").groupBy("seed", "name").agg(F.round(F.avg(F.abs(F.col("level") - F.col("rssi"))), 4).alias("mae"))


_NEAR = f"{_BASE},{_PAIRS}, near as (select n.node_id, coalesce(q.m, 0) as m from nodes n left join (select i, count(distinct bj) as m from pairs group by i) q on q.i = n.node_id)"


@query(f"with {_NEAR}, c as (select m, count(*) as nodes, any_value(k.n) as n, any_value(k.n - n_tr - n_va) as te, any_value(n_tr) as tr from near, cuts k, cut2 group by m), p as (select *, list_transform(range(m), lambda i: (te - 1.0::double - i) / (n - 1 - i)) as lo, list_transform(range(m), lambda i: (n - 1.0::double - tr - i) / (n - 1 - i)) as hi from c) select m, nodes, n, te, tr, round(case when m > te - 1 then 0.0 else coalesce(list_product(lo), 1.0) end, 12) as lo, round(case when m > n - 1 - tr then 0.0 else coalesce(list_product(hi), 1.0) end, 12) as hi from p")
def e22_inclusion_bounds(spark, sf):
    """Bounds of a node's inclusion if its m near blocks must all be in the test, or none in training, by the blocks there are."""
    rows = materialise(places(spark, sf).select("node_id", "block_id", "x_m", "y_m"), "places")
    near = rows.select("node_id").join(buffer.near_blocks(rows, BUFFER_M).select("node_id", F.size("nbr_blocks").cast("bigint").alias("m")), "node_id", "left").fillna(0, "m")
    tr, va = partition.role_counts(F.col("n"))
    cuts = rows.agg(F.count_distinct("block_id").alias("n")).select("n", (F.col("n") - tr - va).cast("bigint").alias("te"), tr.cast("bigint").alias("tr"))
    by_count = near.groupBy("m").agg(F.count("*").alias("nodes")).join(F.broadcast(cuts))
    lo, hi = design.inclusion_bounds(F.col("m"), F.col("n"), F.col("te"), F.col("tr"))
    return by_count.select("m", "nodes", "n", "te", "tr", F.round(lo, 12).alias("lo"), F.round(hi, 12).alias("hi"))


_STEPS = "(values (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) d(dx, dy)"
_GRID = f"""{_BASE}, nb as (select r.seed, r.block_id, count(*) as n, count(*) filter (where o.role <> 'train') as spare from roles r cross join {_STEPS} join roles o on o.seed = r.seed and o.block_id // 6 = r.block_id // 6 + dx and o.block_id % 6 = r.block_id % 6 + dy where r.role = 'test' group by 1, 2),
g as (select seed, block_id, {BLOCK_M / 1000}::double as g, k / 2.0::double as b, cast(spare as double) / n as q from nb, range(1, 6) s(k))"""


def _grid(spark, sf) -> DataFrame:
    """(seed, block_id, g, b, q): each test block with the share of the blocks around it that don't train, for several buffers."""
    roles = partition.roles(draws(places(spark, sf).select("block_id"))).withColumns({"x": F.expr("block_id div 6"), "y": F.col("block_id") % 6})
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    moved = roles.filter("role = 'test'").withColumn("s", around).select("seed", "block_id", (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"))
    share = moved.join(roles.select("seed", "x", "y", "role"), ["seed", "x", "y"]).groupBy("seed", "block_id").agg((F.count_if(F.col("role") != "train").cast("double") / F.count("*")).alias("q"))
    return share.select("seed", "block_id", F.lit(BLOCK_M / 1000).alias("g"), F.explode(F.array(*[F.lit(k / 2) for k in range(1, 6)])).alias("b"), "q")


@query(f"with {_GRID} select seed, block_id, b, round(q, 9) as q, round(((g - 2 * b) * (g - 2 * b) + 4 * b * (g - 2 * b) * q + 4 * b * b * (1 - pi() / 4) * q * q + pi() * b * b * q * q * q) / (g * g), 9) as retention from g")
def e25_retention_law(spark, sf):
    """Closed form of the share that trimming leaves of a block, if each neighbour spares it with probability q."""
    return _grid(spark, sf).select("seed", "block_id", "b", F.round("q", 9).alias("q"), F.round(design.retention(F.col("g"), F.col("b"), F.col("q")), 9).alias("retention"))


_BIT = lambda k: f"((s >> {k}) & 1)"
_CORNER = " + ".join(f"{_BIT(d)} * (1 - {_BIT(x)}) * (1 - {_BIT(y)})" for d, x, y in ((4, 0, 2), (5, 1, 2), (6, 0, 3), (7, 1, 3)))


@query(f"with {_GRID}, s as (select s, cast({' + '.join(_BIT(k) for k in range(8))} as integer) as n, (g - b * ({_BIT(0)} + {_BIT(1)})) * (g - b * ({_BIT(2)} + {_BIT(3)})) - pi() * b * b / 4 * ({_CORNER}) as area, seed, block_id, g, b, q from range(256) r(s), g) select seed, block_id, b, round(q, 9) as q, round(sum(pow(1 - q, n) * pow(q, 8 - n) * area) / any_value(g * g), 9) as retention from s group by seed, block_id, b, q")
def e26_retention_by_states(spark, sf):
    """The same by all 256 states of the eight neighbours; a corner's quarter disc goes if its diagonal trims and both sides spare."""
    states = _grid(spark, sf).withColumn("s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint"))))
    area, p = design.state_area(F.col("s"), F.col("g"), F.col("b")), design.state_probability(F.col("s"), F.col("q"))
    return states.groupBy("seed", "block_id", "b", "q", "g").agg(F.sum(p * area).alias("kept")).select("seed", "block_id", "b", F.round("q", 9).alias("q"), F.round(F.col("kept") / (F.col("g") * F.col("g")), 9).alias("retention"))


@query(f"with {NODES_SQL} select count(*) as n, round(pow(corr(rssi, -log10(greatest(dist_m, 1.0))), 2), 6) as ceiling from nodes where not is_sentinel")
def e35_distance_ceiling(spark, sf):
    """How much of the valid nodes' variance the distance alone can tell."""
    near = -F.log10(F.greatest("dist_m", F.lit(1.0)))
    return nodes(spark, sf).filter("not is_sentinel").agg(F.count("*").alias("n"), F.round(F.pow(F.corr("rssi", near), 2), 6).alias("ceiling"))


@query(f"with {_DRIFT}, s as (select seed % 4 as cell, pop, stddev_samp(mae_constant) as sd, avg(mae_constant) as mean from drift group by 1, 2) select pop, count(*) as cells, round(avg(sd), 6) as mean_sd, round(stddev_samp(mean), 6) as sd_of_means, round(avg(sd) / nullif(stddev_samp(mean), 0), 6) as ratio from s group by 1")
def a08_spread_within_and_between(spark, sf):
    """The deviation over draws averaged over cells, against that between the cells' means; a quarter of the draws stands for a cell."""
    cells = drift(spark, sf).groupBy((F.col("seed") % 4).alias("cell"), "pop").agg(F.stddev_samp("mae_constant").alias("sd"), F.avg("mae_constant").alias("mean"))
    both = cells.groupBy("pop").agg(F.count("*").alias("cells"), F.avg("sd").alias("mean_sd"), F.stddev_samp("mean").alias("sd_of_means"))
    return both.select("pop", "cells", *_rounded("mean_sd", "sd_of_means"), F.round(F.try_divide("mean_sd", "sd_of_means"), 6).alias("ratio"))


@query(f"with {_DRIFT}, d as (select seed, avg(dist_m) as mean, greatest(stddev_samp(dist_m), 0) as sd from nodes join roles using (block_id) where role = 'train' group by 1) select r.seed, r.role, count(*) as n, round(avg((dist_m - mean) / case when sd < 1.0 then 1.0 else sd end), 6) as mean_z, round(stddev_samp((dist_m - mean) / case when sd < 1.0 then 1.0 else sd end), 6) as sd_z from nodes join roles r using (block_id) join d on d.seed = r.seed group by 1, 2")
def p24_training_standardisation(spark, sf):
    """Distances by mean and deviation of each draw's training nodes alone; deviations below 1 count as 1."""
    rows = nodes(spark, sf).select("block_id", "dist_m").join(F.broadcast(_roles(spark, sf)), "block_id")
    fit = rows.filter("role = 'train'").groupBy("seed").agg(F.avg("dist_m").alias("mean"), F.stddev_samp("dist_m").alias("sd"))
    z = (F.col("dist_m") - F.col("mean")) / F.when(F.col("sd") < 1.0, 1.0).otherwise(F.col("sd"))
    return rows.join(F.broadcast(fit), "seed").groupBy("seed", "role").agg(F.count("*").alias("n"), F.round(F.avg(z), 6).alias("mean_z"), F.round(F.stddev_samp(z), 6).alias("sd_z"))


@query("with s as (select l_suppkey % 4 as part, count(*) as edges from lineitem group by 1) select part, edges from s")
def f03_guarded_partitions(spark, sf):
    """Edges a partition; a partition without any is an error, not a small number."""
    parts = spark.range(4).withColumnRenamed("id", "part")
    edges = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4).alias("part"))
    return design.guarded_counts(parts, edges, "part", "edges")


@query("with r as (select n_nationkey as run, n_nationkey % 3 > 0 as has_log, n_nationkey % 4 > 0 as has_data, n_nationkey % 5 > 0 as same from nation) select run, has_log and has_data and same as complete from r")
def f07_complete_runs(spark, sf):
    """A run is complete if both its artefacts are there and the digest on record is the file's."""
    runs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("run"), F.sha2("n_name", 256).alias("declared"))
    logs = runs.filter("run % 3 > 0").select("run")
    data = runs.filter("run % 4 > 0").select("run", F.when(F.col("run") % 5 > 0, F.col("declared")).otherwise("").alias("sha256"))
    return design.complete_runs(runs, logs, data)


@query("select o_orderkey, regexp_replace(printf('%,d', o_orderkey * 1000 + 7), ',', ' ', 'g') as thousands, '10^' || cast(floor(log10(o_totalprice)) as integer) as power from orders where o_totalprice > 0")
def p31_thousands_and_powers(spark, sf):
    rows = table(spark, sf, "orders").filter("o_totalprice > 0")
    return rows.select("o_orderkey", design.thousands(F.col("o_orderkey") * 1000 + 7).alias("thousands"), design.power_of_ten(F.col("o_totalprice")).alias("power"))
