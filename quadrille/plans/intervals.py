"""Bootstraps, exact small samples, tables by neighbour masks, finite lattices, and digests of members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.fixtures import BLOCK_M, BUFFER_M, DRAWS_SQL, FEATURES_SQL, FREQUENCY, NODES_SQL, draws, features, nodes, places
from quadrille.functions import propagation as P
from quadrille.operators import bootstrap, buffer, digest, partition, ranks
from quadrille.operators.shared import materialise
from quadrille.plans.base import query
from quadrille.plans.blocks import _BASE, _FSPL, _PAIRS, _TRIM, _placed, trained

B = bootstrap.REPLICATES
_REPS = f"reps as (select cast(unnest(range({B})) as bigint) as rep)"


def _micro(x):
    """Decibels as whole millionths."""
    return F.round(x * 1_000_000).cast("bigint")


def _ends_sql(value: str) -> str:
    return f"stddev_samp({value}) as se, quantile_cont({value}, 0.025::double) as lo, quantile_cont({value}, 0.975::double) as hi"


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


_NODE_WEIGHT = bootstrap.weight_sql("node_id", "rep")
_BLOCK_WEIGHT = bootstrap.weight_sql("unit", "rep")
_SEED_WEIGHT = bootstrap.weight_sql("seed", "rep")


@query(f"with {NODES_SQL}, {_REPS}, r as (select block_id, rep, sum({_NODE_WEIGHT}) as w, sum({_NODE_WEIGHT} * cast(round(rssi * 1000000) as bigint)) as x from nodes, reps group by 1, 2), m as (select block_id, rep, cast(x as double) / cast(nullif(w, 0) as double) / 1000000 as v from r), s as (select block_id, {_ends_sql('v')} from m group by 1), n as (select block_id, count(*) as n, cast(sum(cast(round(rssi * 1000000) as bigint)) as double) / count(*) / 1000000 as mean from nodes group by 1) select block_id, n, round(mean, 6) as mean, round(se, 6) as se, round(lo, 6) as lo, round(hi, 6) as hi, lo > 0 or hi < 0 as excludes_zero from n join s using (block_id)")
def e18_bootstrap_of_a_mean(spark, sf):
    """Each block's mean level with a bootstrap interval over its nodes."""
    rows = nodes(spark, sf).select("block_id", "node_id", _micro(F.col("rssi")).alias("x"))
    made = bootstrap.replicate_sums(rows, ["block_id"], "node_id", ["x"])
    ends = bootstrap.spread(made, ["block_id"], F.col("x").cast("double") / F.nullif(F.col("w").cast("double"), F.lit(0.0)) / 1_000_000)
    mean = rows.groupBy("block_id").agg(F.count("*").alias("n"), (F.sum("x").cast("double") / F.count("*") / 1_000_000).alias("mean"))
    return mean.join(ends, "block_id").select("block_id", "n", *_six("mean", "se", "lo", "hi"), ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"))


_UNITS = f"""{FEATURES_SQL}, u as (
  select block_id as unit, case when is_sentinel then 'sentinel' else 'valid' end as pop, cast(sum(cast(round(abs(rssi_pred - rssi) * 1000000) as bigint)) as bigint) as s, count(*) as m from feats group by 1, 2),
{_REPS}, r as (select pop, rep, sum(w) as one, cast(sum(w * s) as bigint) as s, cast(sum(w * m) as bigint) as m, cast(sum(w * (s // m)) as bigint) as e from (select *, {_BLOCK_WEIGHT} as w from u, reps) group by 1, 2),
v as (select pop, cast(s as double) / nullif(cast(m as double), 0.0) / 1000000 as c, cast(e as double) / nullif(cast(one as double), 0.0) / 1000000 as b from r)"""


@query(f"with {_UNITS}, a as (select pop, count(*) as units, cast(sum(s) as double) / cast(sum(m) as double) / 1000000 as ratio, cast(sum(s // m) as double) / count(*) / 1000000 as mean from u group by pop), k as (select pop, {_ends_sql('c')}, stddev_samp(b) as se_mean, stddev_samp(b - c) as se_difference from v group by pop) select pop, units, round(ratio, 6) as ratio, round(se, 6) as se, round(lo, 6) as lo, round(hi, 6) as hi, round(mean, 6) as mean, round(se_mean, 6) as se_mean, round(mean - ratio, 6) as difference, round(se_difference, 6) as se_difference from a join k using (pop)")
def e19_joint_bootstrap_of_a_ratio(spark, sf):
    """Ratio of sums and mean of ratios over blocks, drawn jointly, with the error of their difference."""
    miss = _micro(F.abs(F.col("rssi_pred") - F.col("rssi")))
    units = features(spark, sf).groupBy(F.col("block_id").alias("unit"), F.when(F.col("is_sentinel"), "sentinel").otherwise("valid").alias("pop")).agg(F.sum(miss).alias("s"), F.count("*").alias("m")).withColumn("e", F.expr("s div m"))
    made = bootstrap.replicate_sums(units, ["pop"], "unit", ["s", "m", "e"])
    over = lambda x, y: F.col(x).cast("double") / F.nullif(F.col(y).cast("double"), F.lit(0.0)) / 1_000_000
    ratio, mean = over("s", "m"), over("e", "w")
    ends = bootstrap.spread(made, ["pop"], ratio).join(made.groupBy("pop").agg(F.stddev_samp(mean).alias("se_mean"), F.stddev_samp(mean - ratio).alias("se_difference")), "pop")
    plain = units.groupBy("pop").agg(F.count("*").alias("units"), (F.sum("s").cast("double") / F.sum("m").cast("double") / 1_000_000).alias("ratio"), (F.sum("e").cast("double") / F.count("*") / 1_000_000).alias("mean"))
    return plain.join(ends, "pop").select("pop", "units", *_six("ratio", "se", "lo", "hi", "mean", "se_mean"), F.round(F.col("mean") - F.col("ratio"), 6).alias("difference"), *_six("se_difference"))


_CLASSES = f"""{_TRIM}, near as (select i as node_id, count(distinct bj) as m from pairs group by i), cl as (select n.node_id, n.block_id, coalesce(near.m, 0) as m from nodes n left join near on near.node_id = n.node_id),
te as (select seed, block_id from roles where role = 'test'),
r as (select k.seed, c.block_id, c.m, count(*) filter (where kept) as r from kept k join cl c using (node_id) where k.role = 'test' group by 1, 2, 3),
size as (select m, count(*) as n from cl group by m), {_REPS},
tb as (select block_id, rep, sum({_SEED_WEIGHT}) as t from te, reps group by 1, 2),
rb as (select block_id, m, rep, sum({_SEED_WEIGHT} * r) as r from r, reps group by 1, 2, 3),
f as (select m, rep, sum(case when t > 0 then cast(r as double) / cast(t as double) else 0 end) / any_value(n) as f from rb join tb using (block_id, rep) join size using (m) group by 1, 2),
t1 as (select block_id, count(*) as t from te group by 1), f1 as (select m, sum(cast(x.r as double) / t) / any_value(n) as f from (select block_id, m, sum(r) as r from r group by 1, 2) x join t1 using (block_id) join size using (m) group by m)"""


@query(f"with {_CLASSES}, s as (select m, {_ends_sql('f')} from f group by m) select m, n, round(f1.f, 6) as f, round(se, 6) as se, round(lo, 6) as lo, round(hi, 6) as hi from f1 join s using (m) join size using (m)")
def e20_block_class_bootstrap(spark, sf):
    """Mean inclusion of nodes by number of near blocks, with the error from drawing the draws anew.

    A block's share is its retained nodes over its draws as a test block; a replicate without any counts 0.
    """
    rows = _placed(spark, sf)
    roles = partition.roles(draws(rows.select("block_id")))
    sets = materialise(buffer.near_sets(rows, BUFFER_M), "near-sets")
    near = materialise(buffer.near_blocks(rows, BUFFER_M).select("node_id", F.size("nbr_blocks").cast("bigint").alias("m")), "near-counts")
    member, judged = buffer.judged_classes(roles, sets)
    classed = rows.select("node_id", "block_id").join(near, "node_id", "left").fillna(0, "m")
    size = classed.groupBy("m").agg(F.count("*").alias("n"))
    # Draws touch classes of nodes, whose sizes are counted once.
    counts = member.join(classed, "node_id").groupBy("class", "block_id", "m").agg(F.count("*").alias("k"))
    retained = materialise(counts.join(judged.filter("role = 'test'").drop("block_id"), "class").groupBy("seed", "block_id", "m").agg(F.sum(F.when(F.col("kept"), F.col("k")).otherwise(0)).alias("r")), "retained")
    tests = roles.filter("role = 'test'").select("seed", "block_id")
    trials = bootstrap.replicate_sums(tests, ["block_id"], "seed", []).withColumnRenamed("w", "t")
    kept = bootstrap.replicate_sums(retained, ["block_id", "m"], "seed", ["r"]).drop("w")
    share = F.when(F.col("t") > 0, F.col("r").cast("double") / F.col("t").cast("double")).otherwise(0.0)
    f = kept.join(trials, ["block_id", "replicate"]).groupBy("m", "replicate").agg(F.sum(share).alias("f")).join(F.broadcast(size), "m")
    ends = bootstrap.spread(f, ["m"], F.col("f") / F.col("n"))
    once = retained.groupBy("block_id", "m").agg(F.sum("r").alias("r")).join(tests.groupBy("block_id").agg(F.count("*").alias("t")), "block_id")
    plain = once.groupBy("m").agg(F.sum(F.col("r").cast("double") / F.col("t")).alias("f")).join(F.broadcast(size), "m").withColumn("f", F.col("f") / F.col("n"))
    return plain.join(ends, "m").select("m", "n", *_six("f", "se", "lo", "hi"))


_DELTAS = f"""{FEATURES_SQL}, g as (select is_sentinel, gx % 5 as gx, cast(sum(cast(round((rssi_pred - rssi) * 1000000) as bigint)) as double) / count(*) as d from feats group by 1, 2)"""


@query(f"with {_DELTAS}, o as (select is_sentinel, d, row_number() over (partition by is_sentinel order by d) as k from g), s as (select a.is_sentinel, a.k as a, b.k as b, c.k as c, d.k as d, e.k as e, (a.d + b.d + c.d + d.d + e.d) / 5 as mean from o a join o b on b.is_sentinel = a.is_sentinel and b.k >= a.k join o c on c.is_sentinel = a.is_sentinel and c.k >= b.k join o d on d.is_sentinel = a.is_sentinel and d.k >= c.k join o e on e.is_sentinel = a.is_sentinel and e.k >= d.k), w as (select is_sentinel, mean, 120 / list_product(list_transform([1, 2, 3, 4, 5], lambda x: [1, 1, 2, 6, 24, 120][1 + len(list_filter([a, b, c, d, e], lambda y: y = x))])) as weight from s) select is_sentinel, count(*) as multisets, cast(sum(weight) as bigint) as orders, round(sum(weight * mean) / sum(weight) / 1000000, 6) as mean, round(sqrt(sum(weight * mean * mean) / sum(weight) - (sum(weight * mean) / sum(weight)) * (sum(weight * mean) / sum(weight))) / 1000000, 5) as sd, round(min(mean) / 1000000, 6) as lo, round(max(mean) / 1000000, 6) as hi, round(cast(sum(weight) filter (where mean > 0) as double) / sum(weight), 9) as above_zero from w group by 1")
def e21_exact_multisets(spark, sf):
    """The whole distribution of the mean of five groups drawn with replacement: every multiset with its number of orders."""
    deltas = features(spark, sf).groupBy("is_sentinel", (F.col("gx") % 5).alias("gx")).agg((F.sum(_micro(F.col("rssi_pred") - F.col("rssi"))).cast("double") / F.count("*")).alias("d"))
    made = bootstrap.multisets(deltas, ["is_sentinel"], "d", 5)
    w, x = F.col("weight"), F.col("mean")
    mean = F.sum(w * x) / F.sum(w)
    return made.groupBy("is_sentinel").agg(
        F.count("*").alias("multisets"), F.sum(w).alias("orders"), F.round(mean / 1_000_000, 6).alias("mean"), F.round(F.sqrt(F.sum(w * x * x) / F.sum(w) - mean * mean) / 1_000_000, 5).alias("sd"),
        F.round(F.min(x) / 1_000_000, 6).alias("lo"), F.round(F.max(x) / 1_000_000, 6).alias("hi"), F.round(F.coalesce(F.sum(F.when(x > 0, w)), F.lit(0)).cast("double") / F.sum(w), 9).alias("above_zero"),
    )


@query(f"with {FEATURES_SQL}, g as (select is_sentinel, block_id, sum(cast(round((rssi_pred - rssi) * 1000000) as bigint)) as d from feats group by 1, 2), c as (select is_sentinel, count(*) filter (where d > 0) as pos, count(*) filter (where d < 0) as neg, count(*) filter (where d = 0) as ties from g group by 1), t as (select c.is_sentinel, sum(exp(lgamma(pos + neg + 1.0) - lgamma(j + 1.0) - lgamma(pos + neg - j + 1.0) - (pos + neg) * ln(2.0))) as tail from c, (select cast(unnest(range(0, 61)) as integer) as j) where j between greatest(pos, neg) and pos + neg group by 1) select c.is_sentinel, pos as positives, neg as negatives, ties, round(case when pos + neg = 0 then null when pos = neg then 1 else least(1, 2 * tail) end, 9) as p from c left join t on t.is_sentinel = c.is_sentinel")
def e21_exact_sign_test(spark, sf):
    """Blocks whose predictions are too high against those too low, by the binomial distribution."""
    signs = features(spark, sf).groupBy("is_sentinel", "block_id").agg(F.sum(_micro(F.col("rssi_pred") - F.col("rssi"))).alias("d")).groupBy("is_sentinel").agg(F.count_if(F.col("d") > 0).alias("positives"), F.count_if(F.col("d") < 0).alias("negatives"), F.count_if(F.col("d") == 0).alias("ties"))
    return signs.withColumn("p", F.round(bootstrap.sign_test(F.col("positives"), F.col("negatives")), 9))


#: Bits of the eight neighbours as (step in x, step in y), least first.
SIDES = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1))


def neighbour_masks(rows: DataFrame, radius: int) -> DataFrame:
    """(node_id, block_id, mask): which of the eight blocks around have a node nearer than ``radius``."""
    near = buffer.near_blocks(rows.select("node_id", "block_id", "x_m", "y_m"), radius)
    bit = F.lit(0)
    for k, (dx, dy) in enumerate(SIDES):
        at = (F.col("gx") + dx) * 6 + F.col("gy") + dy
        inside = (F.col("gy") + dy >= 0) & (F.col("gy") + dy < 6)
        bit = bit + F.when(inside & F.array_contains("nbr_blocks", at), 1 << k).otherwise(0)
    return rows.join(near.select("node_id", "nbr_blocks"), "node_id", "left").select("node_id", "block_id", F.coalesce(bit, F.lit(0)).cast("int").alias("mask"))


def disjoint_counts(masks: DataFrame, by: list[str], bits: int = 8) -> DataFrame:
    """(by, flags, n): for every set of flags, how many rows of a group have a mask that shares none.

    Rows are counted once a mask; sums over all subsets then take one pass of the array a bit, and the
    masks without any of ``flags`` are the subsets of the others.
    """
    every = (1 << bits) - 1
    counts = masks.groupBy(*by, "mask").agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("mask", "n"))).alias("h"))
    start = F.transform(F.sequence(F.lit(0), F.lit(every)), lambda k: F.coalesce(F.element_at("h", k), F.lit(0).cast("bigint")))
    # In step i, a set with bit i takes what the set without it holds.
    step = lambda acc, i: F.transform(acc, lambda x, k: x + F.when(F.call_function("shiftright", k, i).bitwiseAND(F.lit(1)) == 1, F.get(acc, k - F.call_function("shiftleft", F.lit(1), i))).otherwise(F.lit(0).cast("bigint")))
    sums = F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), start, step)
    return counts.select(*by, sums.alias("sums")).select(*by, F.posexplode(F.reverse("sums")).alias("flags", "n"))


_MASKS = f"{_BASE},{_PAIRS}, g as (select p.i, p.bi, b.block_id // 6 - p.bi // 6 as dx, b.block_id % 6 - p.bi % 6 as dy from (select distinct i, bi, bj from pairs) p join blocks b on b.block_id = p.bj), bits(dx, dy, bit) as (values {', '.join(f'({dx}, {dy}, {1 << k})' for k, (dx, dy) in enumerate(SIDES))}), masks as (select n.node_id, n.block_id, coalesce(sum(bit), 0) as mask from nodes n left join g on g.i = n.node_id left join bits on bits.dx = g.dx and bits.dy = g.dy group by 1, 2)"


@query(f"with {_MASKS}, h as (select block_id, mask, count(*) as n from masks group by 1, 2), fl as (select unnest(range(256)) as flags) select b.block_id, cast(flags as integer) as flags, cast(coalesce(sum(n), 0) as bigint) as n from (select distinct block_id from h) b cross join fl left join h on h.block_id = b.block_id and (cast(h.mask as integer) & cast(flags as integer)) = 0 group by 1, 2")
def e31_flag_table(spark, sf):
    """How many nodes of a block stay if the neighbours in ``flags`` trim, for all 256 sets of neighbours."""
    rows = places(spark, sf).select("node_id", "block_id", "x_m", "y_m", "gx", "gy")
    return disjoint_counts(neighbour_masks(materialise(rows, "places"), BUFFER_M), ["block_id"])


_MODELS = "(select unnest(['free', 'steep']) as model)"


@query(f"with {_BASE}, t as (select seed, model, is_sentinel, round(rssi + case model when 'free' then {_FSPL} else 1.5::double * ({_FSPL}) end, 6) as w from nodes join roles using (block_id), {_MODELS} where role = 'train'), s as (select seed, model, count(*) as n, count(*) filter (where is_sentinel) as n_s, median(w) as mid from t group by 1, 2), r as (select seed, model, w, row_number() over (partition by seed, model order by w) - 1 as k from t where is_sentinel), b as (select *, 1 - 1 / (2 * (cast(n_s as double) / n)) as alpha, 1 / (2 * (cast(n_s as double) / n)) as beta from s where 2 * n_s > n), q as (select b.seed, b.model, max(w) filter (where k = cast(floor(alpha * (n_s - 1)) as bigint)) as q_minus, max(w) filter (where k = cast(ceil(beta * (n_s - 1)) as bigint)) as q_plus from b join r on r.seed = b.seed and r.model = b.model group by 1, 2) select b.seed, b.model, n, n_s as n_sentinel, round(alpha, 9) as alpha, round(beta, 9) as beta, round(q_minus, 6) as q_minus, round(q_plus, 6) as q_plus, round(q_plus - q_minus, 6) as width, round(mid, 6) as median, q_minus <= mid and mid <= q_plus as inside from b join q on q.seed = b.seed and q.model = b.model")
def e32_median_band(spark, sf):
    """Where the training median of rssi + loss can lie, by order statistics of the sentinels alone.

    Each draw's own share of sentinels decides which; draws with half of them or fewer have no band.
    """
    loss = P.free_space(F.col("dist_m"), F.lit(FREQUENCY))
    levels = F.explode(F.array(F.struct(F.lit("free").alias("model"), F.round(F.col("rssi") + loss, 6).alias("w")), F.struct(F.lit("steep").alias("model"), F.round(F.col("rssi") + 1.5 * loss, 6).alias("w"))))
    rows = materialise(nodes(spark, sf).select("block_id", "is_sentinel", levels.alias("v")).select("block_id", "is_sentinel", "v.model", "v.w"), "levels")
    taken = trained(rows)
    key = ["seed", "model"]
    counts = rows.groupBy("block_id", "model").agg(F.count("*").alias("n"), F.count_if("is_sentinel").alias("n_sentinel"))
    sizes = counts.join(F.broadcast(taken), "block_id").groupBy(*key).agg(F.sum("n").alias("n"), F.sum("n_sentinel").alias("n_sentinel")).filter("2 * n_sentinel > n")
    share = F.col("n_sentinel").cast("double") / F.col("n")
    wanted = sizes.withColumns({"alpha": 1 - 1 / (2 * share), "beta": 1 / (2 * share)})
    # Each group's ranks are columns: they differ from draw to draw.
    low, high = F.floor(F.col("alpha") * (F.col("n_sentinel") - 1)) + 1, F.ceil(F.col("beta") * (F.col("n_sentinel") - 1)) + 1
    one = lambda name, rank: F.struct(F.lit(name).alias("name"), rank.alias("rank"), F.lit(1.0).alias("weight"))
    ranked = ranks.drawn_values(rows.filter("is_sentinel"), taken, ["model"], "w", lambda _: F.array(one("q_minus", low), one("q_plus", high)), wanted.withColumnRenamed("n", "n_all"))
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("x"))).alias(name)
    ends = wanted.join(ranked.groupBy(*key).agg(of("q_minus"), of("q_plus")), key)
    middle = ranks.drawn_values(rows, taken, ["model"], "w").select(*key, F.col("x").alias("median"))
    inside = (F.col("q_minus") <= F.col("median")) & (F.col("median") <= F.col("q_plus"))
    return ends.join(middle, key).select(*key, "n", "n_sentinel", *[F.round(c, 9).alias(c) for c in ("alpha", "beta")], *_six("q_minus", "q_plus"), F.round(F.col("q_plus") - F.col("q_minus"), 6).alias("width"), *_six("median"), inside.alias("inside"))


_HEX = "printf('%016x', node_id)"
_LITTLE = " || ".join(f"h[{i}:{i + 1}]" for i in range(15, 0, -2))


@query(f"with {_BASE}, m as (select seed, role, node_id, {_HEX} as h from nodes join roles using (block_id)) select seed, role, count(*) as n, sha256(unhex(string_agg({_LITTLE}, '' order by node_id))) as sha256 from m group by 1, 2")
def b12_member_sha256(spark, sf):
    """SHA-256 of each role's sorted members as little-endian int64."""
    rows = places(spark, sf).select("node_id", "block_id")
    return digest.id_digests(rows.join(F.broadcast(partition.roles(draws(rows.select("block_id")))), "block_id"), ["seed", "role"], "node_id")


def falling(a, k):
    """a (a - 1) ... (a - k + 1), as a Column."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(8)), F.lit(1.0), lambda s, j: F.when(j < k, s * (a - j)).otherwise(s))


_REACH = f"o as (select n.node_id, n.gx + p.a - 1 as nx, n.gy + q.b - 1 as ny, case p.a when 0 then x_m - n.gx * {BLOCK_M} when 1 then 0 else {BLOCK_M} - (x_m - n.gx * {BLOCK_M}) end as ex, case q.b when 0 then y_m - n.gy * {BLOCK_M} when 1 then 0 else {BLOCK_M} - (y_m - n.gy * {BLOCK_M}) end as ey from nodes n, range(3) p(a), range(3) q(b) where not (p.a = 1 and q.b = 1)), real as (select distinct gx, gy from nodes), c as (select o.node_id, count(real.gx) as k from o left join real on real.gx = o.nx and real.gy = o.ny and ex * ex + ey * ey <= {BUFFER_M * BUFFER_M} group by 1), a as (select k, count(*) as n from c group by k)"


@query(f"with {_BASE}, {_REACH}, r(role, free) as (select 'test', n - n_tr - n_va from cut2, cuts union all select 'val', n - n_tr from cut2, cuts) select role, cuts.n as blocks, free, round(cast(sum(a.n * pow(cast(free as double) / cuts.n, k)) as double) / sum(a.n), 9) as mean_field, round(cast(sum(a.n * list_product(list_prepend(1.0::double, list_transform(range(0, k), lambda j: (free - 1 - j)::double / (cuts.n - 1 - j))))) as double) / sum(a.n), 9) as exact from a, r, cuts group by 1, 2, 3")
def e27_finite_lattice(spark, sf):
    """Expected retention on the blocks there are: nodes are counted by how many blocks reach them."""
    rows = places(spark, sf).select("node_id", "gx", "gy", (F.col("x_m") - F.col("gx") * BLOCK_M).alias("dx"), (F.col("y_m") - F.col("gy") * BLOCK_M).alias("dy"))
    blocks = rows.select("gx", "gy").distinct().withColumn("real", F.lit(True))
    away = lambda step, d: F.lit(0) if step == 0 else d if step < 0 else BLOCK_M - d
    steps = F.array(*[F.struct((F.col("gx") + a).alias("nx"), (F.col("gy") + b).alias("ny"), (away(a, F.col("dx")) * away(a, F.col("dx")) + away(b, F.col("dy")) * away(b, F.col("dy")) <= BUFFER_M * BUFFER_M).alias("near")) for a, b in SIDES])
    # Nodes of a block that the same places reach are one row before blocks are asked for.
    reach = rows.withColumn("near", F.transform(F.filter(steps, lambda s: s["near"]), lambda s: F.struct(s["nx"].alias("nx"), s["ny"].alias("ny")))).groupBy("near").agg(F.count("*").alias("n")).withColumn("id", F.xxhash64("near"))
    opened = reach.select("id", "n", F.explode_outer("near").alias("s")).join(F.broadcast(blocks), (F.col("s.nx") == F.col("gx")) & (F.col("s.ny") == F.col("gy")), "left")
    by_count = opened.groupBy("id", "n").agg(F.count("real").cast("int").alias("k")).groupBy("k").agg(F.sum("n").alias("n"))
    total = blocks.agg(F.count("*").alias("blocks"))
    a, b = partition.role_counts(F.col("blocks"))
    roles = total.select("blocks", F.explode(F.array(F.struct(F.lit("test").alias("role"), (F.col("blocks") - a - b).cast("bigint").alias("free")), F.struct(F.lit("val").alias("role"), (F.col("blocks") - a).cast("bigint").alias("free")))).alias("r")).select("blocks", "r.*")
    k, free, n = F.col("k"), F.col("free"), F.col("blocks")
    mean_field = F.sum(F.col("n") * F.pow(free.cast("double") / n, k)) / F.sum("n")
    exact = F.sum(F.col("n") * falling(free - 1, k) / falling(n - 1, k)) / F.sum("n")
    return by_count.join(F.broadcast(roles)).groupBy("role", "blocks", "free").agg(F.round(mean_field, 9).alias("mean_field"), F.round(exact, 9).alias("exact"))


_AREA = f"""{_BASE}, tr as (select seed, block_id, true as t from roles where role = 'train'),
te as (select r.seed, r.block_id, r.block_id // 6 as gx, r.block_id % 6 as gy from roles r where role = 'test'),
fl as (select te.seed, te.block_id, {', '.join(f"coalesce(bool_or(t) filter (where tr.block_id // 6 - gx = {dx} and tr.block_id % 6 - gy = {dy}), false) as f{k}" for k, (dx, dy) in enumerate(SIDES))} from te left join tr on tr.seed = te.seed and abs(tr.block_id // 6 - gx) <= 1 and abs(tr.block_id % 6 - gy) <= 1 group by te.seed, te.block_id),
px as (select block_id, x_m - gx * {BLOCK_M} as x, y_m - gy * {BLOCK_M} as y from nodes),
kept0 as (select fl.seed, fl.block_id, count(*) as n, count(*) filter (where not (f0 and x < {BUFFER_M}) and not (f1 and x > {BLOCK_M - BUFFER_M}) and not (f2 and y < {BUFFER_M}) and not (f3 and y > {BLOCK_M - BUFFER_M})
  and not (f4 and not f0 and not f2 and x * x + y * y < {BUFFER_M**2}) and not (f5 and not f1 and not f2 and ({BLOCK_M} - x) * ({BLOCK_M} - x) + y * y < {BUFFER_M**2})
  and not (f6 and not f0 and not f3 and x * x + ({BLOCK_M} - y) * ({BLOCK_M} - y) < {BUFFER_M**2}) and not (f7 and not f1 and not f3 and ({BLOCK_M} - x) * ({BLOCK_M} - x) + ({BLOCK_M} - y) * ({BLOCK_M} - y) < {BUFFER_M**2})) as m
  from fl join px using (block_id) group by 1, 2)"""


@query(f"with {_AREA} select seed, block_id, n, m, round(cast(m as double) / n, 9) as by_pixels, round(greatest(0, greatest(0.0, {BLOCK_M}.0::double - {BUFFER_M}.0::double * (f0::int + f1::int)) * greatest(0.0, {BLOCK_M}.0::double - {BUFFER_M}.0::double * (f2::int + f3::int)) - pi() * {BUFFER_M}.0::double * {BUFFER_M}.0::double / 4 * ((f4 and not f0 and not f2)::int + (f5 and not f1 and not f2)::int + (f6 and not f0 and not f3)::int + (f7 and not f1 and not f3)::int)) / {BLOCK_M}.0::double / {BLOCK_M}.0::double, 9) as by_formula from fl join kept0 using (seed, block_id)")
def e29_block_area(spark, sf):
    """Area of each test block left by its training neighbours: by its nodes as pixels, and by the formula.

    A side takes a strip as wide as the buffer; a corner without either side takes a quarter of a disc.
    """
    rows = places(spark, sf).select("block_id", (F.col("x_m") - F.col("gx") * BLOCK_M).alias("x"), (F.col("y_m") - F.col("gy") * BLOCK_M).alias("y"))
    roles = partition.roles(draws(rows.select("block_id")))
    train = roles.filter("role = 'train'").groupBy("seed").agg(F.collect_set("block_id").alias("train"))
    gx, gy = F.expr("block_id div 6"), F.col("block_id") % 6
    sides = [((gy + dy) >= 0) & ((gy + dy) < 6) & F.array_contains("train", (gx + dx) * 6 + gy + dy) for dx, dy in SIDES]
    flags = roles.filter("role = 'test'").join(F.broadcast(train), "seed").select("seed", "block_id", *[s.alias(f"f{k}") for k, s in enumerate(sides)])
    f, x, y, b = [F.col(f"f{k}") for k in range(8)], F.col("x"), F.col("y"), BUFFER_M
    alone = [f[4] & ~f[0] & ~f[2], f[5] & ~f[1] & ~f[2], f[6] & ~f[0] & ~f[3], f[7] & ~f[1] & ~f[3]]
    corner = lambda u, v: u * u + v * v < b * b
    gone = (f[0] & (x < b)) | (f[1] & (x > BLOCK_M - b)) | (f[2] & (y < b)) | (f[3] & (y > BLOCK_M - b)) | (alone[0] & corner(x, y)) | (alone[1] & corner(BLOCK_M - x, y)) | (alone[2] & corner(x, BLOCK_M - y)) | (alone[3] & corner(BLOCK_M - x, BLOCK_M - y))
    counts = rows.join(F.broadcast(flags), "block_id").groupBy("seed", "block_id").agg(F.count("*").alias("n"), F.count_if(~gone).alias("m"))
    number = lambda c: c.cast("int")
    side = lambda p, q: F.greatest(F.lit(0.0), float(BLOCK_M) - float(b) * (number(p) + number(q)))
    area = F.greatest(F.lit(0.0), side(f[0], f[1]) * side(f[2], f[3]) - F.pi() * float(b) * float(b) / 4 * sum((number(c) for c in alone[1:]), number(alone[0])))
    return counts.join(flags, ["seed", "block_id"]).select("seed", "block_id", "n", "m", F.round(F.col("m").cast("double") / F.col("n"), 9).alias("by_pixels"), F.round(area / float(BLOCK_M) / float(BLOCK_M), 9).alias("by_formula"))


@query(f"with {NODES_SQL},{DRAWS_SQL}, b as (select block_id, round(avg(case when is_sentinel then 0.0 else 1.0 end), 9) as valid from nodes group by block_id), st as (select block_id, cast(least((row_number() over (order by valid, block_id) - 1) // 6, 4) as integer) as stratum from b), p as (select seed, block_id, stratum, row_number() over (partition by seed, stratum order by pos) as k, count(*) over (partition by seed, stratum) as m from draws join st using (block_id)), c as (select *, case when m >= 3 then greatest(1, cast(round_even(0.70::double * m, 0) as bigint)) else greatest(0, m - 2) end as a0, case when m >= 3 then greatest(1, cast(round_even(0.15::double * m, 0) as bigint)) when m >= 2 then 1 else 0 end as b0 from p), d as (select *, case when a0 + b0 >= m then greatest(0, m - 2) else a0 end as a from c), e as (select *, case when a0 + b0 >= m then least(1, m - a) else b0 end as b from d) select seed, block_id, stratum, case when k <= a then 'train' when k <= a + b then 'val' else 'test' end as role from e")
def b06_stratified_roles(spark, sf):
    """Roles drawn within strata of blocks with a like share of valid nodes, for every seed."""
    rows = nodes(spark, sf)
    share = rows.groupBy("block_id").agg(F.round(F.avg(F.when(F.col("is_sentinel"), 0.0).otherwise(1.0)), 9).alias("valid"))
    return partition.stratified_roles(draws(rows.select("block_id")), partition.strata(share, "valid", 6, 5))
