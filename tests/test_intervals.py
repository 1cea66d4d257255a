"""Bootstraps, exact small samples, masks and digests against NumPy and plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import bootstrap, digest, partition
from quadrille.plans.intervals import disjoint_counts
from tests import oracle


def test_weights_are_poisson_and_as_in_sql():
    units = np.arange(3000)
    drawn = bootstrap.weights(units, 50, 3)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.03 and drawn.max() >= 5
    assert abs(np.corrcoef(drawn[:, 0], drawn[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(drawn[:-1, 0], drawn[1:, 0])[0, 1]) < 0.06
    sql = bootstrap.weight_sql("i", "rep", 50, 3)
    found = oracle.connect().execute(f"select {sql} from (select cast(unnest(range(3000)) as bigint) as i), (select cast(unnest(range(50)) as bigint) as rep) order by i, rep").fetchnumpy()
    assert np.array_equal(next(iter(found.values())).reshape(3000, 50), drawn)


def test_replicate_sums_add_up(spark, monkeypatch):
    draw = np.random.default_rng(1)
    rows = [(None if i % 7 == 0 else f"g{i % 3}", int(i % 40), None if i % 11 == 0 else int(draw.integers(-(10**12), 10**12))) for i in range(500)]
    made = bootstrap.replicate_sums(spark.createDataFrame(rows, "g string, u bigint, x bigint").repartition(3), ["g"], "u", ["x"], 20, 2).collect()
    drawn = bootstrap.weights(np.arange(40), 20, 2)
    for r in made:
        own = [x for x in rows if x[0] == r["g"]]
        assert r["w"] == sum(drawn[u, r["replicate"]] for _, u, _ in own) and r["x"] == sum(int(drawn[u, r["replicate"]]) * (x or 0) for _, u, x in own)
    assert len(made) == 4 * 20
    none = spark.createDataFrame([], "g string, u bigint, x bigint")
    assert bootstrap.replicate_sums(none, ["g"], "u", ["x"]).count() == 0
    alone = bootstrap.replicate_sums(spark.createDataFrame([("a", None, 4), ("a", 3, 4)], "g string, u bigint, x bigint"), [], "u", ["x"], 5)
    assert [r["x"] for r in alone.orderBy("replicate").collect()] == (4 * bootstrap.weights(np.array([3]), 5, 0)[0]).tolist()


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 3.0, -1.0, 7.0]])
def test_multisets_are_all_draws(spark, values):
    rows = [(None, v) for v in values] + [(1, 5.0), (1, None)]
    found = bootstrap.multisets(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", 4).filter("g is null").collect()
    n = len(values)
    assert sum(r["weight"] for r in found) == n**n and len(found) == math.comb(2 * n - 1, n)
    want = sorted(sum(p) / n for p in itertools.product(values, repeat=n))
    assert sorted(m for r in found for m in [r["mean"]] * r["weight"]) == pytest.approx(want)


def test_too_many_values_are_an_error(spark):
    with pytest.raises(Exception, match="more than 3 values"):
        bootstrap.multisets(spark.range(4).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x")), ["g"], "x", 3).collect()


def test_sign_test(spark):
    cases = [(4, 0), (3, 1), (2, 2), (0, 0), (30, 12), (1, 0), (0, 7)]
    found = spark.createDataFrame(cases, "p bigint, n bigint").select("p", "n", bootstrap.sign_test(F.col("p"), F.col("n")).alias("t")).collect()
    for r in found:
        n, k = r["p"] + r["n"], max(r["p"], r["n"])
        want = None if not n else 1.0 if r["p"] == r["n"] else min(1.0, 2 * sum(math.comb(n, j) for j in range(k, n + 1)) / 2**n)
        assert r["t"] == (want if want is None else pytest.approx(want))


def test_disjoint_counts_match_all_pairs(spark):
    draw = np.random.default_rng(3)
    masks = [(int(g), int(m)) for g, m in zip(draw.integers(0, 3, 300), draw.integers(0, 16, 300), strict=True)]
    found = disjoint_counts(spark.createDataFrame(masks, "g bigint, mask int"), ["g"], 4).collect()
    assert {(r["g"], r["flags"]): r["n"] for r in found} == {(g, f): sum(h == g and not m & f for h, m in masks) for g in range(3) for f in range(16)}


def test_digest_of_groups_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    draw = np.random.default_rng(5)
    rows = [(None if g == 2 else f"g{g}", int(s), int(k)) for g, s, k in zip(draw.integers(0, 4, 900), draw.integers(0, 2, 900), draw.integers(-(2**62), 2**62, 900), strict=True)] + [("g9", 0, None), ("g0", 0, -1), ("g0", 0, -1)]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
        found = digest.id_digests(spark.createDataFrame(rows, "g string, s int, k bigint").repartition(5), ["g", "s"], "k").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == 8
    for r in found:
        own = np.sort(np.array([k for g, s, k in rows if (g, s) == (r["g"], r["s"]) and k is not None], np.int64))
        assert (r["n"], r["sha256"]) == (len(own), hashlib.sha256(own.astype("<i8").tobytes()).hexdigest())


def test_stratified_roles_follow_the_rule(spark):
    strata = [(b, s) for s, size in enumerate((1, 2, 3, 6, 13)) for b in range(100 * s, 100 * s + size)]
    draws = [(seed, b, (b * 7 + seed * 13) % 1009) for seed in range(3) for b, _ in strata]
    found = partition.stratified_roles(spark.createDataFrame(draws, "seed int, block_id int, pos int"), spark.createDataFrame(strata, "block_id int, stratum int")).collect()
    for seed in range(3):
        for s, (train, val) in enumerate([(0, 0), (0, 1), (1, 1), (4, 1), (9, 2)]):
            own = sorted(((b, t) for b, t in strata if t == s), key=lambda x: (x[0] * 7 + seed * 13) % 1009)
            want = {b: "train" if k < train else "val" if k < train + val else "test" for k, (b, _) in enumerate(own)}
            assert {r["block_id"]: r["role"] for r in found if r["seed"] == seed and r["stratum"] == s} == want
