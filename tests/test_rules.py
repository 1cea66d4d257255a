"""Guards, draws, ranks and distance operators against NumPy and brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.fixtures import SEEDS, nodes
from quadrille.functions import design
from quadrille.operators import buffer, neighbors, partition, ranks, solve
from quadrille.plans.registry import QUERIES
from tests import oracle


def test_legacy_draws_are_numpy_permutations(spark):
    blocks = sorted(r["block_id"] for r in nodes(spark, oracle.SF_DIR).select("block_id").distinct().collect())
    found = {(r["seed"], r["block_id"]): r["pos"] for r in QUERIES["b01_legacy_generator_draws"](spark, oracle.SF_DIR).collect()}
    assert len(found) == SEEDS * len(blocks)
    for seed in range(SEEDS):
        order = np.array(blocks, np.int64)
        np.random.RandomState(seed).shuffle(order)
        assert [found[seed, int(b)] for b in order] == list(range(1, len(blocks) + 1))


def test_random_sample_is_without_replacement_and_repeatable(spark):
    one = [r["node_id"] for r in QUERIES["b07_simple_random_sample"](spark, oracle.SF_DIR).collect()]
    two = [r["node_id"] for r in QUERIES["b07_simple_random_sample"](spark, oracle.SF_DIR).collect()]
    every = {r["node_id"] for r in nodes(spark, oracle.SF_DIR).select("node_id").collect()}
    assert sorted(one) == sorted(two) and len(set(one)) == 200 and set(one) <= every
    few = partition.simple_random_sample(spark.range(5).withColumnRenamed("id", "node_id"), "node_id", 9, 1)
    assert few.count() == 5


def test_seed_lists():
    assert partition.seed_list("", [3, 1]) == [3, 1] and partition.seed_list("4,5", []) == [4, 5]
    assert partition.seed_list("random:3:7", []) == np.random.RandomState(7).randint(10**6, size=3).tolist()


def test_parts_without_rows_are_an_error(spark):
    parts = spark.range(3).withColumnRenamed("id", "part")
    rows = spark.createDataFrame([(0,), (2,)], "part bigint")
    with pytest.raises(Exception, match="no rows in part 1"):
        design.guarded_counts(parts, rows, "part", "n").collect()


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_near_groups_by_tiles_match_brute_force(spark, parts):
    draw = np.random.default_rng(parts)
    xy = np.concatenate([draw.integers(0, 60, (150, 2)), draw.integers(20, 26, (60, 2))])
    rows = [(i, int(x) // 20 * 3 + int(y) // 20, int(x), int(y), i % 5) for i, (x, y) in enumerate(xy)]
    docs = spark.createDataFrame(rows, "node_id bigint, block_id bigint, x_m bigint, y_m bigint, grp bigint")
    want = {(a[0], a[1], b[4]) for a in rows for b in rows if a[1] != b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 < 49}
    found = buffer.groups_within(docs, docs, 7, parts).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 50


def test_nearest_rows_however_few_or_far(spark):
    left = spark.createDataFrame([(1, 0, 0), (2, 10**6, 10**6), (3, 5, 5)], "id bigint, lx bigint, ly bigint")
    right = spark.createDataFrame([(7, 1, 1), (8, 9, 9), (9, 1, 1)], "ant bigint, rx bigint, ry bigint")
    near = lambda k, rows, side=None: sorted((r["id"], r["rank"], r["ant"], r["d2"]) for r in neighbors.k_nearest(left, rows, "id", "ant", k, side).collect())
    assert near(1, right) == [(1, 1, 7, 2), (2, 1, 8, 2 * (10**6 - 9) ** 2), (3, 1, 7, 32)]
    assert [x[:3] for x in near(2, right, 0.5)] == [(1, 1, 7), (1, 2, 9), (2, 1, 8), (2, 2, 7), (3, 1, 7), (3, 2, 8)]
    assert len(near(5, right)) == 9 and near(1, right.limit(0)) == []


def test_ranks_and_quantiles_match_numpy(spark):
    draw = np.random.default_rng(4)
    rows = [(int(g), None if draw.random() < 0.1 else float(x)) for g, x in zip(draw.integers(0, 3, 500), draw.integers(0, 40, 500) / 4, strict=True)] + [(9, 1.5), (8, None)]
    docs = spark.createDataFrame(rows, "g bigint, x double").repartition(5)
    found = {r["g"]: (r["a"], r["b"], r["c"]) for r in ranks.quantiles(docs, ["g"], "x", {"a": 0.5, "b": 0.9, "c": 1.0}).collect()}
    for g in (0, 1, 2, 9):
        own = [x for h, x in rows if h == g and x is not None]
        assert found[g] == pytest.approx([np.quantile(own, q) for q in (0.5, 0.9, 1.0)])
    assert set(found) == {0, 1, 2, 9}
    placed = ranks.ranked(docs.filter("x is not null").withColumn("id", F.monotonically_increasing_id()), ["g"], ["x", "id"])
    for g in (0, 1, 2):
        mine = sorted((r["rank"], r["x"]) for r in placed.filter(f"g = {g}").collect())
        assert [k for k, _ in mine] == list(range(1, len(mine) + 1)) and [x for _, x in mine] == sorted(x for _, x in mine)


def test_extreme_ratios_by_all_thresholds(spark):
    draw = np.random.default_rng(6)
    e, lo = draw.random(40), draw.random(40)
    hi = lo + draw.random(40)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(e, lo, hi, strict=True)], "e double, lo double, hi double")
    ratio = lambda up: (np.where(up, hi, lo) * e).sum() / np.where(up, hi, lo).sum()
    assert design.extreme_ratio(rows, True) == pytest.approx(max(ratio(e > t) for t in [-1, *e]))
    assert design.extreme_ratio(rows, False) == pytest.approx(min(ratio(e < t) for t in [-1, *e]))
    assert design.extreme_ratio(rows.limit(0), True) is None


def test_segment_quantiles_match_numpy(spark):
    draw = np.random.default_rng(12)
    rows = [(float(x) if draw.random() > 0.1 else None, int(g), float(y)) for x, g, y in zip(draw.choice([-110.0, *draw.normal(size=30)], 600), draw.integers(0, 6, 600), draw.normal(size=600), strict=True)]
    docs = spark.createDataFrame(rows, "x double, g int, y double").repartition(4)
    segments = {"all": F.lit(True), "low": F.col("g") < 3, "odd": F.col("g") % 2 == 1, "one": F.col("g") == 5, "none": F.col("g") > 9}
    found = {(r["kind"], r["segment"]): (r["n"], r["a"], r["b"], r["c"]) for r in ranks.segment_quantiles(docs, {"x": (F.col("x"), segments), "y": (F.col("y"), {"all": F.lit(True), "unknown": F.lit(None).cast("boolean")})}, {"a": 0.0, "b": 0.37, "c": 0.9}).collect()}
    tests = {("x", "all"): lambda r: True, ("x", "low"): lambda r: r[1] < 3, ("x", "odd"): lambda r: r[1] % 2 == 1, ("x", "one"): lambda r: r[1] == 5}
    want = {k: [r[0] for r in rows if r[0] is not None and f(r)] for k, f in tests.items()} | {("y", "all"): [r[2] for r in rows]}
    assert set(found) == set(want)
    for k, own in want.items():
        assert found[k] == (len(own), *[pytest.approx(np.quantile(own, q)) for q in (0.0, 0.37, 0.9)])


@pytest.mark.parametrize("n", [1, 4, 90])
def test_cells_hold_all_that_can_be_nearest(spark, n):
    draw = np.random.default_rng(n)
    points = [(i, int(x), int(y)) for i, (x, y) in enumerate(draw.integers(0, 1000, (n, 2)))]
    cells = {(r["cx"], r["cy"]): r for r in neighbors.nearest_cells(spark.createDataFrame(points, "id bigint, rx bigint, ry bigint"), "id", 1000, 990).collect()}
    for x, y in draw.integers(0, 990, (400, 2)).tolist():
        side = next(iter(cells.values()))["side"]
        near = cells[x // side, y // side]["near"]
        assert min((x - p["rx"]) ** 2 + (y - p["ry"]) ** 2 for p in near) == min((x - u) ** 2 + (y - v) ** 2 for _, u, v in points)
    assert all(r["points"] == n for r in cells.values())


def test_recovered_unknowns_of_all_groups_at_once(spark):
    rows = [(g, float(x), float(x) * (g + 1.5) ** 2) for g in range(5) for x in range(1, 20)] + [(7, None, 1.0), (8, 1.0, 1e9)]
    docs = spark.createDataFrame(rows, "g int, x double, y double")
    found = {r["g"]: r["c"] for r in solve.recovered(docs, ["g"], lambda c: F.col("x") * c * c, "y", 0.0, 100.0, passes=8).collect()}
    assert all(found[g] == pytest.approx(g + 1.5, abs=1e-6) for g in range(5)) and found[8] == pytest.approx(100, abs=1e-6)
