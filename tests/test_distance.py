"""Distance transforms, trims on rasters and closest pairs against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from quadrille.operators import distance


def test_lower_envelope_matches_all_parabolas():
    draw = np.random.default_rng(0)
    for _ in range(100):
        n, width = draw.integers(1, 9), draw.integers(1, 40)
        height = np.where(draw.random((n, width)) < draw.random(), draw.integers(0, 60, (n, width)) ** 2 * 900.0, np.inf)
        step, at = float(draw.integers(1, 40)), np.arange(width)
        want = (height[:, None, :] + ((at[:, None] - at[None, :]) * step) ** 2).min(2)
        assert np.array_equal(want, distance.lower_envelope(height, step))


def raster(seed: int, n: int, side: int, share: float):
    draw = np.random.default_rng(seed)
    targets = {(int(s), int(r), int(c)) for s, r, c in zip(draw.integers(0, 3, n), draw.integers(0, side, n), draw.integers(0, side, n), strict=True)}
    return sorted(targets), sorted(t for t in targets if draw.random() < share and t[0] < 2)


@pytest.mark.parametrize(("limit", "rows", "columns", "share"), [(None, 7, 5, 0.01), (None, 64, 300, 0.2), (70.0, 5, 4, 0.05), (28.0, 8, 8, 0.3), (None, 3, 2, 0.0)])
def test_transform_matches_brute_force(spark, limit, rows, columns, share):
    targets, sources = raster(rows, 700, 40, share)
    found = distance.distance_transform(spark.createDataFrame(targets, "seed bigint, row bigint, col bigint"), spark.createDataFrame(sources, "seed bigint, row bigint, col bigint"), ["seed"], 30.0, 28.0, limit, rows, columns)
    got = {(r["seed"], r["row"], r["col"]): r["d2"] for r in found.collect()}
    assert sorted(got) == targets
    for (s, r, c), d2 in got.items():
        near = min(((r - y) ** 2 * 900 + (c - x) ** 2 * 784 for q, y, x in sources if q == s), default=None)
        assert d2 == (None if near is None or (limit is not None and near > limit * limit) else near)


def test_transform_of_nothing(spark):
    none = spark.createDataFrame([], "row bigint, col bigint")
    assert distance.distance_transform(none, none, [], 1.0, 1.0).count() == 0
    some = spark.createDataFrame([(1, 2, "x"), (1, 2, "x")], "row bigint, col bigint, extra string")
    found = distance.distance_transform(some, some.drop("extra"), [], 1.0, 1.0).collect()
    assert [tuple(r) for r in found] == [(1, 2, "x", 0.0)] * 2


@pytest.mark.parametrize(("n", "per_tile"), [(400, 1), (400, 8), (3, 8)])
def test_closest_pairs_match_brute_force(spark, n, per_tile):
    draw = np.random.default_rng(n + per_tile)
    points = [(int(g), int(x), int(y)) for g, x, y in zip(draw.integers(0, 9, n), draw.integers(0, 5000, n), draw.integers(-900, 300, n), strict=True)]
    members = [(seed, kind, g) for seed in range(4) for g in range(9) for kind in [("a", "b", "c", None)[int(draw.integers(0, 4))]] if kind]
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    found = distance.closest_pairs(spark.createDataFrame(members, "seed bigint, kind string, grp bigint"), spark.createDataFrame(points, "grp bigint, x_m bigint, y_m bigint"), ["seed"], spark.createDataFrame(pairs, "a string, b string"), per_tile)
    want = {}
    for seed in range(4):
        of = {k: [p for p in points if (seed, k, p[0]) in members] for k in "abc"}
        for a, b in pairs:
            if of[a] and of[b]:
                want[seed, a, b] = min((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 for p in of[a] for q in of[b])
    assert {(r["seed"], r["a"], r["b"]): r["d2"] for r in found.collect()} == want
