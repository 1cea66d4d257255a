"""Strongest rows in reach and scoring by stored models against plain versions."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import neighbors, scoring


@pytest.mark.parametrize(("radius", "k", "n"), [(400.0, 3, 60), (90.0, 5, 60), (3000.0, 2, 3), (500.0, 2, 0)])
def test_strongest_matches_all_pairs(spark, radius, k, n):
    draw = np.random.default_rng(int(radius))
    left = [(i, int(x), int(y)) for i, (x, y) in enumerate(draw.integers(0, 1000, (80, 2)))]
    right = [(100 + i, int(x), int(y), float(b)) for i, (x, y, b) in enumerate(zip(draw.integers(0, 1000, n), draw.integers(0, 1000, n), draw.integers(0, 4, n), strict=True))]
    power = lambda base, distance: F.round(base - distance / 100, 2)
    found = neighbors.strongest(spark.createDataFrame(left, "id bigint, lx bigint, ly bigint"), spark.createDataFrame(right, "other bigint, rx bigint, ry bigint, base double"), "id", "other", radius, k, power, -8.0)
    want = []
    for i, x, y in left:
        near = sorted((-round(b - d / 100, 2), o) for o, u, v, b in right if (d := np.hypot(x - u, y - v)) <= radius and round(b - d / 100, 2) > -8)
        want += [(i, o, pytest.approx(-p, abs=0.011), r) for r, (p, o) in enumerate(near[:k], 1)]
    got = sorted((r["id"], r["other"], r["power"], r["rank"]) for r in found.collect())
    assert len(got) == len(want) and [(g[0], g[3]) for g in sorted(got, key=lambda g: (g[0], g[3]))] == [(w[0], w[3]) for w in want]
    assert [g[2] for g in sorted(got, key=lambda g: (g[0], g[3]))] == [w[2] for w in want]


def _load(content: bytes) -> list[float]:
    return json.loads(content)


def _predict(model: list[float], x: np.ndarray) -> np.ndarray:
    assert len(x) <= 2
    return x @ np.array(model)


def test_scores_in_small_calls_with_unknown_features(spark):
    path, digest = scoring.publish(spark, json.dumps([2.0, -1.0]).encode())
    rows = spark.createDataFrame([(i, float(i), None if i == 3 else i * 10, "x") for i in range(7)], "id bigint, a double, b int, score string")
    found = {r["id"]: r["score"] for r in scoring.score(rows, ["a", "b"], path, digest, _load, _predict, call_bytes=32).collect()}
    assert found == {i: None if i == 3 else 2.0 * i - 10 * i for i in range(7)}
    assert scoring.score(rows.limit(0), ["a"], path, digest, _load, _predict).count() == 0
    with pytest.raises(Exception, match="digest"):
        scoring.score(rows, ["a", "b"], path, "0" * 64, _load, _predict).collect()
