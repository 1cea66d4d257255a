"""Queries over all draws and points against brute force on the small table."""

from __future__ import annotations

import numpy as np
import pytest

from quadrille.fixtures import BUFFER_M, SEEDS, draws, nodes
from quadrille.operators import partition
from quadrille.plans import blocks
from quadrille.plans.joins import _points
from quadrille.plans.registry import QUERIES
from tests import oracle


def test_trims_and_verification_cover_all_draws(spark):
    table = nodes(spark, oracle.SF_DIR)
    rows = table.select("node_id", "block_id", "x_m", "y_m").orderBy("node_id").toPandas()
    roles = partition.roles(draws(table.select("block_id"))).toPandas()
    x, y = rows["x_m"].to_numpy(), rows["y_m"].to_numpy()
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 < BUFFER_M**2
    counts, kept = set(), set()
    for seed in range(SEEDS):
        role = rows["block_id"].map(roles[roles["seed"] == seed].set_index("block_id")["role"]).to_numpy()
        train = role == "train"
        free = ~near[:, train].any(1)
        val = (role == "val") & free
        test = (role == "test") & free & ~near[:, val].any(1)
        counts |= {(seed, name, int(m.sum()), int(m.sum()), 0) for name, m in (("train", train), ("val", val), ("test", test)) if m.any()}
        kept |= {(seed, int(i), name) for name, m in (("val", val), ("test", test)) for i in rows["node_id"][m]}
    found = QUERIES["b10_split_verification_of_all_draws"](spark, oracle.SF_DIR).select("seed", "role", "n", "n_distinct", "clashes").collect()
    assert {tuple(r) for r in found} == counts and len(found) == len(counts)
    found = QUERIES["j03_direct_trim_of_all_draws"](spark, oracle.SF_DIR).select("seed", "node_id", "role").collect()
    assert {tuple(r) for r in found} == kept and len(found) == len(kept)


def test_all_points_get_their_eight_nearest(spark):
    rows, want = nodes(spark, oracle.SF_DIR).select("node_id", "x_m", "y_m").toPandas(), set()
    for pt, px, py in _points(spark, oracle.SF_DIR).collect():
        d2 = ((rows["x_m"] - px) ** 2 + (rows["y_m"] - py) ** 2).to_numpy()
        want |= {(pt, int(rows["node_id"][i]), int(d2[i]), k + 1) for k, i in enumerate(np.lexsort((rows["node_id"], d2))[:8])}
    found = QUERIES["j08_k_nearest_weights_of_all_points"](spark, oracle.SF_DIR).select("pt", "node_id", "d2", "rank").collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_too_many_blocks_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_BLOCKS", 5)
    with pytest.raises(ValueError):
        QUERIES["b01_legacy_generator_draws"](spark, oracle.SF_DIR)
