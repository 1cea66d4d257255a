"""The trimmed estimators against brute force on the small table."""

from __future__ import annotations

import numpy as np
import pytest

from quadrille.fixtures import BUFFER_M, SEEDS, draws, features
from quadrille.operators import partition
from quadrille.plans.registry import QUERIES
from tests import oracle


@pytest.fixture(scope="module")
def truth(spark):
    """Nodes, and for each draw the numbers of the test nodes left: two cuts by distance, all pairs compared."""
    table = features(spark, oracle.SF_DIR)
    rows = table.select("node_id", "block_id", "gx", "gy", "x_m", "y_m", "is_sentinel", "rssi", "rssi_pred").orderBy("node_id").toPandas()
    roles = partition.roles(draws(table.select("block_id"))).toPandas()
    x, y = rows["x_m"].to_numpy(), rows["y_m"].to_numpy()
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 < BUFFER_M**2
    left = []
    for seed in range(SEEDS):
        role = rows["block_id"].map(roles[roles["seed"] == seed].set_index("block_id")["role"]).to_numpy()
        free = ~near[:, role == "train"].any(1)
        left.append(np.flatnonzero((role == "test") & free & ~near[:, (role == "val") & free].any(1)))
    return rows, left


def test_trimmed_estimators_match_brute_force(spark, truth):
    rows, left = truth
    e = (rows["rssi_pred"] - rows["rssi"]).abs().round(6).to_numpy()
    block, sentinel = rows["block_id"].to_numpy(), rows["is_sentinel"].to_numpy()
    p = np.bincount(np.concatenate(left), minlength=len(rows)) / SEEDS
    occupied = len(set(block))
    box = (rows["gx"].max() - rows["gx"].min() + 1) * (rows["gy"].max() - rows["gy"].min() + 1)
    want = {k: {} for k in (1, 3, 4, 6, 7, 8, 9)}
    for pop, member in (("valid", ~sentinel), ("sentinel", sentinel), ("all", np.ones(len(rows), bool))):
        errs, sizes, sums, vs, weight = [], [], [], [], np.zeros(len(rows))
        for seed, test in enumerate(left):
            i = test[member[test]]
            if not len(i):
                continue
            err, own = e[i].mean(), sorted(set(block[i]))
            k, s, m = len(own), np.array([e[i][block[i] == b].sum() for b in own]), np.array([(block[i] == b).sum() for b in own])
            want[1][seed, pop] = (err, len(i), k)
            want[3][seed, pop] = ((e[i] / p[i]).sum() / (1 / p[i]).sum(),)
            v = k / (k - 1) * ((s - err * m) ** 2).sum() / len(i) ** 2 if k >= 2 else None
            for name, n in (("occupied", occupied), ("box", box), ("none", np.inf)):
                want[8][seed, pop, name] = (k, err, None if v is None else v * (1 - k / n))
            weight[i] += 1 / len(i)
            errs.append(err), sizes.append(len(i)), sums.append(e[i].sum()), vs.append(v)
        errs, sizes, bias = np.array(errs), np.array(sizes), np.mean(errs) - e[member].mean()
        se = errs.std(ddof=1) / np.sqrt(len(errs))
        want[4][(pop,)] = (len(errs), SEEDS - len(errs), bias, se, bias / se, np.sqrt(((errs - e[member].mean()) ** 2).mean()), errs.var(ddof=1))
        want[6][(pop,)] = (errs.mean() - sum(sums) / sizes.sum(), -np.cov(errs, sizes, ddof=0)[0, 1] / sizes.mean())
        want[7] |= {(int(rows["node_id"][i]), pop): (weight[i] / len(errs),) for i in np.flatnonzero(weight)}
        defined = np.array([v is not None for v in vs])
        for name in ("occupied", "box", "none"):
            known = [want[8][seed, pop, name] for seed in range(SEEDS) if (seed, pop) in want[1]]
            v, at = np.array([x[2] for x in known if x[2] is not None]), errs[defined]
            for reading, ref in (("A", errs), ("B", at)):
                want[9][pop, name, reading] = (v.mean() / ref.var(ddof=1), (abs(at - ref.mean()) <= 2 * np.sqrt(v)).mean())
    for k, keys in ((1, 2), (3, 2), (4, 1), (6, 1), (7, 2), (8, 3), (9, 3)):
        name = next(x for x in QUERIES if x.startswith(f"e0{k}_trimmed"))
        found = {tuple(r[:keys]): tuple(r[keys:]) for r in QUERIES[name](spark, oracle.SF_DIR).collect()}
        assert found.keys() == want[k].keys(), name
        for key, values in want[k].items():
            for a, b in zip(found[key], values, strict=True):
                assert (a is None and b is None) or a == pytest.approx(b, rel=1e-7, abs=2e-6), (name, key, found[key], values)
    assert sum(x[0] for k, x in want[7].items() if k[1] == "all") == pytest.approx(1)
