"""The inverted multi-index: traversal in order, slices and batches, any label type, recall."""

from __future__ import annotations

import numpy as np
import pytest

from quadrille.llm import embedding_dedup as E


def test_traversal_yields_cells_in_order_up_to_the_bound():
    draw = np.random.default_rng(2)
    for n, m, most in ((1, 1, 0.5), (7, 4, 0.8), (20, 30, 0.6), (5, 5, 9.0)):
        left, right = draw.random(n), draw.random(m)
        found = list(E.traverse(left, right, most))
        sums = [left[i] + right[j] for i, j in found]
        assert sums == sorted(sums) and len(set(found)) == len(found)
        assert set(found) == {(i, j) for i in range(n) for j in range(m) if left[i] + right[j] <= most}


@pytest.mark.parametrize("size", [4096, 7])
def test_links_match_brute_force_and_recall_is_measured(spark, monkeypatch, size):
    monkeypatch.setattr(E, "SLICE", size)
    monkeypatch.setattr(E, "BATCH", size)
    monkeypatch.setattr(E, "CELL_ROWS", 2)
    draw = np.random.default_rng(5)
    hubs = draw.normal(size=(30, 16))
    rows = []
    for i in range(400):
        v = hubs[i % 30] + (0 if i % 4 == 0 else draw.uniform(0, 0.25)) * draw.normal(size=16)
        rows.append((i, [float(x) for x in (v if i % 8 == 0 else v * draw.uniform(0.5, 2))], f"label {i % 2}"))
    rows += [(1000 + i, [0.0, -0.0 if i else 0.0, 1.0], "label 0") for i in range(3)]
    n_links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    for a, v, label in rows:
        for b, w, other in rows:
            if a != b and label == other and len(v) == len(w) and np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w)) >= 0.98:
                n_links[a] += 1
                x, y = sorted((root[a], root[b]))
                root = {k: x if r == y else r for k, r in root.items()}
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.links(docs).collect()}
    assert found == {i: (n_links[i], root[i], root[i] == i) for i in root}
    measured = E.recall(docs, every=5).first()
    assert measured["links"] == measured["found"] == sum(n for i, n in n_links.items() if i % 5 == 0) > 100


def test_very_small_and_very_large_vectors_link(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [2e-200, 2e-200]), (3, [1e200, 1e200]), (4, [1e200, 1e200]), (5, [5e-324, 0.0]), (6, [1.7e308, 0.0]), (7, [0.0, 0.0]), (8, [float("inf"), 1.0]), (9, [-1.0, -1.0])]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.links(docs).collect()}
    assert found == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9)}


def test_recall_below_one_is_measured(spark):
    draw = np.random.default_rng(8)
    hubs = draw.normal(size=(40, 16))
    rows = [(i, [float(x) for x in hubs[i % 40] + 0.05 * draw.normal(size=16)], 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    whole, less = (E.recall(docs, slack=s, every=5).first() for s in (1.0, 0.3))
    assert whole["found"] == whole["links"] == less["links"] > 50 and 0 < less["found"] <= less["links"]
