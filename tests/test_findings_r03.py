"""What the third round's findings asked for, on small tables."""

from __future__ import annotations

import numpy as np
import pytest

from quadrille.operators import buffer, distance, neighbors, ranks, reach, records


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_compared_without_a_broadcast(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": [1, 2]}', '{"a": 2, "b": [1]}'), (2, "{}", "{}"), (3, None, "{}")], "id bigint, l string, r string")
    found = records.deep_differences(rows.selectExpr("id", "l as record"), rows.selectExpr("id", "r as record"), "id", "record")
    assert "Broadcast" not in _plan(found)
    assert {tuple(r) for r in found.collect()} == {(1, 2, 2, 1.0), (2, 0, 0, 0.0)}


def test_nearest_rows_up_to_a_limit(spark):
    draw = np.random.default_rng(2)
    xy = draw.integers(0, 100, (300, 2))
    points = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(xy)], "id bigint, x bigint, y bigint")
    left, right = points.selectExpr("id", "x as lx", "y as ly"), points.selectExpr("id as other", "x as rx", "y as ry")
    assert "Broadcast" not in _plan(neighbors.within(left, right, 9.0))
    found = neighbors.k_nearest(left, right, "id", "other", 4, limit=9).select("id", "other", "rank").collect()
    d2 = ((xy[:, None] - xy) ** 2).sum(2)
    want = {(i, int(j), k + 1) for i in range(300) for k, j in enumerate(np.lexsort((np.arange(300), d2[i]))[:4]) if d2[i, j] <= 81}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize(("per_block", "per_piece"), [(10, 7), (1000, 1000)])
def test_sums_and_counts_within_match_brute_force(spark, per_block, per_piece):
    draw = np.random.default_rng(per_block)
    at, of = draw.integers(-50, 150, (400, 2)), draw.integers(-80, 180, (40, 2))
    at[:3], of[0] = (500, 500), (530, 540)
    points = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(at)], "key bigint, lx bigint, ly bigint")
    sites = spark.createDataFrame([(i, int(x), int(y), i % 3, [100 * (i % 5), 400, 2500]) for i, (x, y) in enumerate(of)], "key bigint, rx bigint, ry bigint, base bigint, limits array<bigint>")
    d2 = ((at[:, None] - of) ** 2).sum(2)
    near, base = d2 <= 2500, np.arange(40) % 3
    found = reach.sums_within(points, sites, 50, lambda x: np.multiply(x, 2, out=x), per_block, per_piece).collect()
    want = {(i, int(near[i].sum()), int(((base - 2 * d2[i]) * near[i]).sum())) for i in range(400) if near[i].any()}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    found = reach.counts_within(points, sites, 3, 50, per_block, per_piece).collect()
    want = {(j, *(int((d2[:, j] <= limit).sum()) for limit in (100 * (j % 5), 400, 2500))) for j in range(40) if near[:, j].any()}
    assert {(r["key"], *r["counts"]) for r in found} == want and len(found) == len(want)
    assert reach.sums_within(points, sites.limit(0), 50, lambda x: x).isEmpty() and reach.counts_within(points.limit(0), sites, 3, 50).isEmpty()


@pytest.mark.parametrize(("parts", "per_tile"), [(1, 0.05), (3, 0.1), (4, 8)])
def test_near_groups_by_tiles_cut_again_match_brute_force(spark, parts, per_tile):
    draw = np.random.default_rng(parts)
    xy = np.concatenate([draw.integers(0, 60, (150, 2)), draw.integers(20, 26, (60, 2)), [[-3, -3], [-1, 5]]])
    rows = [(i, int(x) // 20 * 5 + int(y) // 20, int(x), int(y), i % 5) for i, (x, y) in enumerate(xy)]
    docs = spark.createDataFrame(rows, "node_id bigint, block_id bigint, x_m bigint, y_m bigint, grp bigint")
    want = {(a[0], a[1], b[4]) for a in rows for b in rows if a[1] != b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 < 64}
    found = buffer.groups_within(docs, docs, 8, parts, per_tile).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 50


def test_values_by_rank_of_draws_match_numpy(spark):
    draw = np.random.default_rng(8)
    rows = [(int(b), k, None if v > 0.97 else -110.0 if v < 0.3 else round(float(v) * 40 - 100, 6)) for b, k, v in zip(draw.integers(0, 9, 800), "ab" * 400, draw.random(800), strict=True)]
    taken = [(s, b) for s in range(4) for b in range(9) if (b + s) % 3]
    found = ranks.drawn_values(spark.createDataFrame(rows, "block_id bigint, k string, x double"), spark.createDataFrame(taken, "seed bigint, block_id bigint"), ["k"], "x", bins=16).collect()
    own = {(s, k): [x for b, q, x in rows if q == k and x is not None and (s, b) in taken] for s in range(4) for k in "ab"}
    assert {(r["seed"], r["k"]): (r["n"], round(r["x"], 9)) for r in found} == {key: (len(v), round(float(np.median(v)), 9)) for key, v in own.items()}


def test_smallest_rows_by_bins(spark):
    draw = np.random.default_rng(9)
    rows = [(i % 3, i, int(h), (0, 5, 70)[i % 3]) for i, h in enumerate(draw.integers(0, 100, 600))]
    found = ranks.smallest(spark.createDataFrame(rows, "g bigint, id bigint, h bigint, n bigint"), ["g"], "h", "id", "n", 100, 10).collect()
    want = [r for g in range(3) for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))[: (0, 5, 70)[g]]]
    assert sorted(map(tuple, found)) == sorted(want)


def test_direct_trim_shuffles_no_training_node(spark, monkeypatch):
    docs = spark.createDataFrame([(i, i % 3, 40 * (i % 3) + i % 40, i % 37) for i in range(240)], "node_id bigint, block_id bigint, x_m bigint, y_m bigint")
    roles = spark.createDataFrame([(s, b, ("train", "val", "test")[(b + s) % 3]) for s in range(3) for b in range(3)], "seed bigint, block_id bigint, role string")
    written, write = {}, buffer.materialise
    monkeypatch.setattr(buffer, "materialise", lambda df, name: (written.update({name: write(df, name)}), written[name])[1])
    found = {tuple(r) for r in buffer.kept_directly(docs, roles, 6).collect()}
    left = {tuple(r)[:3] for r in written["beyond-training"].collect()}
    assert found <= left and {r[2] for r in left} == {"val", "test"}
    at = {r["node_id"]: (r["block_id"], r["x_m"], r["y_m"]) for r in docs.collect()}
    role = {(r["seed"], r["block_id"]): r["role"] for r in roles.collect()}
    near = lambda i, j: (at[i][1] - at[j][1]) ** 2 + (at[i][2] - at[j][2]) ** 2 < 36
    want = set()
    for s in range(3):
        of = {r: [i for i in at if role[s, at[i][0]] == r] for r in ("train", "val", "test")}
        free = {r: [i for i in of[r] if not any(near(i, j) for j in of["train"])] for r in ("val", "test")}
        want |= {(s, i, "val") for i in free["val"]} | {(s, i, "test") for i in free["test"] if not any(near(i, j) for j in free["val"])}
    assert found == want


@pytest.mark.parametrize("per_piece", [7, 50_000])
def test_nearest_members_of_groups_match_brute_force(spark, per_piece):
    draw = np.random.default_rng(per_piece)
    xy = np.concatenate([draw.integers(0, 400, (900, 2)), draw.integers(170, 190, (200, 2)), [[399, 399], [399, 399], [0, 210], [0, 190]]])
    rows = [(i, int(x) // 200 * 2 + int(y) // 200, int(x), int(y)) for i, (x, y) in enumerate(xy)]
    of = {g: [r for r in rows if r[1] == g] for g in range(4)}
    d2 = lambda a, b: (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2
    best = {(a[0], g): min((d2(a, b), b[0]) for b in of[g]) for a in rows for g in of if g != a[1]}
    want = {(i, g, j, d) for (i, g), (d, j) in best.items() if d < 60 * 60}
    asked = spark.createDataFrame([(i, rows[i][2], rows[i][3], g) for i, g, _, _ in want], "key bigint, lx bigint, ly bigint, grp bigint")
    members = spark.createDataFrame([(i, g, x, y) for i, g, x, y in rows], "nbr_id bigint, grp bigint, rx bigint, ry bigint")
    found = reach.nearest_of_groups(asked, members, 60, per_piece).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 300
    assert reach.nearest_of_groups(asked.limit(0), members.limit(0), 60).isEmpty()


def test_node_classes_write_no_pairs(spark, monkeypatch, tmp_path):
    # 62,308 pairs of different blocks are within reach; the nearest of a near block is asked for 6,807 times.
    from quadrille.plans import blocks

    spark.range(12_000).selectExpr("id as o_orderkey", "1.0D as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(10).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    sizes = {}
    for module in (blocks, reach):
        monkeypatch.setattr(module, "materialise", lambda df, name, write=module.materialise: (found := write(df, name), sizes.update({name: found.count()}))[0])
    assert blocks.j19_node_classes(spark, str(tmp_path)).count() == 12_000
    assert max(sizes.values()) <= 2 * 12_000, sizes


def test_wide_halos_of_a_transform_hold_no_more_pixels(spark, monkeypatch):
    whole = distance._strip

    def guarded(*rest):
        measure = whole(*rest)

        def bounded(targets, events):
            assert len(targets) <= 64 and len(events) <= 8 * 3 * 64, (len(targets), len(events))
            return measure(targets, events)

        return bounded

    monkeypatch.setattr(distance, "_strip", guarded)
    pixels = spark.range(20 * 60).selectExpr("id div 600 as g", "id % 600 div 60 as row", "id % 60 as col")
    sources = spark.createDataFrame([(0, 0, 0), (0, 9, 3), (1, 5, 59)], "g bigint, row bigint, col bigint")
    of = {g: [tuple(r)[1:] for r in sources.filter(f"g = {g}").collect()] for g in range(2)}
    found = distance.distance_transform(pixels, sources, ["g"], 3.0, 2.0, rows=8, columns=8).collect()
    assert len(found) == 1200
    assert {tuple(r) for r in found} == {(g, i, j, float(min(9 * (i - r) ** 2 + 4 * (j - c) ** 2 for r, c in of[g]))) for g in range(2) for i in range(10) for j in range(60)}
