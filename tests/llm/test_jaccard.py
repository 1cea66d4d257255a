"""Large slabs, trees of several levels, very frequent shingles and repeated keys, by brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quadrille.llm import jaccard as J


def brute(rows):
    own = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} if (w := (t or "").lower().split()) else set() for i, t in rows}
    root = {i: i for i in own}
    for a in own:
        for b in own:
            both = len(own[a] & own[b])
            if b < a and own[a] and own[b] and 100 * both >= 75 * (len(own[a]) + len(own[b]) - both):
                x, y = sorted((root[a], root[b]))
                root = {k: x if r == y else r for k, r in root.items()}
    return root, own


@pytest.mark.parametrize(("page", "parts", "rounds"), [(64, 64, 4), (2, 3, 4), (3, 2, 2)])
def test_classes_match_brute_force(spark, monkeypatch, page, parts, rounds):
    monkeypatch.setattr(J, "PAGE", page)
    monkeypatch.setattr(J, "PARTS", parts)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    draw = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    passage = " ".join(f"shared{i}" for i in range(30))
    texts = [" ".join(x if draw.random() > 0.04 else f"x{draw.random()}" for x in base) for _ in range(60)]
    texts += [passage + " " + " ".join(f"own{k}x{i}" for i in range(draw.randint(4, 25))) for k in range(40)]
    texts += [" ".join(base[: 20 + k]) for k in range(0, 40, 2)] + [None, "", "one two", "One TWO", "one two three four five"]
    rows = list(enumerate(texts))
    root, own = brute(rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert found == {i: (len(own[i]), root[i]) for i in root}
    assert 5 < len(set(root.values())) < len(root) - 40


def test_one_row_of_each_class_stays(spark):
    long = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"term{i}" for i in range(40))
    rows = [
        (None, long, "a"), (None, long + " more", "b"), (5, long, "c"), (7, long, "d"),
        (1, other, "e"), (1, other, "e"), (1, "quite another text under the same id here", "f"),
        (None, "a lone text without an id that stays here", "g"), (9, None, "h"), (9, None, "h"), (9, "", "i"),
        (None, other.replace("term", "part"), "j"), (None, other.replace("term", "part") + " x", "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted(r["key"] for r in kept.collect())
    assert found in ([*"cefghhi", last] for last in "jk")
    assert J.keep_one(docs.limit(0)).count() == 0


def test_trees_end_over_more_ranges_than_a_page_holds(spark, monkeypatch):
    monkeypatch.setattr(J, "PAGE", 2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    draw = random.Random(4)
    passage = [f"shared{i}" for i in range(30)]
    texts = [" ".join(passage + [f"own{k}x{i}" for i in range(draw.randint(6, 25))]) for k in range(90)]
    texts += [t + " more" for t in texts[:5]]
    rows = list(enumerate(texts))
    root, own = brute(rows)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = {r["doc_id"]: r["component_id"] for r in J.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == root and len(set(root.values())) > 60


def test_numbers_of_nodes_shrink_to_one(spark, monkeypatch):
    monkeypatch.setattr(J, "PAGE", 2)
    pages = [(h, (r << J.RANGE_BIT) + i) for h, most in ((1, 9), (2, 1)) for r in range(most) for i in range(5)]
    level, sizes = spark.createDataFrame(pages, "h bigint, page bigint"), []
    while not sizes or sizes[-1] > 2:
        own = J._with_parents(level).select("h", "parent").distinct().withColumnRenamed("parent", "page").collect()
        level = spark.createDataFrame([tuple(r) for r in own], "h bigint, page bigint")
        sizes.append(len(own))
        assert len(sizes) < 12
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 2


def test_a_large_group_has_no_more_pairs_a_round_than_sets(spark, monkeypatch):
    draw = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(x if draw.random() > 0.03 else f"x{draw.random()}" for x in base) for _ in range(70)]
    texts += [" ".join([f"own{k}x{i}" for i in range(20)] + base[:60] + [f"end{k}x{j}" for j in range(m)]) for k in range(6) for m in range(12)]
    rows = list(enumerate(texts))
    root, _ = brute(rows)
    sizes, hubs = [], J._hubs
    monkeypatch.setattr(J, "_hubs", lambda *x: (found := hubs(*x), sizes.append(found.count()))[0])
    monkeypatch.setattr(J, "ROUNDS", 1)
    found = {r["doc_id"]: r["component_id"] for r in J.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == root
    assert 0 < max(sizes) <= len(rows), sizes


def test_one_pair_of_two_components_goes_first(spark, monkeypatch):
    of = {i: i // 10 * 10 + 1 for i in (1, 2, 3, 11, 12, 13, 21, 22, 23)}
    stars = J.spool(spark.createDataFrame(list(of.items()), "node bigint, component bigint"), "stars")
    most = {(3, 13), (2, 22), (11, 23)}
    rows = [(a, b, of[a], of[b], 9 if (a, b) in most else 1) for a in of for b in of if of[a] < of[b]]
    links = spark.createDataFrame([(3, 13), (1, 21)], "a bigint, b bigint")
    asked = []

    def verify(pairs, *_):
        asked.append({tuple(r) for r in pairs.select("a", "b").collect()})
        return J.spool(pairs.select("a", "b").join(links, ["a", "b"], "left_semi"), "verified")

    monkeypatch.setattr(J, "_verify", verify)
    pairs = J.spool(spark.createDataFrame(rows, "a bigint, b bigint, u bigint, v bigint, slabs bigint"), "pairs")
    found = {tuple(r) for r in J._settled(pairs, None, 75, stars).collect()}
    assert asked == [most, {(a, b) for a, b, _, v, _ in rows if v == 21} - most]
    assert found == {(i, 1) for i in of}


def _hashed(sizes, shared, seed):
    draw = np.random.default_rng(seed)
    values = np.unique(draw.integers(0, 1 << 48, sum(sizes) + 200, dtype=np.uint64))
    draw.shuffle(values)
    common, rest, out = values[:shared], values[shared:], []
    for n in sizes:
        own, rest = rest[: n - shared], rest[n - shared :]
        out.append(np.sort(np.concatenate([common, own])))
    return out


def test_pairs_just_short_of_a_link_do_not_survive_a_page_of_small_sets():
    # Pairs share 118 of 146, of which a link needs 126; a set of 16 beside them coarsens nothing.
    sets = [*_hashed([146] * 40, 118, 1), np.sort(np.random.default_rng(2).integers(0, 1 << 48, 16, dtype=np.uint64))]
    points, n = [J._point(x) for x in sets], np.array([len(x) for x in sets])
    p, q = np.triu_indices(40, 1)
    found = J._reaches(points, n, p, q)
    assert (found >= 118).all() and (found * 175 >= 75 * 292).mean() < 0.05
    mixed = J._reaches(points, n, np.append(p, 0), np.append(q, 40))
    assert (mixed[:-1] == found).all() and mixed[-1] <= 16


@pytest.mark.parametrize("sizes", [(30, 40), (300, 310), (1100, 1000), (16, 5000)])
def test_bounds_are_never_below_the_overlap(sizes, monkeypatch):
    a, b = _hashed(sizes, min(sizes) - 5, 3)
    for groups in (None, 16, 2):
        if groups:
            # Counts that a byte can't hold.
            monkeypatch.setattr(J, "groups_of", lambda n, groups=groups: groups)
        assert J._reaches([J._point(a), J._point(b)], np.array(sizes), np.array([0]), np.array([1]))[0] >= min(sizes) - 5
        assert (J._counts(J._point(a), len(a), 2) >= np.bincount((a >> np.uint64(47)).astype(np.int64), minlength=2)).all()


def test_shingles_that_three_sets_of_a_run_share_are_told(spark):
    texts = ["a b c d e f g", "b c d e f g h", "c d e f g h i", "d e f g h i j", "c d e f g h i"]
    rows = J.sets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)).collect()
    told = [r for r in rows if r["n"] is None]
    assert len(told) == 1
    values, counts = J._unpack(told[0]["hashes"]), np.frombuffer(told[0]["counts"], "<u4")
    owners = [set(J._unpack(r["hashes"]).tolist()) for r in {r["sid"]: r for r in rows if r["n"]}.values()]
    assert {v: k for v, k in zip(values.tolist(), counts.tolist(), strict=True)} == {v: k for v in set().union(*owners) if (k := sum(v in o for o in owners)) > 2}
    assert len(values) == 2
