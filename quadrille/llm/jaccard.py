"""N-gram Jaccard join (operator 3) with a count-vector R-tree of hashed groups.

A document's set holds the hashes of its distinct shingles. Hashing shingles into groups makes the set
a point of group counts, and the sum of coordinate minima of two points bounds their sets' overlap
from above. The points are indexed in a packed tree, one forest of it a slab.

Slabs. Bounding boxes over many unrelated points are useless whatever the grouping: their sum of minima
soon exceeds any size. So the tree's first level cuts by single coordinates of the finest grouping, one
group a hash value, where counts are 0 or 1. With the groups in one fixed order, two sets that share none
of their first n - ceil(least * n) + 1 groups have a sum of minima below what a link needs. So a point is
filed under these leading coordinates only and meets just the points of the same slabs. Groups that many
documents fill come last in the order, the fullest at the very end: a passage that thousands of documents
share leads only in those it makes up. An entry notes how many coordinates are left from its own on: in
the first slab that two points share, neither minimum nor overlap can exceed what is left of either, so a
pair for which that is too little is passed over. It either doesn't link or has met in an earlier slab.

Nodes. The points of a slab, those with enough left for a twin of their size first, then in order of
component and size, are packed into leaf pages, pages into nodes above them, and so on. A node's bounding
box (largest count by group, least sizes, most left) bounds the overlap with whatever another node holds.
Pairs of nodes are opened from the top down as far as their boxes' sum of minima can reach a link. Within
opened pages, the points' own sums of minima decide which pairs survive; survivors are verified on the sets.
Points have several groups a shingle, as two sets of a large group of near copies often fall just short of a
link: then few pairs survive that aren't links. A slab of one page needs no box.

Pairs whose ends are known to be in one component need no look. A few rounds first link points with a hub
of their slabs, which joins large groups of near copies with no more pairs a round than they have rows.
Of the pairs left, one of each two components goes first, as one link joins them.

Shingles are 64-bit hashes, of which sets keep 48 bits: two sets of n shingles share one that isn't theirs
with odds of about n^2 / 2^48. Equal sets go by a 64-bit name; two of V sets have the same with odds of
about V^2 / 2^65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import textkit
from quadrille.llm.common import BROADCAST_ROWS, discard, free, in_tasks_of, read, spool
from quadrille.llm.components import components

WORDS = 5
LEAST = 75  # per cent
#: A group that more sets of single runs of rows share is hot: it goes to the end of the order.
HOT = 3
#: Hot groups that are moved at most, those of most rows first; the order, not the result, depends on it.
HOT_GROUPS = 1 << 20
#: Rounds of links with hubs, of which the first go over all slabs, the others over those of more than
#: a page; only speed depends on them.
ROUNDS, FULL_ROUNDS = 4, 2
#: Points a leaf page holds, and nodes a node above.
PAGE = 64
#: Parts of a slab of a hot group, so that its entries needn't meet in one task.
PARTS = 64
SEED = 20240903
#: Pairs of a task that bounds or verifies them.
TASK_PAIRS = 2000
#: Rows of an Arrow batch that hold texts, points, or pairs of sets.
TEXT_ROWS, POINT_ROWS, SET_ROWS = 1000, 1000, 250
#: Shingles that a task remembers at a time to find frequent ones.
SEEN = 1 << 21


def need(n: np.ndarray | int, least: int = LEAST):
    """The least overlap of a set of ``n`` with any set it can link with."""
    return -(-n * least // 100)


def lead(n: np.ndarray | int, least: int = LEAST):
    return n - need(n, least) + 1


def groups_of(n: int) -> int:
    """Groups of a point: the power of two that keeps two to four groups a shingle, up to 131,072 groups."""
    return 1 << max(4, min(17, n.bit_length() + 1))


def sets(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, mark, n, sid, hashes, counts) a row; rows without words have n = 0 and no sid.

    ``mark`` is a hash of the text, ``sid`` names the set, ``hashes`` holds its 48-bit hashes in ascending
    order, six bytes each. Rows without n come in between: after each run of ``SEEN`` shingles one whose
    hashes are those that three sets of the run share, with counts how often (u32).
    """

    def often(run: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(list(run.values()))
        every.sort()
        values = np.unique(every[2:][every[2:] == every[:-2]])
        if len(values):
            n = np.searchsorted(every, values, "right") - np.searchsorted(every, values)
            nothing = pa.array([None], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": nothing, "mark": nothing, "n": nothing, "sid": nothing, "hashes": pa.array([_pack(values)], pa.binary()), "counts": pa.array([n.astype("<u4").tobytes()], pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: dict[int, np.ndarray] = {}
        for batch in batches:
            ns, sids, hashes = [], [], []
            for lo, hi, data, bounds in textkit.text_chunks(batch["text"]):
                found = textkit.words(data, bounds, textkit.SPACES)
                every, _, first = textkit.windows(found, k)
                for i in range(hi - lo):
                    own = np.unique(every[first[i] : first[i + 1]])
                    ns.append(len(own))
                    if not len(own):
                        sids.append(None)
                        hashes.append(None)
                        continue
                    own >>= np.uint64(16)
                    own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                    packed = _pack(own)
                    sids.append(int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little", signed=True))
                    hashes.append(packed)
                    run[sids[-1]] = own
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "mark": batch["mark"], "n": pa.array(ns, pa.int64()), "sid": pa.array(sids, pa.int64()), "hashes": pa.array(hashes, pa.binary()), "counts": pa.array([None] * len(ns), pa.binary())})
            if sum(map(len, run.values())) >= SEEN:
                yield from often(run)
                run.clear()
        if run:
            yield from often(run)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, mark bigint, n bigint, sid bigint, hashes binary, counts binary")


def _pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _point(own: np.ndarray, halvings: int = 0) -> bytes:
    """The counts of a set's groups, a byte each, of which none is above 255; each halving has half the groups."""
    g = groups_of(len(own)) >> halvings
    return np.bincount((own >> np.uint64(48 - (g.bit_length() - 1))).astype(np.int64), minlength=g).clip(max=255).astype(np.uint8).tobytes()


def _counts(point: bytes, n: int, groups: int) -> np.ndarray:
    """A set's counts in ``groups`` groups, none too small: what bytes don't hold of its ``n`` is added to all."""
    own = np.frombuffer(point, np.uint8).reshape(groups, -1).sum(1, dtype=np.int32)
    return own + np.int32(n - own.sum())


def _points(members: DataFrame, few: DataFrame, halvings: int = 0) -> DataFrame:
    """(sid, n, c): the points of the sets that ``few`` names; hashes stay where they are."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_point(_unpack(h), halvings) for h in batch["hashes"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"sid": batch["sid"], "n": batch["n"], "c": pa.array(own, pa.binary())})

    found = members.join(few, "sid", "left_semi").select("sid", "n", "hashes").mapInArrow(place, "sid bigint, n bigint, c binary")
    return found.groupBy("sid").agg(F.first("n").alias("n"), F.first("c").alias("c"))


def hot_groups(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than HOT sets share, as far as runs of rows hold them, in ascending order,
    and the place of each in the order of how many sets do."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in zip(batch["hashes"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"h": pa.array(_unpack(h).astype(np.int64)), "n": pa.array(np.frombuffer(n, "<u4").astype(np.int64))})

    found = rows.filter("n is null").select("hashes", "counts").mapInArrow(open_, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT)
    top = found.orderBy(F.desc("n"), "h").limit(HOT_GROUPS).toPandas()
    fullest_first = top["h"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(fullest_first)
    return fullest_first[order], (len(order) - order).astype(np.int32)


def slabs(rows: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, sid, n, left, hot): every set under its leading coordinates, with how many of its coordinates
    are left from this one on, and whether the group is hot; a partition files equal sets once."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (last, place), seen = shared.value, set()
        for batch in batches:
            hs, sids, ns, lefts, hots = [], [], [], [], []
            for sid, packed in zip(batch["sid"].to_pylist(), batch["hashes"].to_pylist(), strict=True):
                if sid in seen:
                    continue
                seen.add(sid)
                own = _unpack(packed)
                take, cold = lead(len(own)), len(own)
                if len(last):
                    slot = np.searchsorted(last, own)
                    slot[slot == len(last)] = 0
                    late = last[slot] == own
                    if late.any():
                        cold = len(own) - int(late.sum())
                        own = np.concatenate([own[~late], own[late][np.argsort(place[slot[late]])]])
                hs.append(own[:take].astype(np.int64))
                sids.append(np.full(take, sid))
                ns.append(np.full(take, len(own)))
                lefts.append(np.arange(len(own), len(own) - take, -1))
                hots.append(np.arange(take) >= cold)
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, sids, ns, lefts, hots)], names=["h", "sid", "n", "left", "hot"])

    return rows.filter("n > 0").select("sid", "hashes").mapInArrow(file, "h bigint, sid bigint, n bigint, left bigint, hot boolean")


def _near(x: str, y: str, least: int) -> Column:
    """Entries of a slab that can be a link's first: the smaller size reaches the larger, and so does what is left."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    left = F.least(f"{x}left", f"{y}left")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * least) & (left * (100 + least) >= (n + m) * least)


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _surviving(least: int):
    """Pairs whose sum of coordinate minima allows a link."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_bound(a, b, n, m) * (100 + least) >= least * (n + m) for a, b, n, m in zip(batch["ca"].to_pylist(), batch["cb"].to_pylist(), batch["na"].to_pylist(), batch["nb"].to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return bound


def _bound(a: bytes, b: bytes, n: int, m: int) -> int:
    groups = min(len(a), len(b))
    return int(np.minimum(_counts(a, n, groups), _counts(b, m, groups)).sum())


def _verify(pairs: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """Of candidate pairs (a, b), spooled, those that link: first by the bound, with points of half the groups as
    every pair gets two of them, then by the sets."""
    n = pairs.count()
    few = lambda df: in_tasks_of(df, n, TASK_PAIRS)
    ids = lambda df: spool(few(df.select(F.explode(F.array("a", "b")).alias("sid")).distinct()), "ends")
    ends = ids(pairs)
    own = spool(few(_points(members, _few(ends), 1)), "points", POINT_ROWS)
    side = lambda s: own.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("c").alias(f"c{s}"))
    alive = spool(few(few(pairs.join(side("a"), "a")).join(side("b"), "b")).select("a", "b", "na", "nb", "ca", "cb").mapInArrow(_surviving(least), "a bigint, b bigint"), "survivors", POINT_ROWS)
    left = ids(alive)
    held = spool(few(members.join(_few(left), "sid", "left_semi").groupBy("sid").agg(F.first("hashes").alias("hashes"))), "held")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, before, known = [], None, np.zeros(0)
            for a, x, y in zip(batch["a"].to_pylist(), batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                if a != before:
                    before, known = a, _unpack(x)
                other = _unpack(y)
                both = len(known) + len(other)
                common = both - len(np.unique(np.concatenate([known, other])))
                keep.append(100 * common >= least * (both - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = few(alive.join(held.select(F.col("sid").alias("b"), F.col("hashes").alias("y")), "b"))
    with_a = few(with_b.join(held.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), "a")).select("a", "b", "x", "y")
    found = spool(with_a.mapInArrow(overlap, "a bigint, b bigint"), "verified", SET_ROWS)
    discard(pairs, ends, own, alive, left, held)
    return found


def _hubs(filed: DataFrame, round_: int, least: int) -> DataFrame:
    """Pairs of sets with a hub of their slabs in another component: a set's hub is the one of most of its slabs.

    The first round's hub is the smallest set of a slab, later ones draw one a slab. Hubs are found by a partial
    aggregation; the join with them is one that adaptive execution splits where a slab is large. There are
    no more pairs than sets, however many slabs a set of a large group shares with others.
    """
    order = F.struct("n", "sid") if round_ == 0 else F.struct(F.xxhash64(F.lit(SEED + round_), "h", "sid"), F.col("sid"))
    hubs = filed.groupBy("h").agg(F.min_by(F.struct("sid", "n", "left", "comp"), order).alias("hub"))
    paired = filed.join(hubs, "h").filter((F.col("comp") != F.col("hub.comp")) & _near("", "hub.", least))
    shared = paired.groupBy("sid", F.col("hub.sid").alias("to")).agg(F.count("*").alias("slabs"))
    best = shared.groupBy("sid").agg(F.max_by("to", F.struct("slabs", -F.col("to"))).alias("to"))
    return best.select(F.least("sid", "to").alias("a"), F.greatest("sid", "to").alias("b")).distinct()


def _stars(stars: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after ``links``, given those before, spooled."""
    known = links if stars is None else links.unionByName(stars.select(F.col("node").alias("a"), F.col("component").alias("b")))
    found = spool(components(known), "stars")
    discard(links, *([stars] if stars is not None else []))
    return found


def _relabel(filed: DataFrame, stars: DataFrame) -> DataFrame:
    """``filed`` with the components of ``stars``, of slabs that still hold more than one."""
    moves = stars.select(F.col("node").alias("sid"), F.col("component").alias("to"))
    moved = filed.drop("comp").join(_few(moves), "sid", "left").select("h", "sid", "n", "left", F.coalesce("to", "sid").alias("comp"))
    mixed = moved.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("h")
    return spool(moved.join(mixed, "h"), "slabs")


def _large(filed: DataFrame) -> DataFrame:
    """The rows of slabs of more than a page."""
    return filed.join(_few(spool(filed.groupBy("h").count().filter(F.col("count") > PAGE).select("h"), "large")), "h")


def _paged(filed: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """(a, b, u, v, slabs): pairs across components that share a slab and pass the bounds, node against node, page
    against page, with their components, the smaller first, and in how many slabs they met."""
    large = spool(_large(filed), "large-slabs")
    small = spool(filed.join(_few(spool(large.select("h").distinct(), "large")), "h", "left_anti"), "small-slabs")
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, F.col("x.h") == F.col("y.h")).filter((F.col("x.sid") < F.col("y.sid")) & (F.col("x.comp") != F.col("y.comp")) & _near("x.", "y.", least)).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), F.least("x.comp", "y.comp").alias("u"), F.greatest("x.comp", "y.comp").alias("v"))
    count = lambda df: df.groupBy("a", "b", "u", "v").agg(F.count("*").alias("slabs"))
    if large.isEmpty():
        return count(pairs)
    # Runs of a slab lie in ranges of its order, so that no task holds a whole one; a page never leaves its range.
    order = [F.col("left") * (100 + least) < 2 * F.col("n") * least, F.col("comp"), F.col("n"), F.col("sid")]
    dealt = large.repartitionByRange(F.col("h"), *order).withColumn("range", F.spark_partition_id().cast("bigint"))
    at = F.row_number().over(Window.partitionBy("h", "range").orderBy(*order)) - 1
    placed = dealt.withColumn("page", F.shiftleft("range", RANGE_BIT) + F.floor(at / PAGE)).drop("range")
    own = _points(members, _few(spool(large.select("sid").distinct(), "paged"))).select("sid", "c")
    full = spool(placed.join(own, "sid"), "page-rows", POINT_ROWS)
    boxes = [_with_parents(spool(full.groupBy("h", "page").applyInArrow(_box, _BOX), "boxes"))]
    while boxes[-1].groupBy("h").count().filter(F.col("count") > PAGE).limit(1).count():
        boxes.append(_with_parents(spool(_above(boxes[-1]), "boxes")))
    opened = None
    for level in reversed(boxes):
        p, q = level.alias("p"), level.alias("q")
        if opened is None:
            met = p.join(q, (F.col("p.h") == F.col("q.h")) & (F.col("p.page") <= F.col("q.page")))
        else:
            up = opened.select("h", F.col("p").alias("up"), F.col("q").alias("uq"))
            met = up.join(p, (up["h"] == F.col("p.h")) & (up["up"] == F.col("p.parent"))).join(q, (up["h"] == F.col("q.h")) & (up["uq"] == F.col("q.parent"))).filter(F.col("p.page") <= F.col("q.page"))
        opened = spool(met.filter(_reach(least)).select(F.col("p.h").alias("h"), F.col("p.page").alias("p"), F.col("q.page").alias("q")), "opened")
    sides = opened.select("h", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("page"))

    def compare(rows: pa.Table) -> pa.Table:
        page, comp, sid, n, left = (rows[c].to_numpy() for c in ("page", "comp", "sid", "n", "left"))
        first, second = np.flatnonzero(page == page.min()), np.flatnonzero(page == page.max())
        own, other = n[first, None], n[None, second]
        wanted = (own + other) * least
        alive = (comp[first, None] != comp[None, second]) & (np.minimum(own, other) * 100 >= np.maximum(own, other) * least)
        alive &= np.minimum(left[first, None], left[None, second]) * (100 + least) >= wanted
        i, j = np.nonzero(alive)
        if len(i):
            keep = _reaches(rows["c"].to_pylist(), n, first[i], second[j]) * (100 + least) >= wanted[i, j]
            i, j = i[keep], j[keep]
        a, b, u, v = sid[first[i]], sid[second[j]], comp[first[i]], comp[second[j]]
        ends = {"a": np.minimum(a, b), "b": np.maximum(a, b), "u": np.minimum(u, v), "v": np.maximum(u, v)}
        return pa.table({k: pa.array(x, pa.int64()) for k, x in ends.items()})

    deep = full.join(sides, ["h", "page"]).groupBy("h", "p", "q").applyInArrow(compare, "a bigint, b bigint, u bigint, v bigint")
    return count(pairs.unionByName(deep))


def _settled(pairs: DataFrame, members: DataFrame, least: int, stars: DataFrame | None) -> DataFrame:
    """``stars`` after the links of ``pairs`` (as of ``_paged``, spooled).

    One link joins two components, so where components have many pairs, the one of most slabs goes first;
    the others are looked at unless their components have become one.
    """
    first = spool(pairs.groupBy("u", "v").agg(F.max_by(F.struct("a", "b"), F.struct("slabs", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b"), "pairs")
    if 2 * first.count() <= pairs.count():
        done = spool(first, "first-pairs")
        stars = _stars(stars, _verify(first, members, least))
        moves = stars.select(F.col("node").alias("c"), F.col("component").alias("to"))
        now = lambda df, c: df.join(_few(moves).withColumnRenamed("c", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        left = now(now(pairs, "u"), "v").filter("u <> v").join(done, ["a", "b"], "left_anti")
        before, pairs = pairs, spool(left, "pairs")
        discard(before, done)
    else:
        discard(first)
    return _stars(stars, _verify(pairs, members, least))


#: A node: its least and greatest size, the most left, its counts' maxima, its component if it has but one.
_BOX = "h bigint, page bigint, lo bigint, hi bigint, left bigint, top array<int>, only bigint"
#: A node's number has its range from this bit on, and its place in the range below.
RANGE_BIT = 40


def _with_parents(level: DataFrame) -> DataFrame:
    """Adds the number of each node's parent. Runs of PAGE nodes of a range have one; once no range of any
    slab has a second node, runs of PAGE ranges have. So every level has smaller numbers, down to one node."""
    range_, place = F.shiftright("page", RANGE_BIT), F.col("page").bitwiseAND(F.lit((1 << RANGE_BIT) - 1))
    if level.filter(place > 0).limit(1).count():
        parent = F.shiftleft(range_, RANGE_BIT) + F.floor(place / PAGE)
    else:
        parent = F.shiftleft(F.floor(range_ / PAGE), RANGE_BIT)
    return level.withColumn("parent", parent)


def _box(key: tuple, rows: pa.Table) -> pa.Table:
    top = np.max([_counts(c, n, 16) for c, n in zip(rows["c"].to_pylist(), rows["n"].to_pylist(), strict=True)], axis=0)
    n, comps, page = rows["n"].to_numpy(), set(rows["comp"].to_pylist()), key[1].as_py()
    return _node(key[0].as_py(), page, n.min(), n.max(), rows["left"].to_numpy().max(), top.tolist(), comps.pop() if len(comps) == 1 else None)


def _node(h: int, page: int, lo: int, hi: int, left: int, top: list[int], only: int | None) -> pa.Table:
    values = (h, page, int(lo), int(hi), int(left), top, only)
    kinds = [pa.list_(pa.int32()) if x.endswith("array<int>") else pa.int64() for x in _BOX.split(", ")]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _BOX.split(", ")])


def _above(boxes: DataFrame) -> DataFrame:
    """The nodes above ``boxes``: the box of all that share a parent."""

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        only = set(rows["only"].to_pylist())
        return _node(key[0].as_py(), key[1].as_py(), rows["lo"].to_numpy().min(), rows["hi"].to_numpy().max(), rows["left"].to_numpy().max(), np.max(rows["top"].to_pylist(), axis=0).tolist(), only.pop() if len(only) == 1 else None)

    return boxes.groupBy("h", "parent").applyInArrow(join, _BOX)


def _reach(least: int) -> Column:
    """Whether nodes p and q can hold a link: by sizes, by the sum of their boxes' minima and what is left."""
    minima = F.aggregate(F.zip_with(F.col("p.top"), F.col("q.top"), lambda a, b: F.least(a, b).cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + v)
    wanted = (F.col("p.lo") + F.col("q.lo")) * least <= F.least(minima, "p.left", "q.left") * (100 + least)
    sizes = (F.col("p.hi") * 100 >= F.col("q.lo") * least) & (F.col("q.hi") * 100 >= F.col("p.lo") * least)
    return sizes & wanted & ~F.coalesce(F.col("p.only") == F.col("q.only"), F.lit(False))


def _reaches(points: list[bytes], n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sum of coordinate minima of points p[k] and q[k], each pair folded to the coarser of its own two
    groupings: a small set in a page doesn't coarsen what the others are compared by."""
    groups = np.fromiter(map(len, points), np.int64, len(points))
    shared, found = np.minimum(groups[p], groups[q]), np.zeros(len(p), np.int64)
    for g in np.unique(shared):
        of = np.flatnonzero(shared == g)
        held = np.unique(np.concatenate([p[of], q[of]]))
        table = np.stack([_counts(points[x], int(n[x]), int(g)) for x in held])
        for x in np.unique(p[of]):
            own = of[p[of] == x]
            found[own] = np.minimum(table[np.searchsorted(held, x)], table[np.searchsorted(held, q[own])]).sum(1, dtype=np.int64)
    return found


def _linked(rows: DataFrame, least: int) -> DataFrame:
    """(node, component) of all sets of ``rows`` that link with another."""
    members = rows.filter("n > 0").select("sid", "n", "hashes")
    entries = slabs(rows, hot_groups(rows)).withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("sid"), F.lit(PARTS))).otherwise(0))
    # A slab of one set holds no pair; those of hot groups, met in parts, may be such and do no harm.
    shared = entries.selectExpr("*", "min(sid) over (partition by h, part) as lo", "max(sid) over (partition by h, part) as hi").filter("hot or lo < hi")
    filed = spool(shared.select("h", "sid", "n", "left", F.col("sid").alias("comp")).distinct(), "slabs", TEXT_ROWS)
    stars, whole = None, None
    for round_ in range(ROUNDS):
        if round_ == FULL_ROUNDS:
            whole, filed = filed, spool(_large(filed), "large-slabs")
        pairs = spool(_hubs(filed, round_, least), "pairs")
        if round_ >= FULL_ROUNDS and pairs.isEmpty():
            break
        # What is known goes on as stars, so that components settle in few steps.
        stars = _stars(stars, _verify(pairs, members, least))
        before, filed = filed, _relabel(filed, stars)
        discard(before)
    filed = _relabel(whole, stars) if whole else filed
    return _settled(spool(_paged(filed, members, least), "pairs"), members, least, stars)


def classes(docs: DataFrame, k: int = WORDS, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: its class under links of ``least`` per cent.

    Null and empty texts have n_shingles 0 and link with nothing; long texts count whole. Equal rows and
    rows that share a doc_id are one document in the links, and each gets its row. A null doc_id has a
    null component. Other columns are left aside; an empty table gives an empty one.
    """
    rows = spool(sets(docs, k), "sets", TEXT_ROWS)
    joined = _linked(rows, least).withColumnRenamed("node", "sid")
    ids = rows.filter("n is not null").select("doc_id", "n", "sid")
    named = ids.filter("n > 0 and doc_id is not null").select("doc_id", "sid").join(_few(joined), "sid", "left").select("doc_id", "sid", F.coalesce("component", "sid").alias("class"))
    # Rows that share a doc_id tie their classes together; doc_ids of such rows are few.
    twice = named.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b").select("a", "b")
    if not twice.isEmpty():
        ties = components(twice).select(F.col("node").alias("class"), F.col("component").alias("to"))
        named = named.join(ties, "class", "left").select("doc_id", "sid", F.coalesce("to", "class").alias("class"))
    named = spool(named, "classes")
    least_id = named.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    by_sid = named.groupBy("sid").agg(F.min("class").alias("class")).join(least_id, "class").select("sid", "component_id")
    found = spool(ids.join(by_sid, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")), "documents")
    discard(rows, named)
    return found


def keep_one(docs: DataFrame, k: int = WORDS, least: int = LEAST) -> DataFrame:
    """One row of each class of rows whose sets link: that of least doc_id (null last), then of least hash of its text.

    Rows without words all stay; so do rows that share a doc_id unless their sets link. Of rows with
    equal doc_id and text one stays, whichever. All columns are kept; an empty table gives an empty one.
    """
    rows = spool(sets(docs, k), "sets", TEXT_ROWS)
    joined = _linked(rows, least).withColumnRenamed("node", "sid")
    light = rows.filter("n > 0").select("doc_id", "mark", "sid").join(_few(joined), "sid", "left").select("doc_id", "mark", F.coalesce("component", "sid").alias("class"))
    light = light.withColumn("key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    best = spool(light.groupBy("class").agg(F.min("key").alias("best"), F.count("*").alias("n")).filter("n > 1"), "best")
    judged = spool(light.join(_few(best.select("class", "best")), "class").groupBy("doc_id", "mark").agg(F.min(F.col("key") == F.col("best")).alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1"), "judged")
    discard(rows, best)
    gone, twice, key = free("gone", docs), free("twice", docs), free("key", docs)
    # Ids and marks as one text each, as a null id is an id here.
    name = lambda i, m: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), m.cast("string"))
    few = judged.select(name(F.col("doc_id"), F.col("mark")).alias(key), (~F.col("stays")).alias(gone), F.col("stays").alias(twice))
    own = docs.withColumn(key, name(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string"))))
    kept = own.join(_few(few), key, "left").filter(F.coalesce(~F.col(gone), F.lit(True)))
    if judged.filter("stays").isEmpty():
        return kept.select(*docs.columns)
    again = kept.filter(F.col(twice)).groupBy(key).agg(F.first(F.struct(*docs.columns)).alias(gone)).select(f"{gone}.*")
    return kept.filter(F.col(twice).isNull()).select(*docs.columns).unionByName(again)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
