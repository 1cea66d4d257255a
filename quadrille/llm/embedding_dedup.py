"""Embedding near-duplicates (operator 5) by an inverted multi-index.

Unit vectors are cut in halves; each half has a codebook of its own, fitted on a bounded sample. The
pairs of codewords form a grid of cells, and every vector is filed in one. A query visits cells by
multi-sequence traversal: both halves' codewords are sorted by how near their Voronoi cells are, and a
heap over pairs of positions yields cells in order of the summed bounds. It stops where the sum passes
``slack`` times the distance that the wanted cosine allows. With ``slack`` 1 no link can be in a cell
beyond, so the recall is 1; a smaller ``slack`` visits fewer cells, and ``recall`` measures by brute
force what it loses.

A link's two cells each see the other, so a query visits only cells that don't come before its own.
Members of visited cells are compared in double precision. Only vectors of one length can link, so each
length present has codebooks and a grid of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import discard, join_few, read, spool
from quadrille.llm.components import components

#: Vectors that all codebooks are fitted on, at most; all vectors are indexed and compared.
SAMPLE = 20_000
#: Vectors of one label that share a cell, about; the codebooks' size follows from it, and grows with
#: the rows as long as the sample has this many vectors for each word.
CELL_ROWS, WORD_ROWS = 24, 10
#: Members of a cell that one group compares; fuller cells are cut into slices.
SLICE = 4096
#: Queries that one group compares with a slice.
BATCH = 4096
SEED = 20240518


def codebook(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means; fewer words than ``k`` if there are fewer points."""
    points = np.unique(points, axis=0)
    draw = np.random.default_rng(seed)
    words = points[draw.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([_square_distances(points[lo : lo + 1000], words).argmin(1) for lo in range(0, len(points), 1000)])
        sums = np.zeros_like(words)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(words))
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return np.unique(words, axis=0)


def _square_distances(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(1)[:, None] - 2 * points @ words.T + (words**2).sum(1))


def _own(square: np.ndarray) -> np.ndarray:
    return square.argmin(1)


def _bounds(square: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Square distances of each point to each word's Voronoi cell, from below."""
    own = _own(square)
    apart = np.sqrt(_square_distances(words, words))[own]
    gap = (square - square[np.arange(len(square)), own][:, None]) / (2 * np.maximum(apart, 1e-300))
    gap[np.arange(len(square)), own] = 0
    return np.maximum(0, gap) ** 2


def unit(v: Column) -> Column:
    """A vector that isn't zero, with length 1: divided by its largest component first, so that no square is lost."""
    largest = F.array_max(F.transform(v, lambda x: F.abs(x)))
    scaled = F.zip_with(v, F.array_repeat(largest, F.size(v)), lambda x, m: x / m)
    length = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x))
    return F.zip_with(scaled, F.array_repeat(length, F.size(v)), lambda x, n: x / n)


def valid(vectors: DataFrame) -> DataFrame:
    """One row a distinct (label, vector) that can link: first (the least vec_id), copies, label, v (double).

    Null, empty, zero and non-finite vectors, null labels and null ids are left out.
    """
    v = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.coalesce(sound, F.lit(False))).select("vec_id", "label", v.alias("v")).filter(F.exists("v", lambda x: x != 0))
    return kept.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))


def _books(rows: DataFrame, sizes: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Both halves' codebooks of each length, fitted on about equally many vectors of each; a single word without any."""
    spark = rows.sparkSession
    counts = spark.createDataFrame([(r["width"], r["n"]) for r in sizes], "width int, n bigint")
    # A vector's share of the hash range times its length's count is about its rank within its length.
    rank = (F.xxhash64(F.lit(SEED), "first").cast("double") / 2.0**64 + 0.5) * F.col("n")
    sample = rows.join(F.broadcast(counts), "width").select("v", rank.alias("rank")).orderBy("rank").limit(SAMPLE).select("v").toPandas()
    drawn: dict[int, list[np.ndarray]] = {}
    for v in sample["v"]:
        drawn.setdefault(len(v), []).append(v)
    books = {}
    for r in sizes:
        width = r["width"]
        points = np.stack(drawn.get(width, [np.zeros(width)]))
        words = int(np.clip(np.sqrt(r["n"] / r["labels"] / CELL_ROWS), 1, max(1, len(points) // WORD_ROWS)))
        half = max(1, width // 2)
        books[width] = codebook(points[:, :half], words, SEED), codebook(points[:, half:], words, SEED + 1)
    return books


def traverse(left: np.ndarray, right: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) in order of left[i] + right[j], up to ``most``: the multi-sequence algorithm."""
    by_left, by_right = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    x, y = left[by_left].tolist(), right[by_right].tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > most:
            return
        yield by_left[i], by_right[j]
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def _index(rows: DataFrame, books: dict[int, tuple[np.ndarray, np.ndarray]], radius2: float) -> DataFrame:
    """Every vector filed under its length's cell, and sent as a query to the cells it visits."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_width(batches):
            left, right = shared.value[batch["width"][0].as_py()]
            half = left.shape[1]
            points = _matrix(batch["v"])
            a, b = points[:, :half], points[:, half:]
            da, db = _square_distances(a, left), _square_distances(b, right)
            own = _own(da) * len(right) + _own(db)
            la, lb = _bounds(da, left), _bounds(db, right)
            rows_, cells = [], []
            for i, home in enumerate(own.tolist()):
                visited = [c for x, y in traverse(la[i], lb[i], radius2) if (c := x * len(right) + y) >= home]
                cells += visited
                rows_ += [i] * len(visited)
            at = np.concatenate([np.arange(len(points)), np.array(rows_, np.int64)])
            member = np.arange(len(at)) < len(points)
            out = batch.select(["label", "width", "first", "copies", "v"]).take(pa.array(at))
            yield out.append_column("cell", pa.array(np.concatenate([own, np.array(cells, np.int64)]), pa.int64())).append_column("home", pa.array(np.concatenate([own, own[np.array(rows_, np.int64)]]), pa.int64())).append_column("member", pa.array(member))

    kind = dict(rows.dtypes)["label"]
    return rows.mapInArrow(file, f"label {kind}, width int, first bigint, copies bigint, v array<double>, cell bigint, home bigint, member boolean")


def _by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs, those of each length apart."""
    for batch in batches:
        widths = batch["width"].to_numpy()
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            for lo in range(0, len(at), 1000):  # each row comes out once for each cell it visits
                yield batch.take(pa.array(at[lo : lo + 1000]))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _compare(least: float):
    """Links of a group's queries with its members. Both ends get their counts; within the queries' own
    cell both are queries, so a pair is seen from either side and counts for the query alone."""

    def compare(table: pa.Table) -> pa.Table:
        member = table["member"].to_numpy()
        v = _matrix(table["v"].combine_chunks())
        first, copies, home = table["first"].to_numpy(), table["copies"].to_numpy(), table["home"].to_numpy()
        cell = table["cell"].to_numpy()
        members, queries = np.flatnonzero(member), np.flatnonzero(~member)
        norm = np.sqrt((v * v).sum(1))
        n_links = np.zeros(len(v), np.int64)
        hub: dict[int, int] = {}

        def root(x: int) -> int:
            while hub.get(x, x) != x:
                hub[x] = hub.get(hub[x], hub[x])
                x = hub[x]
            return x

        for lo in range(0, len(queries), 512):
            q = queries[lo : lo + 512]
            linked = (v[q] @ v[members].T) / (norm[q][:, None] * norm[members]) >= least
            linked &= first[q][:, None] != first[members]
            n_links[q] += linked @ copies[members]
            away = home[q] != cell[q]
            n_links[members] += copies[q[away]] @ linked[away]
            for i in np.flatnonzero(linked.any(1)):
                a = root(int(first[q[i]]))
                for m in first[members[linked[i]]].tolist():
                    b = root(m)
                    if a != b:
                        a, b = min(a, b), max(a, b)
                        hub[b] = a
        nodes = sorted(hub)
        counted = np.flatnonzero(n_links)
        return pa.table({
            "first": pa.array(np.concatenate([first[counted], np.array(nodes, np.int64)])),
            "n_links": pa.array(np.concatenate([n_links[counted], np.zeros(len(nodes), np.int64)])),
            "root": pa.array([None] * len(counted) + [root(x) for x in nodes], pa.int64()),
        })

    return compare


def links(vectors: DataFrame, least: float = 0.98, slack: float = 1.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows link when their labels (of any type) are equal and not null, their vectors have one length
    and their cosine is at least ``least``. Exact copies are compared once for all; a row's other rows
    with the same id and vector count as its links. Rows with a null id have no links and a null
    component. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing. Other columns are left aside; an empty table gives an empty one.
    """
    kept = spool(valid(vectors), "vectors")
    rows = kept.withColumn("width", F.size("v"))
    sizes = rows.groupBy("width").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).collect()
    if sizes:
        found = _found(rows.withColumn("v", unit(F.col("v"))), sizes, least, slack)
        other = found.groupBy("first").agg(F.sum("n_links").alias("n_links"))
        joined = components(found.filter("root is not null").select(F.col("first").alias("a"), F.col("root").alias("b")))
        classes = rows.join(other, "first", "left").join(joined, rows["first"] == joined["node"], "left")
    else:
        classes = rows.withColumns({"n_links": F.lit(0), "component": F.lit(None).cast("bigint")})
    classes = classes.select("first", "copies", "label", "v", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    # Only rows that something links are looked up, copies by their vector and others by their id.
    named = spool(classes.filter("n_links > 0"), "vector-classes")
    discard(kept, *([found] if sizes else []))
    every = vectors.select("vec_id", F.when(F.col("vec_id").isNotNull(), _mark(F.col("label"), F.col("embedding").cast("array<double>"))).alias("mark"))
    full = join_few(every, named.select(_mark(F.col("label"), F.col("v")).alias("mark"), "n_links", "component_id"), "mark", F.col("vec_id"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).cast("bigint")
    return full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _mark(label: Column, v: Column) -> Column:
    """Equal vectors of a label have equal marks of 128 bits, and -0 is 0; two of V others share one with odds of V^2 / 2^129."""
    plain = F.transform(v, lambda x: x + F.lit(0.0))
    return F.struct(F.xxhash64(label, plain).alias("a"), F.xxhash64(F.lit(SEED), plain, label).alias("b"))


def _found(rows: DataFrame, sizes: list, least: float, slack: float) -> DataFrame:
    """(first, n_links, root): what each group of queries and members found."""
    radius2 = (2 - 2 * least) * slack**2 + 1e-9
    filed = spool(_index(rows, _books(rows, sizes), radius2), "multi-index")
    cell = ["label", "width", "cell"]
    counts = filed.groupBy(*cell).agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("q")).withColumns({"slices": F.ceil(F.col("m") / SLICE), "batches": F.ceil(F.col("q") / BATCH)}).filter("m > 0 and q > 0")
    cut = filed.join(counts.select(*cell, "slices", "batches"), cell)
    mark = F.xxhash64(F.lit(SEED), "first")
    own_slice, own_batch = F.pmod(mark, F.col("slices")).cast("int"), F.pmod(mark, F.col("batches")).cast("int")
    # A member meets every batch of queries, a query every slice of members.
    to_batches = F.transform(F.sequence(F.lit(0), (F.col("batches") - 1).cast("int")), lambda b: F.struct(own_slice.alias("slice"), b.alias("batch")))
    to_slices = F.transform(F.sequence(F.lit(0), (F.col("slices") - 1).cast("int")), lambda s: F.struct(s.alias("slice"), own_batch.alias("batch")))
    dealt = cut.withColumn("at", F.explode(F.when(F.col("member"), to_batches).otherwise(to_slices)))
    groups = dealt.select(*cell, F.col("at.slice").alias("slice"), F.col("at.batch").alias("batch"), "first", "copies", "v", "home", "member").groupBy(*cell, "slice", "batch")
    found = spool(groups.applyInArrow(_compare(least), "first bigint, n_links bigint, root bigint"), "vector-links")
    discard(filed)
    return found


def recall(vectors: DataFrame, least: float = 0.98, slack: float = 1.0, every: int = 50) -> DataFrame:
    """(links, found): of the rows whose id is divisible by ``every``, links by brute force and by the index.

    The queries are compared with all rows of their label; this is a measure, not a step of the work.
    """
    v = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    rows = vectors.filter(F.coalesce(sound, F.lit(False))).select("vec_id", "label", v.alias("v")).filter(F.exists("v", lambda x: x != 0)).withColumn("v", unit(F.col("v")))
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), "label", F.col("v").alias("w"))
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    linked = rows.join(asked, "label").filter((F.size("v") == F.size("w")) & (F.col("q") != F.col("vec_id")) & (dot >= least))
    true = linked.groupBy("q").count()
    own = links(vectors, least, slack).filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), "n_links")
    return own.join(true, "q", "left").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("links"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("found"))


def op5_embedding_links(spark, sf_dir: str) -> DataFrame:
    return links(read(spark, sf_dir, "embeddings"), 0.98)
