"""Exact Euclidean distance transforms of rasters, and closest pairs of two kinds of points.

The transform is separable. Along columns: a band of rows needs, besides its own sources, only the
last source row above and the first below it, which come from one row a column and band. Along rows:
a strip of columns takes the lower envelope of one parabola a column, of its own columns and of a
halo on both sides. Distances within the halo's reach are final; strips with pixels beyond it go again
with a wider halo and bands as much lower, so that a strip and its halo have no more pixels than before,
and work is linear in pixels.

The closest pair goes from coarse tiles to fine ones. A pair of tiles is kept while its boxes' least
distance doesn't exceed the least of all pairs' greatest distances; the points of the last pairs decide.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quadrille.operators.shared import discard, materialise

#: Rows of a band, and columns of a strip at least; a strip is never narrower than its halo.
BAND, STRIP = 512, 256
#: Cells of the arrays that a task works on at a time.
CELLS = 1 << 20


def lower_envelope(height: np.ndarray, step: float) -> np.ndarray:
    """min over j of height[:, j] + ((i - j) * step)^2 for every column i, of all rows at once.

    Rows keep a stack of the parabolas that are least somewhere, and where each begins to be. Infinite
    heights are no parabolas. Each parabola is pushed and popped once a row.
    """
    n, width = height.shape
    rows = np.arange(n)
    which = np.zeros((n, width), np.int64)
    begin = np.full((n, width + 1), np.inf)
    last = np.full(n, -1)
    squares = (np.arange(width) * step) ** 2
    lifted = height + squares
    for j in range(width):
        new = np.isfinite(height[:, j])
        open_ = new.copy()
        at = np.full(n, -np.inf)
        while True:
            open_ &= last >= 0
            own = rows[open_]
            if not len(own):
                break
            top = which[own, last[own]]
            meet = (lifted[own, j] - lifted[own, top]) / (2 * step * step * (j - top))
            pop = meet <= begin[own, last[own]]
            at[own] = meet
            last[own[pop]] -= 1
            open_[own[~pop]] = False
        at[last < 0] = -np.inf
        last[new] += 1
        own = rows[new]
        which[own, last[own]] = j
        begin[own, last[own]] = at[own]
    out = np.full((n, width), np.inf)
    place = np.zeros(n, np.int64)
    some = last >= 0
    for i in range(width):
        while True:
            go = some & (place < last) & (begin[rows, np.minimum(place + 1, width)] <= i)
            if not go.any():
                break
            place[go] += 1
        j = which[rows, place]
        out[some, i] = (height[rows, j] + ((i - j) * step) ** 2)[some]
    return out


def _vertical(first_row: int, n_rows: int, n_cols: int, row: np.ndarray, col: np.ndarray, step: float) -> np.ndarray:
    """Squared distance to the nearest source of the same column, for a band's rows; sources may lie outside of it."""
    above, below = np.full((n_rows, n_cols), -np.inf), np.full((n_rows, n_cols), np.inf)
    at = row - first_row
    np.maximum.at(above, (np.clip(at, 0, n_rows - 1)[at < n_rows], col[at < n_rows]), at[at < n_rows])
    np.minimum.at(below, (np.clip(at, 0, n_rows - 1)[at >= 0], col[at >= 0]), at[at >= 0])
    own = np.arange(n_rows)[:, None]
    # A source below the band is no source above any of its rows, and the other way round.
    above = own - np.maximum.accumulate(above, 0)
    below = np.minimum.accumulate(below[::-1], 0)[::-1] - own
    return (np.minimum(above, below) * step) ** 2


def _events(sources: DataFrame, by: list[str], rows: int, last_band: int, reach: int | None) -> DataFrame:
    """(by, band, col, row): for each band and column, its own sources, the last above and the first below it.

    ``reach`` bounds how many bands away a source is told, where only near ones matter.
    """
    own = sources.select(*by, "row", "col", F.floor(F.col("row") / rows).alias("band"))
    ends = own.groupBy(*by, "col", "band").agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
    order = Window.partitionBy(*by, "col").orderBy("band")
    placed = ends.withColumns({"after": F.lead("band").over(order), "before": F.lag("band").over(order)})
    low, high = F.coalesce(F.col("before"), F.lit(0)), F.coalesce(F.col("after"), F.lit(last_band))
    if reach is not None:
        low, high = F.greatest(low, F.col("band") - reach), F.least(high, F.col("band") + reach)
    up, down = placed.withColumn("to", high).filter("to > band"), placed.withColumn("to", low).filter("to < band")
    told = up.select(*by, F.explode(F.sequence(F.col("band") + 1, F.col("to"))).alias("band"), "col", F.col("hi").alias("row"))
    told = told.unionByName(down.select(*by, F.explode(F.sequence(F.col("to"), F.col("band") - 1)).alias("band"), "col", F.col("lo").alias("row")))
    return own.select(*by, "band", "col", "row").unionByName(told)


def distance_transform(targets: DataFrame, sources: DataFrame, by: list[str], row_m: float, col_m: float, limit: float | None = None, rows: int = BAND, columns: int = STRIP) -> DataFrame:
    """``targets`` (by, row, col and others) with ``d2``, the squared distance to the nearest of ``sources`` (by, row, col).

    Rows and columns are whole numbers from 0, ``row_m`` and ``col_m`` the pixels' height and width; with
    whole sizes ``d2`` is exact. Targets without a source have none, nor have those without one within
    ``limit``. Rasters may have gaps. A target that is a source has 0; repeated targets are kept. Bands
    of ``rows`` rows and strips of ``columns`` columns at least are what tasks take.
    """
    ends = sources.select("row", "col").unionByName(targets.select("row", "col")).agg(F.max("row"), F.max("col")).first()
    if ends[0] is None:
        return targets.withColumn("d2", F.lit(None).cast("double"))
    width = ends[1] + 1
    own = targets.columns
    left, done, height, events, keys = targets, [], None, None, [*by, "band", "strip"]
    halo = columns if limit is None else int(np.ceil(limit / col_m))
    while True:
        halo = min(halo, width)
        strip = max(columns, halo)
        if height != (height := max(1, min(rows, rows * 3 * columns // (strip + 2 * halo)))):
            if events is not None:
                discard(events)
            reach = None if limit is None else int(limit / row_m) // height + 1
            events = materialise(_events(sources, by, height, ends[0] // height, reach), "column-sources")
        first = F.greatest(F.floor((F.col("col") - halo) / strip), F.lit(0))
        around = events.withColumn("strip", F.explode(F.sequence(first, F.floor((F.col("col") + halo) / strip))))
        asked = left.withColumns({"band": F.floor(F.col("row") / height), "strip": F.floor(F.col("col") / strip)})
        if done:
            # Most strips are done; only sources around the others are looked at.
            around = around.join(asked.select(*keys).distinct(), keys, "left_semi")
        schema = StructType([*left.schema.fields, StructField("d2", DoubleType())])
        found = materialise(asked.groupBy(*keys).cogroup(around.groupBy(*keys)).applyInArrow(_strip(left.columns, halo, row_m, col_m), schema), "distances")
        whole = halo >= width or limit is not None
        sure = F.lit(True) if whole else F.coalesce(F.col("d2") <= (halo * col_m) ** 2, F.lit(False))
        near = F.col("d2") if limit is None else F.when(F.col("d2") <= limit * limit, F.col("d2"))
        done.append(found.filter(sure).select(*own, near.alias("d2")))
        if whole:
            break
        left = found.filter(~sure).drop("d2")
        if left.isEmpty():
            break
        halo *= 4
    discard(events)
    return reduce(DataFrame.unionByName, done)


def _strip(columns: list[str], halo: int, row_m: float, col_m: float):
    def measure(targets: pa.Table, events: pa.Table) -> pa.Table:
        d2 = np.full(len(targets), np.inf)
        if len(events) and len(targets):
            # Only the rows and columns that targets lie in, and the halo around, are looked at.
            row, col = targets["row"].to_numpy(), targets["col"].to_numpy()
            first_row, first_col = int(row.min()), int(col.min()) - halo
            n_rows, n_cols = int(row.max()) - first_row + 1, int(col.max()) + halo - first_col + 1
            source_row, source_col = events["row"].to_numpy(), events["col"].to_numpy() - first_col
            inside = (source_col >= 0) & (source_col < n_cols)
            height = _vertical(first_row, n_rows, n_cols, source_row[inside], source_col[inside], row_m)
            row, col, step = row - first_row, col - first_col, max(1, CELLS // n_cols)
            for lo in range(0, n_rows, step):
                mine = (row >= lo) & (row < lo + step)
                if mine.any():
                    d2[mine] = lower_envelope(height[lo : lo + step], col_m)[row[mine] - lo, col[mine]]
        return targets.select(columns).append_column("d2", pa.array(np.where(np.isinf(d2), 0.0, d2), pa.float64(), mask=np.isinf(d2)))

    return measure


# ---- closest pairs -------------------------------------------------------------------------------


def _gap(a: str, b: str, axis: str) -> tuple[Column, Column]:
    """The least and the greatest distance of two intervals."""
    lo_a, hi_a, lo_b, hi_b = (F.col(f"{t}{side}{axis}") for t in (a, b) for side in ("lo", "hi"))
    return F.greatest(lo_a - hi_b, lo_b - hi_a, F.lit(0)), F.greatest(hi_b - lo_a, hi_a - lo_b)


def closest_pairs(members: DataFrame, points: DataFrame, by: list[str], pairs: DataFrame, per_tile: int = 8) -> DataFrame:
    """(by, a, b, d2): the least squared distance between points of kinds a and b, for each pair of kinds.

    ``points`` (grp, x_m, y_m: whole numbers) belong to groups, ``members`` (by, kind, grp) say of what kind a
    group is in each case of ``by``, so that cases touch boxes of groups and never all points. ``pairs`` (a, b)
    lists few pairs of kinds. A pair without points on a side is absent.
    """
    ends = points.agg(F.count("*"), F.min("x_m"), F.max("x_m"), F.min("y_m"), F.max("y_m")).first()
    if not ends[0]:
        return members.select(*by).limit(0).join(pairs.limit(0)).withColumn("d2", F.lit(None).cast("bigint"))
    span = max(ends[2] - ends[1], ends[4] - ends[3]) + 1
    # Tiles are four times narrower from level to level, down to some points a tile.
    levels = max(1, int(np.ceil(np.log(max(ends[0] / per_tile, 16)) / np.log(16))))
    tile = lambda c, low, level: F.floor((F.col(c) - low) * 4**level / span).cast("int")
    fine = points.withColumns({"tx": tile("x_m", ends[1], levels), "ty": tile("y_m", ends[3], levels)})
    boxes = materialise(fine.groupBy("grp", "tx", "ty").agg(F.min("x_m").alias("lox"), F.max("x_m").alias("hix"), F.min("y_m").alias("loy"), F.max("y_m").alias("hiy")), "boxes")
    widest = [f(c).alias(c) for f, c in ((F.min, "lox"), (F.max, "hix"), (F.min, "loy"), (F.max, "hiy"))]
    side = lambda df, s: df.select(*by, *[F.col(c).alias(f"{s}{c}") for c in df.columns if c not in by])
    alive = None
    for level in range(1, levels + 1):
        up = 2 * (levels - level)
        at = boxes.withColumns({"tx": F.shiftright("tx", up), "ty": F.shiftright("ty", up)}).groupBy("grp", "tx", "ty").agg(*widest)
        if alive is not None:
            # Cases meet only the tiles whose parents are open in any of them.
            ends = alive.select("atx", "aty").union(alive.select("btx", "bty")).distinct().toDF("px", "py")
            at = at.withColumns({"px": F.shiftright("tx", 2), "py": F.shiftright("ty", 2)}).join(ends, ["px", "py"], "left_semi")
        at = at.join(members, "grp").groupBy(*by, "kind", "tx", "ty").agg(*widest)
        parent = lambda s: [F.shiftright(f"{s}tx", 2).alias(f"{s}px"), F.shiftright(f"{s}ty", 2).alias(f"{s}py")]
        a, b = (side(at, s).select("*", *parent(s)) for s in ("a", "b"))
        if alive is None:
            met = a.join(F.broadcast(pairs), F.col("akind") == F.col("a")).join(b, by).filter(F.col("bkind") == F.col("b"))
        else:
            opened = alive.select(*by, "a", "b", F.col("atx").alias("apx"), F.col("aty").alias("apy"), F.col("btx").alias("bpx"), F.col("bty").alias("bpy"))
            met = opened.join(a.withColumnRenamed("akind", "a"), [*by, "a", "apx", "apy"]).join(b.withColumnRenamed("bkind", "b"), [*by, "b", "bpx", "bpy"])
        (near_x, far_x), (near_y, far_y) = _gap("a", "b", "x"), _gap("a", "b", "y")
        bounded = materialise(met.select(*by, "a", "b", "atx", "aty", "btx", "bty", (near_x * near_x + near_y * near_y).alias("least"), (far_x * far_x + far_y * far_y).alias("most")), "tile-pairs")
        best = bounded.groupBy(*by, "a", "b").agg(F.min("most").alias("bound"))
        if alive is not None:
            discard(alive)
        alive = materialise(bounded.join(best, [*by, "a", "b"]).filter("least <= bound").drop("bound"), "open-pairs")
        discard(bounded)
    ends = alive.select("atx", "aty").union(alive.select("btx", "bty")).distinct().toDF("tx", "ty")
    open_ = materialise(fine.join(ends, ["tx", "ty"], "left_semi"), "open-points")
    of = lambda s: open_.join(members, "grp").select(*by, F.col("kind").alias(s), F.col("tx").alias(f"{s}tx"), F.col("ty").alias(f"{s}ty"), F.col("x_m").alias(f"{s}x"), F.col("y_m").alias(f"{s}y"))
    used = lambda s: alive.select(*by, s, f"{s}tx", f"{s}ty").distinct()
    a, b = (materialise(of(s).join(used(s), [*by, s, f"{s}tx", f"{s}ty"], "left_semi"), "near-points") for s in ("a", "b"))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    met = alive.select(*by, "a", "b", "atx", "aty", "btx", "bty").join(a, [*by, "a", "atx", "aty"]).join(b, [*by, "b", "btx", "bty"])
    found = materialise(met.groupBy(*by, "a", "b").agg(F.min(d2).alias("d2")), "closest")
    discard(alive, boxes, open_, a, b)
    return found
