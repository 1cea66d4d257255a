"""Rasters as pixel tables (row, col, v): windows, gaps, mosaics and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what marks a pixel without data.
NODATA = -9999


def window(pixels: DataFrame, row_from: int, row_to: int, col_from: int, col_to: int) -> DataFrame:
    """The pixels of rows and columns from (included) to (excluded), renumbered from 0; bounds below 0 are 0."""
    r, c = max(0, row_from), max(0, col_from)
    inside = (F.col("row") >= r) & (F.col("row") < row_to) & (F.col("col") >= c) & (F.col("col") < col_to)
    return pixels.filter(inside).select((F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), "v")


def fill_gaps(pixels: DataFrame, nodata: int = NODATA) -> DataFrame:
    """Pixels without data take the mean of those with; the mean is one row. Without any, they stay null."""
    valid = F.when(F.col("v") != nodata, F.col("v"))
    mean = pixels.agg(F.avg(valid).alias("mean"))
    return pixels.join(F.broadcast(mean)).select("row", "col", F.coalesce(valid.cast("double"), "mean").alias("v"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """(tile, row0, col0, row, col, v) to (row, col, v): tiles pasted at their offsets, the last one wins."""
    placed = tiles.select("tile", (F.col("row0") + F.col("row")).alias("row"), (F.col("col0") + F.col("col")).alias("col"), "v")
    return placed.groupBy("row", "col").agg(F.max_by("v", "tile").alias("v"))


def accumulate(pixels: DataFrame, rows: int, cols: int, from_rows: int, from_cols: int, scale: float = 10_000.0) -> DataFrame:
    """Pixels of a finer raster averaged into ``rows`` x ``cols`` cells, scaled and cut to 0..1."""
    at = pixels.select(F.floor(F.col("row") * rows / from_rows).alias("row"), F.floor(F.col("col") * cols / from_cols).alias("col"), "v")
    mean = F.sum("v") / F.greatest(F.count("v"), F.lit(1)) / scale
    return at.groupBy("row", "col").agg(F.greatest(F.least(mean, F.lit(1.0)), F.lit(0.0)).alias("v"))
