"""Neighbourhoods on a grid of cells: each cell is sent to the nine around it and met there in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def around(cells: DataFrame) -> DataFrame:
    """(row, col, v) cells to (row, col, dr, dc, v): what each cell sees at each offset that holds a cell."""
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("o")
    return cells.select("row", "col", "v", offsets).select((F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"), "v")


def at(dr: int, dc: int) -> Column:
    """The value at an offset, null where there is no cell; an aggregate over ``around``."""
    return F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("v")))


def slope(before: Column, here: Column, after: Column) -> Column:
    """Central difference; one-sided where a neighbour is missing, 0 where both are."""
    return F.coalesce((after - before) / 2, after - here, here - before, F.lit(0.0))
