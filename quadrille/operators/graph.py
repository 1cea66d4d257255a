"""Edges as tables: lattices, induced subgraphs, checks, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Eight neighbours and the node itself.
OFFSETS = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]


def lattice_edges(pixels: DataFrame, rows: int | None, cols: int, step_m: float) -> DataFrame:
    """(src, dst, dist) to the eight neighbours and oneself, of (row, col) pixels numbered row by row; ``rows`` None for no last one."""
    moves = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in OFFSETS])
    moved = pixels.withColumn("m", F.explode(moves)).withColumns({"r2": F.col("row") + F.col("m.dr"), "c2": F.col("col") + F.col("m.dc")})
    inside = moved.filter((F.col("r2") >= 0) & (F.lit(rows is None) | (F.col("r2") < (rows or 0))) & (F.col("c2") >= 0) & (F.col("c2") < cols))
    dist = F.sqrt((F.abs("m.dr") + F.abs("m.dc")).cast("double")) * step_m
    return inside.select((F.col("row") * cols + F.col("col")).alias("src"), (F.col("r2") * cols + F.col("c2")).alias("dst"), dist.alias("dist"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among ``members`` (node_id); two semi-joins."""
    m = members.select("node_id")
    return edges.join(m.withColumnRenamed("node_id", "src"), "src", "left_semi").join(m.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def numbered(members: DataFrame) -> DataFrame:
    """(node_id, local): members in order, from 0. Ranks within ranges, then the ranges' starts."""
    parts = members.select("node_id").distinct().repartitionByRange("node_id").withColumn("part", F.spark_partition_id())
    sized = parts.groupBy("part").count().selectExpr("part", "sum(count) over (order by part) - count as before")
    return parts.selectExpr("node_id", "part", "row_number() over (partition by part order by node_id) - 1 as at").join(sized, "part").select("node_id", (F.col("at") + F.col("before")).alias("local"))


def asymmetric(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is missing."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_anti")


def repeated(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").count().filter("count > 1")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))


def mean_of_neighbours(edges: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """One step of mean aggregation along edges: (node_id, mean)."""
    return edges.join(values.select(F.col("node_id").alias("src"), value), "src").groupBy(F.col("dst").alias("node_id")).agg(F.avg(value).alias("mean"))


def pixel_grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).selectExpr("id", f"id div {cols} as row", f"id % {cols} as col")
