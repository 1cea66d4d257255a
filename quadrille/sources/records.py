"""JSON records, JSON lines, and discovery of files by glob and pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dotted(record: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null if any step is missing. Keys that hold dots can't be asked for so."""
    return F.get_json_object(record, "$" + "".join(f"['{step}']" for step in path.split(".")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; blank lines and lines that don't parse are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def found_files(spark: SparkSession, glob: str, label: str) -> DataFrame:
    """(path, label, text) of the files that ``glob`` finds, with the first group of the pattern ``label`` in the path."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(glob)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract(F.col("_metadata.file_path"), label, 1).alias("label"), F.col("value").alias("text")).filter("label <> ''")
