"""Scans of antenna, LiDAR and node tables, and sinks for published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The header names of antenna files, in the order of the columns they become.
ANTENNA_HEADER = {
    "Municipio.NomeMunicipio": "city",
    "Latitude": "lat",
    "Longitude": "lon",
    "AlturaAntena": "height_m",
    "FreqTxMHz": "freq_mhz",
    "PotenciaTransmissorWatts": "watts",
    "GanhoAntena": "gain_dbi",
}
NUMBERS = ("lat", "lon", "height_m", "freq_mhz", "watts", "gain_dbi")
#: What stands for a height or power that isn't positive, and the gain of the prototype.
DEFAULT_HEIGHT_M, DEFAULT_DBM, PROTOTYPE_GAIN_DBI = 30.0, 30.0, 12.0
#: Degrees around the terrain, MHz around a band, and the fewest antennas that make a band.
AROUND_DEGREES, AROUND_MHZ, LEAST_OF_BAND = 0.2, 200.0, 5


def read_csv(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """A CSV file with a header as text columns, only those of ``names``, renamed; columns may stand in any order."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def number(text: Column, otherwise: float | None = 0.0) -> Column:
    """The number in a text; what isn't one, or is missing, becomes ``otherwise``."""
    found = F.trim(text).try_cast("double")
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def environment(freq_mhz: Column) -> Column:
    return F.when(freq_mhz > 1800, "urban").when(freq_mhz > 800, "suburban").otherwise("rural")


def antennas(spark: SparkSession, path: str, city: str, default_gain: float | None = None) -> DataFrame:
    """Antennas of a city with power in dBm and environment; those without frequency or power are left out.

    The city's name is compared in upper case. ``default_gain`` replaces gains that aren't positive.
    """
    rows = read_csv(spark, path, ANTENNA_HEADER).filter(F.upper("city") == city.upper())
    rows = rows.select("city", *[number(F.col(c)).alias(c) for c in NUMBERS]).filter("freq_mhz > 0 and watts > 0")
    dbm = 10 * F.log10(F.col("watts") * 1000)
    gain = F.col("gain_dbi") if default_gain is None else F.when(F.col("gain_dbi") <= 0, default_gain).otherwise(F.col("gain_dbi"))
    return rows.select(
        "city", "lat", "lon", F.when(F.col("height_m") <= 0, DEFAULT_HEIGHT_M).otherwise(F.col("height_m")).alias("height_m"), "freq_mhz", "watts",
        gain.alias("gain_dbi"), F.when(dbm < 0, DEFAULT_DBM).otherwise(dbm).alias("dbm"), environment(F.col("freq_mhz")).alias("environment"),
    )


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float], around: float = 0.0) -> Column:
    """Whether a position is within (lat from, lat to, lon from, lon to), bounds included."""
    return lat.between(box[0] - around, box[1] + around) & lon.between(box[2] - around, box[3] + around)


def antenna_positions(spark: SparkSession, path: str, box: tuple[float, float, float, float], band_mhz: float | None = None) -> DataFrame:
    """(lat, lon) of the antennas in and around a box, once each.

    With ``band_mhz`` only those near that frequency, if they are LEAST_OF_BAND or more; else all. The
    count is one row, joined to the rows it decides on.
    """
    names = {k: v for k, v in ANTENNA_HEADER.items() if v in ("lat", "lon", "freq_mhz")}
    rows = read_csv(spark, path, names).select(*[number(F.col(c), None).alias(c) for c in names.values()])
    rows = rows.filter(in_box(F.col("lat"), F.col("lon"), box, AROUND_DEGREES))
    if band_mhz is not None:
        near = F.coalesce(F.abs(F.col("freq_mhz") - band_mhz) <= AROUND_MHZ, F.lit(False))
        enough = rows.agg((F.count_if(near) >= LEAST_OF_BAND).alias("enough"))
        rows = rows.join(F.broadcast(enough)).filter(near | ~F.col("enough"))
    return rows.select("lat", "lon").distinct()


def lidar(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """LiDAR points in a box; the schema is given, so the file is read once and filtered in the scan."""
    rows = spark.read.schema("lat double, lon double, elevation float").option("header", "true").csv(path)
    return rows.filter(in_box(F.col("lat"), F.col("lon"), box))


def tensor(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Named columns of a node table; the scan reads no others."""
    return spark.read.parquet(path).select(*columns)


def newest_predictions(predictions: DataFrame, run: str, version: str) -> DataFrame:
    """The rows of each run's newest version. Versions a run are few, so the newest are found by an aggregation."""
    newest = predictions.groupBy(run).agg(F.max(version).alias(version))
    return predictions.join(newest, [run, version], "left_semi")


def write_csv(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table as CSV with a header; ``append`` adds to a log."""
    table.write.mode(mode).option("header", "true").csv(path)


def tex_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a table as lines of a tabular: cells between ampersands, percent signs and underscores escaped."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([%_&#])", r"\\$1")
    return table.select(F.concat(F.array_join(F.array(*[cell(c) for c in columns]), " & "), F.lit(r" \\")).alias("line"))


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: keys without an output of status ok. Failed ones are tried again."""
    return wanted.join(done.filter("status = 'ok'").select(key).distinct(), key, "left_anti")
