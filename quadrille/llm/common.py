"""Shared folders, spooled tables and the few helpers all operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may lack it (tests); such a session gets a folder of its own once.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quadrille-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffles behind the write are dropped once it is done, as nothing reads them again.
    ``batch_rows`` bounds the rows of the Arrow batches that its Python steps get, for wide rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    wanted = {_CLEAN: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = spark.read.schema(df.schema).parquet(path)
    found._spooled = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete spooled tables that nothing reads any more; others are left alone."""
    for table in tables:
        path = getattr(table, "_spooled", None)
        if path:
            fs, local = filesystem(path)
            fs.delete_dir(local)


def free(name: str, *tables: DataFrame) -> str:
    """``name``, lengthened until no column of ``tables`` has it."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_tasks_of(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``df`` in as many tasks as ``rows``, a bound of its rows that was counted, ask for, and no more than it has.

    A table of few rows would else take a task for each shuffle partition in every step.
    """
    return df.coalesce(1 + rows // per_task)


#: Rows of a small table that may be broadcast, counted before it is; beyond, the join is salted.
BROADCAST_ROWS = 500_000
SALTS = 16


def join_few(rows: DataFrame, few: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join of ``few`` (one row a key, as ``key`` in both) whatever share of ``rows`` one key holds.

    A counted small table is broadcast, so that ``rows`` stay where they are. A larger one is repeated
    ``SALTS`` times and met by the rows' salts, which ``spread`` (a column of ``rows``) decides.
    """
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), key, "left")
    salt = free("salt", rows, few)
    salted = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [key, salt], "left").drop(salt)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def filesystem(uri: str):
    """A pyarrow file system and the path in it; works for local folders and object stores alike."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)
