"""Sharding (operator 6): a two-pass external shuffle.

Pass one counts rows and bytes a shard and scatters every record by seeded hashes into buckets sized
for memory; pass two shuffles each bucket by Fisher-Yates and writes it. A record's shard follows
from its key and the number of shards alone (highest random weight), so that one more shard takes
rows only into itself. Within a shard, buckets follow each other; ``slot`` counts through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import free, new_path, read, spool

#: Bytes a bucket holds in the mean.
BUCKET_BYTES = 16 << 20
#: Added to a text's bytes for its other fields.
ROW_BYTES = 16
SEED = 20240611


def weight(key: Column, shard: Column | int, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key, F.lit(shard) if isinstance(shard, int) else shard)


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard of highest weight; a null key is a key like any other."""
    ranked = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(weight(key, s, seed).alias("w"), s.alias("s"))))
    return ranked["s"]


def shuffle(docs: DataFrame, shards: int, key: str = "doc_id", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every record with shard, bucket and slot, in the order in which it's to be written.

    Null keys share a shard, and null texts are empty; repeated rows are all kept. Buckets are drawn
    from key and text, so rows with the same key and text, and only these, are bound to meet in one: a
    table must not repeat one row more often than a bucket may hold. A long text is a record like any
    other. Columns of ``docs`` named shard, bucket, slot or size are replaced, all others kept. An empty
    table gives an empty one.
    """
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint") + F.lit(ROW_BYTES)
    kept = [c for c in docs.columns if c not in ("shard", "bucket", "slot", "size")]
    mark = F.xxhash64(F.lit(seed + 1), F.col(key), F.col("text"))
    mark_, position = free("mark", docs), free("position", docs)
    sized = docs.select(*kept, size.alias("size"), shard_of(F.col(key), shards, seed).alias("shard"), mark.alias(mark_))
    largest = sized.groupBy("shard").agg(F.sum("size").alias("b")).agg(F.max("b")).first()[0] or 0
    buckets = max(1, -(-int(largest) // bucket_bytes))
    scattered = sized.withColumn("bucket", F.pmod(mark_, F.lit(buckets)).cast("int"))
    counts = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before_ = free("before", docs)
    before = spool(counts.selectExpr("shard", "bucket", f"sum(n) over (partition by shard order by bucket) - n as {before_}"), "bucket-starts")
    fields = docs.select(*kept).schema.simpleString()[7:-1]
    out = f"{fields},size:bigint,shard:int,bucket:int,{position}:bigint"

    def fisher_yates(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows[mark_]))
        draw = np.random.default_rng([seed, group[0].as_py(), group[1].as_py()])
        order = np.arange(len(rows))
        for i, j in zip(range(len(rows) - 1, 0, -1), draw.integers(0, np.arange(len(rows), 1, -1), dtype=np.int64).tolist(), strict=True):
            order[i], order[j] = order[j], order[i]
        return rows.drop_columns(mark_).take(pa.array(order)).append_column(position, pa.array(np.arange(len(rows))))

    mixed = scattered.select(*kept, "size", "shard", "bucket", mark_).groupBy("shard", "bucket").applyInArrow(fisher_yates, out)
    return mixed.join(F.broadcast(before) if shards * buckets <= 100_000 else before, ["shard", "bucket"]).withColumn("slot", F.col(before_) + F.col(position)).select(*kept, "size", "shard", "bucket", "slot")


def write(docs: DataFrame, path: str, shards: int, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Write the shuffled records as Parquet, a folder for each shard, and read them back."""
    shuffle(docs, shards, key, seed).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op6_shard(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = write(docs, new_path(spark, "shards"), 40)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    own, new = weight(F.col("doc_id"), F.col("shard"), SEED), weight(F.col("doc_id"), 40, SEED)
    return rows.select("doc_id", "size", F.crc32(text).cast("bigint").alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.when((new > own) | ((new == own) & (F.lit(40) > F.col("shard"))), 40).otherwise(F.col("shard")).cast("int").alias("grown_shard"))
