"""From raw documents to shuffled shards: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontaminate, jaccard, language_id, mixing, sharding
from quadrille.llm.common import read, spool

SHARDS = 40
#: Rows of the Arrow batches of texts that Python steps get.
TEXT_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """A session's setting, as a stage's result is computed by whoever writes it. It changes memory, not rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, null and empty texts among them; each row is judged for itself."""
    _small_batches(spark)
    return language_id.keep_identified(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document of least doc_id stays; of equal rows one, of texts without words all."""
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go; null and empty texts stay."""
    _small_batches(spark)
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source, equal rows have equal copies."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard, bucket and slot, in shuffled order; repeated rows and null texts are rows like others."""
    return sharding.shuffle(docs, SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", join_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("source_mix", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the model, the mix or the shuffle; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
