"""Blocks and their roles: seeded draws, shares, folds, strata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions.stats import half_even_share


def shuffled_draws(spark: SparkSession, blocks: list[int], seeds: list[int]) -> DataFrame:
    """(seed, block_id, pos) by NumPy's legacy generator: a permutation of the sorted blocks a seed.

    The generator isn't a SQL function, and blocks are few; the table is made on the driver.
    """
    unique = np.unique(np.asarray(blocks, np.int64))
    rows = []
    for seed in seeds:
        order = unique.copy()
        np.random.RandomState(seed).shuffle(order)
        rows += [(int(seed), int(b), i + 1) for i, b in enumerate(order)]
    return spark.createDataFrame(rows, "seed bigint, block_id bigint, pos int")


def seed_list(text: str, default: list[int]) -> list[int]:
    """'' for the default, 'random:N:seed' for N drawn seeds, or numbers between commas."""
    if not text:
        return list(default)
    if text.startswith("random:"):
        _, n, seed = text.split(":")
        return np.random.RandomState(int(seed)).randint(10**6, size=int(n)).tolist()
    return [int(x) for x in text.split(",")]


def role_counts(n: Column, train: float = 0.70, val: float = 0.15) -> tuple[Column, Column]:
    """Blocks for training and validation: shares rounded half to even, at least one left for testing."""
    a, b = half_even_share(n, train), half_even_share(n, val)
    return F.when(a + b >= n, n - 2).otherwise(a), F.when(a + b >= n, 1).otherwise(b)


def roles(draws: DataFrame) -> DataFrame:
    """(seed, block_id, role) from positions; the number of blocks is counted a seed."""
    n = F.count("*").over(Window.partitionBy("seed"))
    a, b = role_counts(F.col("n"))
    return draws.withColumn("n", n).select("seed", "block_id", F.when(F.col("pos") <= a, "train").when(F.col("pos") <= a + b, "val").otherwise("test").alias("role"))


def folds(draws: DataFrame, k: int, exact: bool = False) -> DataFrame:
    """(seed, block_id, fold): k runs of positions; the last takes what division leaves, unless ``exact``."""
    size = F.floor(F.count("*").over(Window.partitionBy("seed")) / k)
    at = F.floor((F.col("pos") - 1) / F.greatest(size, F.lit(1)))
    return draws.select("seed", "block_id", (at if exact else F.least(at, F.lit(k - 1))).cast("int").alias("fold"))


def strata(blocks: DataFrame, share: str, size: int, count: int) -> DataFrame:
    """(…, stratum): blocks in order of ``share``, ``size`` a stratum, the last of ``count`` takes the rest."""
    order = F.row_number().over(Window.orderBy(share, "block_id"))  # one row a block
    return blocks.withColumn("stratum", F.least(F.floor((order - 1) / size), F.lit(count - 1)).cast("int"))


def stratified_roles(draws: DataFrame, strata: DataFrame, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """(seed, block_id, stratum, role): the shares are cut within each stratum (block_id, stratum) of each draw.

    Strata of three blocks or more have at least one for training and one for validation; of two blocks, one is for
    validation and one for testing, a single one is for testing.
    """
    own = Window.partitionBy("seed", "stratum")
    placed = draws.join(F.broadcast(strata.select("block_id", "stratum")), "block_id").withColumns({"k": F.row_number().over(own.orderBy("pos")), "m": F.count("*").over(own)})
    m, a0, b0 = F.col("m"), F.col("a0"), F.col("b0")
    first = placed.withColumns({"a0": F.when(m >= 3, half_even_share(m, train)).otherwise(F.greatest(m - 2, F.lit(0))), "b0": F.when(m >= 3, half_even_share(m, val)).when(m >= 2, 1).otherwise(0)})
    cut = first.withColumn("a", F.when(a0 + b0 >= m, F.greatest(m - 2, F.lit(0))).otherwise(a0)).withColumn("b", F.when(a0 + b0 >= m, F.least(F.lit(1), m - F.col("a"))).otherwise(b0))
    return cut.select("seed", "block_id", "stratum", F.when(F.col("k") <= F.col("a"), "train").when(F.col("k") <= F.col("a") + F.col("b"), "val").otherwise("test").alias("role"))


def simple_random_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: the least by a seeded hash. A reported sample, not a shortcut."""
    return rows.withColumn("__draw", F.xxhash64(F.lit(seed), F.col(key))).orderBy("__draw", key).limit(n).drop("__draw")
