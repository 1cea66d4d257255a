"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import discard, in_tasks_of, spool

#: Links of a task.
TASK_LINKS = 100_000


def _star(links: DataFrame, large: bool, n: int) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour."""
    few = lambda df: in_tasks_of(df, n, TASK_LINKS)
    links = few(links)
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = few(both)
    least = few(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    joined = few(both.join(least, "a"))
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return few(few(out.filter(F.col("a") != F.col("b"))).distinct())


def components(links: DataFrame) -> DataFrame:
    """(a, b) bigint pairs to (node, component): the least node reachable. Nodes without links are absent.

    Each step is a shuffle on the link table, whose size never grows; the table is written to the
    shared folder after each round. Null ends are dropped; self and repeated links do no harm.
    """
    now = spool(links.select("a", "b").filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        n, mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, mark) == before:
            break
        before = (n, mark)
        last, now = now, spool(_star(_star(now, True, n), False, n), "links")
        discard(last)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
