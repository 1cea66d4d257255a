"""Mixing sources to target weights (operator 9), by entropy balancing with DataFrame operations only.

Among all document rates r with 0 <= r <= ``most``, take those nearest to 1 in relative entropy under
which every source's words meet its target: r = min(most, exp(lambda_source * size / mean size)). The
dual is convex with one multiplier a source, found by Newton's method inside a bracket. Each
iteration is one aggregation over the exact histogram of (source, size), which holds all documents.
The multipliers stay in a table in the shared folder.

Rates become copies by floor(rate + v), with v = hash(document) + shift(source) modulo 1. Any shift
keeps the expected copies; of ``SHIFTS`` the one whose words come nearest to the target is used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import discard, free, read, spool

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
SHIFTS = 64
SEED = 20240817
ITERATIONS, TOLERANCE = 60, 1e-7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size, n) to (source, source_size, mean_size, target): one row a source, filled like vessels.

    Sources in order of code points, null last, have ``weights`` in turn. Together the targets come to
    ``share`` of all words; none exceeds ``most`` times its source's words. The windows run over one
    row a source, never over documents.
    """
    own = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    ranked = own.selectExpr("*", "row_number() over (order by source asc nulls last) - 1 as place").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    full = F.col("source_size") * F.lit(float(most))
    filled = ranked.withColumn("full", full).withColumn("height", F.col("full") / F.col("weight")).selectExpr(
        "*",
        f"{share!r}D * sum(source_size) over () as total",
        "coalesce(sum(full) over (order by height, place rows between unbounded preceding and 1 preceding), 0D) as below",
        "sum(weight) over (order by height desc, place desc) as weight_above",
    )
    level = filled.withColumn("level", (F.col("total") - F.col("below")) / F.col("weight_above")).selectExpr("*", "max(case when level <= height then level end) over () as water")
    return level.select("source", "source_size", (F.col("source_size") / F.greatest("docs", F.lit(1))).alias("mean_size"), F.least("full", F.coalesce(F.col("water") * F.col("weight"), F.col("full"))).alias("target"))


def rate(size: Column, multiplier: Column, mean: Column, most: float) -> Column:
    """min(most, exp(multiplier * size / mean)), never overflowing; a null multiplier stands for plus infinity."""
    x = F.least(multiplier * size / F.greatest(mean, F.lit(1e-9)), F.lit(math.log(most)))
    return F.when(multiplier.isNull(), F.lit(float(most))).otherwise(F.exp(x))


def balance(sizes: DataFrame, goal: DataFrame, most: float = MOST) -> DataFrame:
    """Newton's iterations on the dual: ``goal`` with a multiplier a source (null: every rate is ``most``)."""
    pinned = (F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12))) & (F.col("source_size") > 0)
    state = spool(goal.select("*", F.when(pinned, F.lit(None)).otherwise(F.lit(0.0)).cast("double").alias("lam"), F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"), F.lit(math.inf).alias("miss")), "multipliers")
    for _ in range(ITERATIONS):
        open_ = state.filter(F.col("lam").isNotNull())
        cells = sizes.alias("c").join(open_.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select(F.col("s.source").alias("source"), (F.col("c.n") * F.col("c.size")).cast("double").alias("words"), (F.col("c.size") / F.greatest("s.mean_size", F.lit(1e-9))).alias("x"), "s.lam")
        rated = cells.withColumn("r", F.exp(F.least(F.col("lam") * F.col("x"), F.lit(math.log(most)))))
        sums = rated.groupBy("source").agg(F.sum(F.col("words") * F.col("r")).alias("got"), F.sum(F.when(F.col("lam") * F.col("x") < math.log(most), F.col("words") * F.col("x") * F.col("r")).otherwise(0.0)).alias("slope"))
        joined = state.alias("s").join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left").select("s.*", "g.got", "g.slope")
        excess = F.col("got") - F.col("target")
        lo = F.when(excess < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(excess >= 0, F.col("lam")).otherwise(F.col("hi"))
        bounded = joined.withColumns({"excess": excess, "lo": F.coalesce(lo, F.col("lo")), "hi": F.coalesce(hi, F.col("hi"))})
        step = F.col("lam") - F.col("excess") / F.when(F.col("slope") > 0, F.col("slope"))
        middle = F.when(F.col("lo") == -math.inf, F.col("hi") * 2 - 1).when(F.col("hi") == math.inf, F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        miss = F.coalesce(F.abs("excess") / F.greatest("target", F.lit(1.0)), F.lit(0.0))
        moved = F.when(miss <= TOLERANCE, F.col("lam")).when(inside, step).otherwise(middle)
        last, state = state, spool(bounded.withColumns({"miss": miss, "lam": moved}).drop("excess", "got", "slope"), "multipliers")
        discard(last)
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select("source", "source_size", "mean_size", "target", "lam")


def _copies(size: Column, mark: Column, shift: Column, most: float) -> Column:
    v = F.pmod(mark + shift, F.lit(1.0))
    return F.least(F.floor(rate(size, F.col("lam"), F.col("mean_size"), most) + v), F.lit(int(most))).cast("bigint")


def document_mark(key: Column, text: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 that the document's key and text decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, text), 11).cast("double") / F.lit(float(1 << 53))


def plan(docs: DataFrame, key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(documents' key, source, size and mark; sources with target, multiplier and shift), both spooled."""
    sized = spool(docs.select(F.col(key).alias("key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), document_mark(F.col(key), F.col("text")).alias("mark")), "sizes")
    cells = spool(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "size-histogram")
    solved = balance(cells, targets(cells, weights, share, most), most)
    rows = sized.alias("d").join(solved.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.size", "d.mark", "s.*")
    sums = rows.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(_copies(F.col("size"), F.col("mark"), F.lit(j / SHIFTS), most) * F.col("size")).alias(f"t{j}") for j in range(SHIFTS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("off"), F.lit(j / SHIFTS).alias("shift")) for j in range(SHIFTS)]))
    shifts = sums.select("source", best["shift"].alias("shift"))
    return sized, spool(solved.alias("s").join(shifts.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source"))).select("s.*", "b.shift"), "mix")


def mix(docs: DataFrame, key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The documents of the mix, each as often as it is taken (0 to ``most`` times), with their columns.

    A null source is a source of its own. Null and empty texts have no words: their rate is 1 or
    ``most`` and they add nothing to any target. Equal rows share a mark, and so their number of
    copies; long texts are counted whole. All columns of ``docs`` are kept, whatever their names. An
    empty table gives an empty one.
    """
    _, sources = plan(docs, key, weights, share, most)
    named = {c: free(f"mix_{c}", docs) for c in ("source", "mean_size", "lam", "shift", "copies", "copy")}
    few = sources.select(*[F.col(c).alias(named[c]) for c in ("source", "mean_size", "lam", "shift")])
    marked = docs.join(few, F.col("source").cast("string").eqNullSafe(F.col(named["source"])))
    v = F.pmod(document_mark(F.col(key), F.col("text")) + F.col(named["shift"]), F.lit(1.0))
    r = rate(word_count(F.col("text")), F.col(named["lam"]), F.col(named["mean_size"]), most)
    taken = F.least(F.floor(r + v), F.lit(int(most))).cast("int")
    repeated = marked.withColumn(named["copies"], taken).filter(F.col(named["copies"]) > 0).withColumn(named["copy"], F.explode(F.sequence(F.lit(1), F.col(named["copies"]))))
    return repeated.select(*docs.columns)


def op9_mix(spark, sf_dir: str) -> DataFrame:
    sized, sources = plan(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.key", "d.size", "d.mark", "s.*")
    return rows.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (_copies(F.col("size"), F.col("mark"), F.col("shift"), MOST) * F.col("size")).alias("taken"))
