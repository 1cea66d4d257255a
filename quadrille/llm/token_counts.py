"""Token counts (operator 4) from an exact histogram of encoded lengths.

Documents are encoded whole and counted by length; tasks emit the counts of their batches, so a shuffle
carries a row a length and batch, never a text. Sums from each length upwards (suffix sums) then answer
every context limit: with a limit L, a document keeps min(length, L) tokens, so

    kept(L) = tokens of shorter documents + L * documents of L tokens or more.

A histogram of distinct lengths grows with the square root of its tokens at most. Its sums run in
spans of ``SPAN`` lengths, each a window of its own; one window goes over the spans' totals only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import read, spool
from quadrille.llm.token_files import encoder

#: Lengths whose sums one window runs over.
SPAN = 256
#: Rows of an Arrow batch of texts.
TEXT_ROWS = 1000


def lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length, without special tokens.

    Null and empty texts have length 0 and are counted; repeated rows count as often as they stand.
    Only ``text`` is read, so null keys and other columns make no difference. An empty table has no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(tokenizer_path)
        for batch in batches:
            found = np.array([len(ids) for ids in own.encode_all([text or "" for text in batch["text"].to_pylist()])], np.int64)
            values, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(values, pa.int64()), "docs": pa.array(n, pa.int64())})

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n_tokens bigint, docs bigint")
    return counted.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with, for each length as context limit, the sums over all documents.

    n_tokens, docs and tokens of that length; docs_at_least and tokens_at_least of that length or more;
    kept_tokens with texts cut to the limit; docs_at_most, and its share of all documents.
    """
    spanned = histogram.selectExpr("n_tokens", "docs", "n_tokens * docs as tokens", f"n_tokens div {SPAN} as span")
    spans = spanned.groupBy("span").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    above = spans.selectExpr(
        "span",
        "coalesce(sum(d) over (order by span desc rows between unbounded preceding and 1 preceding), 0) as docs_above",
        "coalesce(sum(t) over (order by span desc rows between unbounded preceding and 1 preceding), 0) as tokens_above",
        "sum(d) over () as all_docs",
        "sum(t) over () as all_tokens",
    )
    own = "over (partition by span order by n_tokens desc rows between unbounded preceding and current row)"
    summed = spanned.selectExpr("*", f"sum(docs) {own} as own_docs", f"sum(tokens) {own} as own_tokens")
    return (
        summed.join(above, "span")
        .selectExpr("n_tokens", "docs", "tokens", "own_docs + docs_above as docs_at_least", "own_tokens + tokens_above as tokens_at_least", "all_docs", "all_tokens")
        .selectExpr(
            "n_tokens",
            "docs",
            "tokens",
            "docs_at_least",
            "tokens_at_least",
            "all_tokens - tokens_at_least + n_tokens * docs_at_least as kept_tokens",
            "all_docs - docs_at_least + docs as docs_at_most",
            "(all_docs - docs_at_least + docs) / all_docs as share_at_most",
        )
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, cut_docs, cut_tokens, kept_tokens) for any limits, also between or above the lengths.

    Limits are a short list; each asks for the least length above it, of all the sums.
    """
    asked = sorted({int(x) for x in limits})
    picks = [F.min(F.when(F.col("n_tokens") > x, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias(f"at_{x}") for x in asked]
    found = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"), *picks)
    rows = F.array(*[F.struct(F.lit(x).cast("bigint").alias("context_limit"), F.col(f"at_{x}").alias("over")) for x in asked])
    return found.select("all_tokens", F.explode(rows).alias("r")).selectExpr(
        "r.context_limit",
        "coalesce(r.over.docs_at_least, 0) as cut_docs",
        "coalesce(r.over.tokens_at_least - r.context_limit * r.over.docs_at_least, 0) as cut_tokens",
        "all_tokens - coalesce(r.over.tokens_at_least - r.context_limit * r.over.docs_at_least, 0) as kept_tokens",
    )


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the least length that this share of documents doesn't exceed; null without documents."""
    picks = [F.min(F.when(F.col("share_at_most") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    found = sums.agg(*picks)
    return found.select(F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])).alias("r")).select("r.*")


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The histogram of encoded lengths with its suffix sums; texts are encoded once."""
    return suffix_sums(spool(lengths(docs, tokenizer_path), "lengths", TEXT_ROWS))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
