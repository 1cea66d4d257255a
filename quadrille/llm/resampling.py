"""Target-distribution importance resampling (operator 11): scored by array, ranked by a distributed LSD radix sort.

Runs of words are hashed into buckets. What a bucket gains, by how often target and corpus fill it, is
an array that every task holds; a document's weight is the mean over its runs' buckets, and a
Gumbel draw from its key is added, so that the highest scores are a draw without replacement.

The sort goes over the digits of a composite key, least significant first: descending score, then key.
Each pass is a stable counting sort. Rows lie in parts of their present order; digits are counted by
part, prefix sums over digits and parts give where each (digit, part) begins, and a part's task adds
each row's place among its equals. That sum is the row's place in the next order, which is cut into
equal parts again, so that no key, however frequent, fills a task. Every pass is a written table.

CRC-32 is computed byte by byte over arrays of all words at once, going on from a word into its run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import textkit
from quadrille.llm.common import discard, free, read, spool

#: Rows of an Arrow batch of texts.
TEXT_ROWS = 1000
#: Bytes of a long text that are hashed at a time, or more for a longer word.
PIECE_BYTES = 1 << 20
#: Rows of a part of the order, at most; there are no fewer parts than shuffle partitions.
PART_ROWS = 1 << 20
DIGIT_BITS = 8
#: Words from this length on are hashed one by one.
LONG_WORD = 128

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1).astype(np.uint32)
_START = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    """``share`` is in per cent of the documents with at least ``min_words`` words."""

    runs: int = 2
    buckets: int = 10_000
    share: int = 25
    min_words: int = 20
    seed: int = 7


def _fed(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of each word, all words at once, a byte at a time."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    now, at, size = state[order], start[order], size[order]
    long = int(np.searchsorted(-size, -LONG_WORD, "right"))
    for i in range(long):
        now[i] = zlib.crc32(data[at[i] : at[i] + size[i]], int(now[i] ^ _START)) ^ int(_START)
    now, at, size, every = now[long:], at[long:], size[long:], now
    if len(size):
        for j, n in enumerate(np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right").tolist()):
            now[:n] = _TABLE[(now[:n] ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (now[:n] >> np.uint32(8))
    out = np.empty_like(every)
    out[order] = every
    return out


def _pieces(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of a text of about ``most`` bytes, which end behind a separator."""
    at = 0
    while at < len(data):
        stop = min(at + most, len(data))
        gaps = np.flatnonzero(textkit.NON_ALNUM[data[at:stop]]) if stop < len(data) else []
        if len(gaps):
            stop = at + int(gaps[-1]) + 1
        else:
            while stop < len(data):
                ahead = np.flatnonzero(textkit.NON_ALNUM[data[stop : stop + most]])
                if len(ahead):
                    stop += int(ahead[0]) + 1
                    break
                stop = min(stop + most, len(data))
        yield at, stop
        at = stop


def run_buckets(data: np.ndarray, bounds: np.ndarray, own: Settings, most: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words by text, text of each run, bucket of each run) of a run of texts; one long text comes in pieces.

    A piece begins with the last words of the one before, so that no run of words is lost; runs that
    end within these words have been given already.
    """
    if len(bounds) > 2 or len(data) <= most:
        yield _buckets(data, bounds, own, 0)
        return
    carried, n_carried = data[:0], 0
    for a, b in _pieces(data, most):
        piece = np.concatenate([carried, data[a:b]])
        yield _buckets(piece, np.array([0, len(piece)]), own, n_carried)
        start, _ = textkit.spans(piece, np.array([0, len(piece)]), textkit.NON_ALNUM)
        n_carried = min(own.runs - 1, len(start))
        carried = piece[start[-n_carried] :] if n_carried else data[:0]


def _buckets(data: np.ndarray, bounds: np.ndarray, own: Settings, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``known`` words, and runs that end with one of them, don't count."""
    start, end = textkit.spans(data, bounds, textkit.NON_ALNUM)
    first = np.searchsorted(start, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    words = np.diff(first) - known
    low = textkit.lower(data)
    texts, buckets = [], []
    last = np.arange(len(start))
    state = np.full(len(start), _START, np.uint32)
    for k in range(own.runs):
        if k:
            # Runs of k words grow by a space and the next word of the same text.
            goes_on = np.flatnonzero((last + 1 < len(start)) & (text[np.minimum(last + 1, len(start) - 1)] == text[last])) if len(last) else last
            last, state = last[goes_on] + 1, state[goes_on]
            state = _TABLE[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        state = _fed(state, low, start[last], end[last])
        new = last >= known
        texts.append(text[last[new]])
        buckets.append((~state[new] % np.uint32(own.buckets)).astype(np.int64))
    return words, np.concatenate(texts), np.concatenate(buckets)


def bucket_counts(docs: DataFrame, own: Settings) -> np.ndarray:
    """How many runs of all texts fall into each bucket: a table of ``buckets`` rows a task at most, added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(own.buckets, np.int64)
        for batch in batches:
            for _, _, data, bounds in textkit.text_chunks(batch["text"]):
                for _, _, buckets in run_buckets(data, bounds, own):
                    total += np.bincount(buckets, minlength=own.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(own.buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weights(gain, own: Settings):
    def weigh(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = gain.value
        for column in columns:
            n_words, n_runs, total = (np.zeros(len(column), np.int64) for _ in range(3))
            for lo, hi, data, bounds in textkit.text_chunks(column):
                for words, text, buckets in run_buckets(data, bounds, own):
                    n_words[lo:hi] += words
                    n_runs[lo:hi] += np.bincount(text, minlength=hi - lo)
                    total[lo:hi] += np.bincount(text, held[buckets], hi - lo).astype(np.int64)  # exact up to 2^53
            weight = np.where(n_runs > 0, total // np.maximum(n_runs, 1), 0)
            yield pa.StructArray.from_arrays([pa.array(x) for x in (n_words, n_runs, weight)], names=["n_words", "n_features", "weight"])

    return F.arrow_udf(weigh, "n_words bigint, n_features bigint, weight bigint")


def draw_of(key: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths from the first 8 hex digits of a key's SHA-256."""
    digits = F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "UTF-8"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def scored(docs: DataFrame, target: DataFrame, key: str, own: Settings, seq: Column | None = None) -> DataFrame:
    """(seq, doc, mark, n_words, n_features, weight, score), written. ``mark`` is a hash of the text, ``seq`` names the row."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, own), bucket_counts(target, own)))
    text = F.col("text").cast("string")
    number = F.monotonically_increasing_id() if seq is None else seq
    rows = docs.select(number.alias("seq"), F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("mark"), _weights(gain, own)(text).alias("w"))
    return spool(rows.select("seq", "doc", "mark", "w.*", (F.col("w.weight") + draw_of(F.col("doc"), own.seed)).alias("score")), "scored", TEXT_ROWS)


def _digits(rows: DataFrame, n: int) -> tuple[dict[str, Column], list[tuple[str, int]]]:
    """Columns of non-negative key parts, and (column, lowest bit) of each digit, least significant first."""
    low, high, least, most, nulls = rows.agg(F.min("doc"), F.max("doc"), F.min("score"), F.max("score"), F.count_if(F.col("doc").isNull())).first()
    columns, digits = {"by_score": F.lit(most) - F.col("score")}, []
    if not rows.groupBy("score", "doc").count().filter("count > 1").isEmpty():
        # Rows that share a key: the hash of the text decides, and then nothing that could be seen.
        columns["by_mark"] = F.col("mark")
        digits += [("by_mark", b) for b in range(0, 64, DIGIT_BITS)]
    if low is not None:
        near = high - low < 1 << 63
        doc = F.col("doc") - F.lit(low) if near else F.col("doc").bitwiseXOR(F.lit(-(1 << 63)))
        columns["by_doc"] = F.coalesce(doc, F.lit(0).cast("bigint"))
        digits += [("by_doc", b) for b in range(0, (high - low).bit_length() if near else 64, DIGIT_BITS)]
    if nulls:
        columns["by_null"] = F.col("doc").isNull().cast("bigint")
        digits.append(("by_null", 0))
    return columns, digits + [("by_score", b) for b in range(0, (most - least).bit_length(), DIGIT_BITS)]


def _placed(base: np.ndarray, schema: pa.Schema, column: str, low: int, part_rows: int):
    """The counting sort of one part: ``before`` holds how many equals lie in earlier parts, ``base`` how many rows have a smaller digit."""

    def place(rows: pa.Table, before: pa.Table) -> pa.Table:
        if not len(rows):
            return schema.empty_table()
        rows = rows.take(pa.array(np.argsort(rows["at"].to_numpy())))
        digit = ((rows[column].to_numpy().view(np.uint64) >> np.uint64(low)) & np.uint64((1 << DIGIT_BITS) - 1)).astype(np.uint8)
        start = np.zeros(1 << DIGIT_BITS, np.int64)
        start[before["digit"].to_numpy()] = before["before"].to_numpy()
        n = np.bincount(digit, minlength=len(start))
        order = np.argsort(digit, kind="stable")
        at = np.empty(len(digit), np.int64)
        at[order] = np.arange(len(digit)) - np.repeat(np.cumsum(n) - n, n)
        at += (start + base)[digit]
        for name, values in (("at", at), ("part", at // part_rows)):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return rows

    return place


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (seq, doc, mark, score and others, written) with ``rank``: 1 for the highest score, ties to the smaller doc, null last.

    Rows that share score and doc are ordered by mark; those that share all are equal in any order.
    """
    spark = rows.sparkSession
    n = rows.count()
    if n == 0:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    columns, digits = _digits(rows, n)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_ROWS))
    part_rows = -(-n // parts)
    now = rows.withColumns(columns).withColumns({"part": F.pmod(F.xxhash64("seq"), F.lit(parts)).cast("bigint"), "at": F.col("seq")})
    if not digits:
        digits = [("by_score", 0)]
    for k, (column, low) in enumerate(digits):
        digit = F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")
        counts = spool(now.groupBy("part", digit.alias("digit")).agg(F.count("*").alias("n")), "digit-counts")
        by_digit = np.zeros(1 << DIGIT_BITS, np.int64)
        for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect():
            by_digit[r["digit"]] = r["n"]
        before = counts.select("part", "digit", (F.sum("n").over(Window.partitionBy("digit").orderBy("part")) - F.col("n")).alias("before"))
        place = _placed(np.cumsum(by_digit) - by_digit, _arrow(now), column, low, part_rows)
        last, now = now, spool(now.groupBy("part").cogroup(before.groupBy("part")).applyInArrow(place, now.schema), "digit-pass")
        discard(counts, *([last] if k else []))
    return now.select(*rows.columns, (F.col("at") + 1).alias("rank"))


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def weigh(docs: DataFrame, target: DataFrame, key: str = "doc_id", settings: Settings | None = None, seq: Column | None = None) -> DataFrame:
    """(seq, doc, n_words, n_features, weight, score, rank) for every row of ``docs``; ``rank`` is null if it isn't drawn.

    Words are runs of letters and digits, A-Z in lower case, and all that isn't ASCII. Of the rows with at
    least ``min_words`` words, ``share`` per cent (rounded down) with the highest scores are drawn. Null
    and empty texts have no words and weight 0; long texts count whole; repeated rows count and rank each for
    itself. ``key`` is cast to bigint; a null draws as empty text and comes last among equal scores. An
    empty target makes all buckets as likely there. Other columns are left aside; an empty table gives
    an empty one. ``seq``, where given, must name rows the same way whenever they are read.
    """
    own = settings or Settings()
    every = scored(docs, target, key, own, seq)
    long = F.col("n_words") >= own.min_words
    order = ranked(every.filter(long))
    drawn = every.filter(long).count() * own.share // 100
    out = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(every.filter(~long).withColumn("rank", F.lit(None).cast("bigint")))
    return out.drop("mark")


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", settings: Settings | None = None, into: str = "rank") -> DataFrame:
    """The rows of ``docs`` that are drawn, with their rank in ``into`` (replaced if it is there); all columns stay.

    Rows are numbered in a written copy of ``docs``, so that each of several equal rows is drawn for itself.
    """
    seq, rank = free("seq", docs), free("drawn_rank", docs)
    own = spool(docs.withColumn(seq, F.monotonically_increasing_id()), "numbered", TEXT_ROWS)
    found = weigh(own, target, key, settings, F.col(seq)).filter("rank is not null").select(F.col("seq").alias(seq), F.col("rank").alias(rank))
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    return own.join(found, seq).select(*kept, F.col(rank).alias(into))


def op11_resample(spark, sf_dir: str) -> DataFrame:
    found = weigh(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", "rank")
