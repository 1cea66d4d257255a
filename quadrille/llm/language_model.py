"""Language-model scoring (operator 2) by deleted interpolation of a bigram, a unigram and a uniform estimate.

Part of the learning documents is deleted from the counts and held out; on these, expectation
maximisation finds the mixture's weights for each bucket of context frequency. The scores then use
the counts of all learning documents.

Counts cover all documents. Documents are filed in blocks of bounded size. Each block asks for the
n-grams it holds: its distinct keys, in ascending order, go to key buckets with their own counts, a
packed row a block and bucket. A bucket adds the counts up and answers each block with the totals, in
the order in which the keys were asked, so no key travels back. So no task ever holds more than a
block's or a bucket's share of the vocabulary, and a frequent word is one entry a block.

Keys are 64-bit hashes of words and word pairs. Two of V distinct ones share a key with odds of
about V^2 / 2^65; then their counts are added up. Totals are 64-bit wherever they outgrow a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import textkit
from quadrille.llm.common import discard, read, remainder, spool

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Rows of an Arrow batch of texts.
TEXT_ROWS = 1000
#: By crc32 of the key modulo FOLDS: 0 is for testing, 1 is held out from the counts for the weights.
FOLDS, TEST, HELD = 10, 0, 1
#: Context-frequency buckets: log2 of the context's count, at most this.
MOST_BUCKET = 15
#: Cells a decade of probability for the sufficient statistics of the weights, and decades.
CELLS, DECADES = 8, 12
EM_ROUNDS = 60
PSEUDO_COUNT = 0.1
#: The fewest and most bits of a key that choose its bucket.
BITS = (6, 20)

_END = textkit.mix(np.array([0x1F5EED], np.uint64))[0]
_REQUEST = "kind int, bucket int, block bigint, keys binary, main binary, held binary, other binary"
_REPLY = "kind int, bucket int, block bigint, main binary, held binary"


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers as bytes: steps from one to the next, as many bytes each as the widest needs."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=values[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width, first = data[0], int.from_bytes(data[1:9], "little")
    steps = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(first)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts as bytes; those from 255 on follow as eight bytes each. Nothing at all if all are 0."""
    if not n.any():
        return b""
    large = n[n >= 255]
    return np.minimum(n, 255).astype(np.uint8).tobytes() + large.astype("<u8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    if not data:
        return np.zeros(n, np.int64)
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words with an end after each text, the token before each, both as a pair, first token of each text), as keys."""
    found = textkit.words(data, bounds, textkit.SPACES)
    n = np.diff(found.first)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    token = np.full(first[-1], _END, np.uint64)
    place = np.arange(len(found.hash)) + np.repeat(np.arange(len(n)), n)
    token[place] = found.hash
    before = np.concatenate([[_END], token[:-1]]) if len(token) else token
    pair = textkit.mix(before * np.uint64(0xA0761D6478BD642F) + token * np.uint64(0xE7037ED1A0B428DB))
    return token, before, pair, first


class Block:
    """All tokens of a block's texts: words, contexts and pairs, with the part of each token's text."""

    def __init__(self, tables: list[pa.RecordBatch]) -> None:
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for table in tables:
            part = table["part"].to_numpy()
            for lo, hi, data, bounds in textkit.text_chunks(table["text"]):
                *keys, first = _tokens(data, bounds)
                n = np.diff(first)
                for own, x in zip(parts, (*keys, np.repeat(part[lo:hi], n), n), strict=True):
                    own.append(x)
        self.word, self.before, self.pair, self.part, self.length = (np.concatenate(x) for x in parts)

    def distinct(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """The block's distinct words or pairs in ascending order, and each token's place among them."""
        return np.unique(self.pair if kind else self.word, return_inverse=True)


def _requests(bits: int):
    def ask(block: int, own: Block) -> Iterator[pa.RecordBatch]:
        for kind in (0, 1):
            keys, where = own.distinct(kind)
            main, held, other = (np.bincount(where[chosen], minlength=len(keys)) for chosen in ((own.part != HELD) & (own.part != TEST), own.part == HELD, own.part == TEST))
            cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            rows = [(kind, b, block, pack_sorted(keys[x:y]), *(pack_counts(c[x:y]) for c in (main, held, other))) for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
            yield _rows(rows, _REQUEST)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, tables in _by_block(batches):
            yield from ask(block, Block(tables))

    return count


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each block; those of held-out documents (odd numbers) stand among those of the others."""
    open_: dict[int, tuple[int, list[pa.RecordBatch]]] = {}
    for batch in batches:
        for b in batch["block"].unique().to_pylist():
            rows = batch.filter(pc.equal(batch["block"], b))
            if b & 1 in open_ and open_[b & 1][0] != b:
                yield open_.pop(b & 1)
            open_.setdefault(b & 1, (b, []))[1].append(rows)
    yield from open_.values()


def _answer(table: pa.Table) -> pa.Table:
    """All requests of a bucket to replies. Words' buckets reply to block -1, too: tokens and distinct
    words, without the held-out documents and with them."""
    kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
    keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
    sizes = [len(x) for x in keys]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = []
    for column in ("main", "held"):
        own = np.concatenate([unpack_counts(x, n) for x, n in zip(table[column].to_pylist(), sizes, strict=True)])
        total.append(np.bincount(where, own, len(every)).astype(np.int64))  # sums are exact up to 2^53
    main, held = total
    bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    rows = [(kind, bucket, block, pack_counts(main[where[a:b]]), pack_counts(held[where[a:b]])) for block, a, b in zip(table["block"].to_pylist(), bounds[:-1], bounds[1:], strict=True)]
    if kind == 0:
        learned = main + held
        rows.append((kind, bucket, -1, np.array([main.sum(), (main > 0).sum(), learned.sum(), (learned > 0).sum()], "<i8").tobytes(), b""))
    return pa.Table.from_batches([_rows(rows, _REPLY)])


def _totals_of(own: Block, replies: pa.Table, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words and pairs: each token's place among the distinct ones, and their counts in ``main`` and ``held``."""
    rows = {(r["kind"], r["bucket"]): (r["main"], r["held"]) for r in replies.to_pylist()}
    out = []
    for kind in (0, 1):
        keys, where = own.distinct(kind)
        cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
        said = [[unpack_counts(rows[kind, b][k], y - x) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x] for k in (0, 1)]
        out.append((where, *(np.concatenate(x) for x in said)))
    return out


def _counted(table: pa.Table, replies: pa.Table, bits: int, deleted: bool) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """A block, and for each of its tokens the counts of word, context and pair, without the held-out
    documents if ``deleted``. Every context but that of a block's first token is a word of the block."""
    own = Block(table.to_batches())
    (word_at, *word_n), (pair_at, *pair_n) = _totals_of(own, replies, bits)
    counts = [main if deleted else main + held for main, held in (word_n, pair_n)]
    word, pair = counts[0][word_at], counts[1][pair_at]
    # Each text ends with the end, so the token before any text's first is an end, too.
    end = word[own.length.cumsum() - 1]
    context = np.concatenate([end[:1], word[:-1]])
    return own, word, context, pair


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(count + 1).astype(np.int64), MOST_BUCKET)


def _cell(p: np.ndarray) -> np.ndarray:
    """0 for probability 0, else a cell of the logarithm."""
    with np.errstate(divide="ignore"):
        level = np.where(p > 0, np.log10(np.maximum(p, 1e-300)), -np.inf)
    return np.where(p > 0, 1 + np.clip(np.round((level + DECADES) * CELLS), 0, DECADES * CELLS), 0).astype(np.int64)


def _statistics(bits: int, n: int):
    side = DECADES * CELLS + 2

    def gather(texts: pa.Table, replies: pa.Table) -> pa.Table:
        own, word, context, pair = _counted(texts, replies, bits, deleted=True)
        cell = (context_bucket(context) * side + _cell(pair / np.maximum(context, 1))) * side + _cell(word / max(n, 1))
        at, total = np.unique(cell, return_counts=True)
        return pa.table({"cell": pa.array(at, pa.int64()), "n": pa.array(total, pa.int64())})

    return gather


def fit_weights(cells: np.ndarray, n: np.ndarray, uniform: float) -> np.ndarray:
    """EM over the held-out tokens' cells: weights of (bigram, unigram, uniform) a context bucket."""
    side = DECADES * CELLS + 2
    bucket, p2, p1 = cells // (side * side), cells // side % side, cells % side
    value = np.concatenate([[0.0], 10 ** (np.arange(DECADES * CELLS + 1) / CELLS - DECADES)])
    estimates = np.stack([value[p2], value[p1], np.full(len(cells), uniform)], 1)
    weights = np.tile([1 / 3, 1 / 3, 1 / 3], (MOST_BUCKET + 1, 1))
    # Half a token for each estimate keeps all weights above 0 in buckets with few tokens.
    for _ in range(EM_ROUNDS):
        share = weights[bucket] * estimates
        share *= (n / share.sum(1))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, j], MOST_BUCKET + 1) for j in range(3)], 1) + np.array([0.0, 0.5, 0.5])
        weights = sums / sums.sum(1, keepdims=True)
    # No context, no bigram estimate.
    weights[0] = weights[0] * [0, 1, 1] / weights[0, 1:].sum()
    return weights


def file_blocks(docs: DataFrame, key: str) -> DataFrame:
    """(key, part, text, block), written: blocks are runs of a partition's rows of about BLOCK_BYTES,
    those of held-out documents (with odd numbers) apart from the others."""
    kind = dict(docs.dtypes)[key]
    filed = docs.select(F.col(key).alias("key"), remainder(F.col(key), FOLDS).cast("int").alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, held = TaskContext.get().partitionId() << 32, [0, 0]
        for batch in batches:
            size = pc.binary_length(batch["text"]).to_numpy().astype(np.int64) + 1
            apart = batch["part"].to_numpy() == HELD
            block = np.zeros(len(size), np.int64)
            for k, chosen in enumerate((~apart, apart)):
                upto = held[k] + np.cumsum(size[chosen])
                block[chosen] = 2 * (base + upto // BLOCK_BYTES) + k
                held[k] = int(upto[-1]) if len(upto) else held[k]
            yield batch.append_column("block", pa.array(block))

    return spool(filed.mapInArrow(number, f"key {kind}, part int, text string, block bigint"), "blocks", TEXT_ROWS)


def score(docs: DataFrame, key: str = "doc_id", fitted: dict | None = None) -> DataFrame:
    """(key, part, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Tokens: words between white space, A-Z in lower case, and one end a text. Null and empty texts are
    the end alone; long texts are scored whole. ``base_score`` is the add-0.1 unigram log10
    probability, ``score`` the mixture's. Documents whose crc32 of the key is 0 modulo 10 teach
    nothing; a null key counts as empty text. With nothing to learn from, all counts are 0. Repeated
    rows count and are scored each for itself; an empty table gives an empty one. Other columns are
    left aside. ``fitted``, if given, gets the mixture's weights and the training totals.
    """
    spark = docs.sparkSession
    blocks = file_blocks(docs.select(key, "text"), key)
    n_blocks = blocks.agg(F.count_distinct("block")).first()[0]
    bits = int(np.clip(np.ceil(np.log2(max(n_blocks, 1))), *BITS))
    requests = blocks.select("block", "part", "text").mapInArrow(_requests(bits), _REQUEST)
    replies = spool(requests.groupBy("kind", "bucket").applyInArrow(_answer, _REPLY), "replies", TEXT_ROWS)
    sums = np.zeros(4, np.int64)
    for row in replies.filter("block = -1").select("main").toLocalIterator():
        sums = sums + np.frombuffer(row["main"], "<i8")
    n_main, v_main, n, v = (int(x) for x in sums)
    asked = replies.filter("block >= 0")
    odd = F.col("block").bitwiseAND(1) == 1
    apart = blocks.filter(odd).select("block", "part", "text").groupBy("block").cogroup(asked.filter(odd).groupBy("block"))
    held = apart.applyInArrow(_statistics(bits, n_main), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = fit_weights(held["cell"].to_numpy(np.int64), held["n"].to_numpy(np.float64), 1 / (v_main + 1))
    if fitted is not None:
        fitted.update(weights=weights, tokens=n, distinct=v)

    def rate(texts: pa.Table, answers: pa.Table) -> pa.Table:
        own, word, context, pair = _counted(texts, answers, bits, deleted=False)
        base = np.log10((word + PSEUDO_COUNT) / (n + PSEUDO_COUNT * (v + 1)))
        w = weights[context_bucket(context)]
        model = np.log10(w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] / (v + 1))
        first = own.length.cumsum() - own.length
        add = lambda x: pa.array(np.add.reduceat(x, first))  # noqa: E731  every text has its end
        return pa.table({"key": texts["key"], "part": texts["part"], "n_tokens": pa.array(own.length, pa.int64()), "n_known": add((word > 0).astype(np.int64)), "base_score": add(base), "score": add(model)})

    kind = dict(docs.dtypes)[key]
    rated = spool(blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(rate, f"key {kind}, part int, n_tokens bigint, n_known bigint, base_score double, score double"), "rated")
    discard(blocks, replies)
    return rated.select(F.col("key").alias(key), "part", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def op2_score(spark, sf_dir: str) -> DataFrame:
    found = score(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", (F.col("part") == TEST).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
