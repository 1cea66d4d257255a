"""Token ids on disk (operator 7) in patched frame-of-reference blocks.

A file holds the ids of a run of documents in order. Blocks of ``BLOCK`` ids store the block's
minimum, the low bits of each difference packed at a width that covers ``PERCENTILE`` of them, and
an exception list (position, high bits) for the rest. The footer has the byte at which each block
starts and the documents' ids and lengths, so any document can be read without those before it.

Layout, little-endian: ``QFOR1``; blocks; block starts (u64 each); documents (i64 id, u8 null mark,
u64 length each); then u64 blocks, u64 documents, u64 ids, u64 position of the block starts, ``QFOR1``.
Block: u32 ids, u32 minimum, u8 width, u32 exceptions, packed bits, u16 positions, u32 high parts.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import filesystem, new_path, read, spool

BLOCK = 4096
PERCENTILE = 95
MAGIC = b"QFOR1"
END_ID = 0
#: Pieces of text whose ids a worker remembers, in each of two generations, and the characters of
#: texts that it cuts at a time; only speed and memory depend on them.
REMEMBERED, RUN_CHARS = 500_000, 1 << 23
#: Punctuation that a byte-level pre-tokenizer cuts off a letter or digit before it.
CLOSING = ".,;:!?*#$%&)"
_ODD_SPACE, _BEFORE_WORD = re.compile(r"[ \n]\s| \Z"), re.compile(r" (?=\S)")
_BLOCK_HEAD = struct.Struct("<IIBI")
_TAIL = struct.Struct("<QQQQ5s")


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other."""
    if not width:
        return b""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray) -> bytes:
    least = int(ids.min())
    above = (ids - np.uint32(least)).astype(np.uint32)
    at = -(-(len(above) - 1) * PERCENTILE // 100)
    width = int(np.partition(above, at)[at]).bit_length()
    odd = np.flatnonzero(above >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    low = above & np.uint32((1 << width) - 1)
    return _BLOCK_HEAD.pack(len(ids), least, width, len(odd)) + pack(low, width) + odd.astype("<u2").tobytes() + (above[odd] >> np.uint32(width)).astype("<u4").tobytes()


def decode_block(stream) -> np.ndarray:
    n, least, width, odd = _BLOCK_HEAD.unpack(stream.read(_BLOCK_HEAD.size))
    out = unpack(stream.read((n * width + 7) // 8), n, width)
    at = np.frombuffer(stream.read(2 * odd), "<u2")
    out[at] |= np.frombuffer(stream.read(4 * odd), "<u4") << np.uint32(width)
    return out + np.uint32(least)


class Writer:
    """Documents in, blocks out; holds less than one block of ids."""

    def __init__(self, stream) -> None:
        self.stream, self.starts, self.docs, self.held, self.n_held, self.total = stream, [], [], [], 0, 0
        stream.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= BLOCK:
            flat = np.concatenate(self.held)
            whole = len(flat) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(flat[k : k + BLOCK])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.starts.append(self.at)
        data = encode_block(ids)
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        self.stream.write(np.array(self.starts, "<u8").tobytes())
        docs = np.array([(0 if d is None else d, d is None, n) for d, n in self.docs], [("id", "<i8"), ("null", "u1"), ("n", "<u8")])
        self.stream.write(docs.tobytes())
        self.stream.write(_TAIL.pack(len(self.starts), len(self.docs), self.total, self.at, MAGIC))


def read_file(fs, path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file in order, decoded block by block."""
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        f.seek(size - _TAIL.size)
        _, n_docs, _, at, magic = _TAIL.unpack(f.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        f.seek(at)
        starts_and_docs = f.read(size - _TAIL.size - at)
        kinds = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])
        docs = np.frombuffer(starts_and_docs[len(starts_and_docs) - n_docs * kinds.itemsize :], kinds)
        f.seek(len(MAGIC))
        left = np.zeros(0, np.uint32)
        for doc in docs:
            parts, need = [left], int(doc["n"]) - len(left)
            while need > 0:
                parts.append(decode_block(f))
                need -= len(parts[-1])
            flat = np.concatenate(parts)
            left = flat[int(doc["n"]) :]
            yield None if doc["null"] else int(doc["id"]), flat[: int(doc["n"])]


class Encoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    The pre-tokenizer of a byte-level vocabulary always begins a new piece at a blank before another
    character, at a line's end after one, and at punctuation after a letter or digit. Texts are cut
    into pieces at the first two, pieces into a stem and closing punctuation at the last, and each
    distinct stem and closing is encoded once. A text that holds an added token's content (special or
    not) is encoded whole, as such tokens are matched first.

    A piece is known by what follows its blank. Pieces without one begin with their line's end, or
    with a tab in its place (a text's first), which can't follow a blank where texts are cut.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Two generations: what was seen since the last change, and what was seen before it.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: In a byte-level vocabulary a token has a character for each byte.
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _holds_added(self, text: str) -> bool:
        return any(content in text for content in self.added)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn; pieces are held of a run of texts at a time."""
        lo, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= RUN_CHARS or i + 1 == len(texts):
                yield from self._run(texts[lo : i + 1])
                lo, held = i + 1, 0

    def _run(self, texts: list[str]) -> Iterator[np.ndarray]:
        whole = {i: np.array(self._batch([x])[0], "<u4") for i, x in enumerate(texts) if self._holds_added(x)}
        odd = {i for i, x in enumerate(texts) if i not in whole and _odd(x)}
        plain = [i for i in range(len(texts)) if i not in whole and i not in odd]
        split = pc.split_pattern(pa.array(["\t" + texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
        by_regex = pa.array([_BEFORE_WORD.split("\t" + texts[i]) for i in sorted(odd)], pa.list_(pa.large_string()))
        n_pieces = np.concatenate([pc.list_value_length(split), pc.list_value_length(by_regex)]).astype(np.int64)
        coded = pa.concat_arrays([split.flatten(), by_regex.flatten()]).dictionary_encode()
        first, second, ids = self._units(coded.dictionary)
        units = np.stack([first, second], 1).astype(np.int32)[coded.indices.to_numpy()].ravel()
        there = units >= 0
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        ends = np.concatenate([[0], np.cumsum(there)])[2 * np.concatenate([[0], np.cumsum(n_pieces)])]
        units = units[there]
        length = size[units]
        upto = np.concatenate([[0], np.cumsum(length)])
        out = flat[np.arange(upto[-1]) + np.repeat(start[units] - upto[:-1], length)]
        bounds = upto[ends]
        place = {i: k for k, i in enumerate([*plain, *sorted(odd)])}
        for i in range(len(texts)):
            yield whole[i] if i in whole else out[bounds[place[i]] : bounds[place[i] + 1]]

    def _units(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Each piece's stem and closing (-1 without one) as places in the list of ids."""
        trimmed = pc.utf8_rtrim(pieces, CLOSING)
        changed = np.flatnonzero(pc.binary_length(trimmed).to_numpy() != pc.binary_length(pieces).to_numpy())
        stems, closing = _strings(trimmed), np.full(len(pieces), -1)
        endings: dict[str, int] = {}
        for i, piece in zip(changed.tolist(), _strings(pieces.take(pa.array(changed))), strict=True):
            stem = stems[i]
            if stem and stem[-1].isalnum():
                closing[i] = endings.setdefault(piece[len(stem) :], len(endings))
            else:
                stems[i] = piece
        coded = pa.array(stems, pa.large_string()).dictionary_encode()
        asked = _strings(coded.dictionary)
        known, older = self.known, self.older
        new = [x for x in asked if x not in known]
        if len(known) + len(new) > REMEMBERED:
            self.older = older = known
            self.known = known = {}
            new = asked
        kept = [x for x in new if x in older]
        if kept:
            known.update((x, older[x]) for x in kept)
            new = [x for x in new if x not in known]
        if new:
            self._learn(new)
            known = self.known
        ids = [known[x] for x in asked] + [np.array(x, "<u4").tobytes() for x in self._batch(list(endings))]
        return coded.indices.to_numpy(), np.where(closing >= 0, closing + len(asked), -1), ids

    def _learn(self, new: list[str]) -> None:
        """Encode stems run together, and cut the ids where a stem's bytes end."""
        heads = [x for x in new if x[0] == "\t"]
        follows = [x for x in new if x[0] != "\t"]
        said = [x if x[0] == "\n" else " " + x for x in follows]
        joined = "".join(said)
        if self._holds_added(joined):  # only where stems meet
            self.known.update((x, np.array(ids, "<u4").tobytes()) for x, ids in zip(follows, self._batch(said), strict=True))
        else:
            ids = np.array(self._batch([joined])[0], "<u4")
            ends = np.cumsum(self.bytes_of[ids])
            length = pc.binary_length(pa.array(said, pa.large_string())).to_numpy()
            cuts = (4 * (np.searchsorted(ends, np.cumsum(length)) + 1)).tolist()
            flat = ids.tobytes()
            self.known.update((x, flat[a:b]) for x, a, b in zip(follows, [0, *cuts][:-1], cuts, strict=True))
        self.known.update((x, np.array(ids, "<u4").tobytes()) for x, ids in zip(heads, self._batch([x[1:] for x in heads]), strict=True))


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _odd(text: str) -> bool:
    """Whether white space stands where pieces of ``text`` would begin, other than one line's end."""
    if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or text.endswith(" "):
        return True
    return not text.replace("\n", "").isprintable() and _ODD_SPACE.search(text) is not None


@functools.cache
def encoder(path: str) -> Encoder:
    """One a worker process, so that its tasks share what it remembers."""
    return Encoder(path)


def write(docs: DataFrame, folder: str, tokenizer_path: str, partitions: int | None = None) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order, nulls first, equal ids by hash and text.

    Returns the files in order: (part, file, n_docs, n_tokens). Null and empty texts are the end alone;
    each document ends with id 0. A long text is encoded whole. Repeated rows are all written; rows
    that share a doc_id, or have none, are dealt over tasks by their texts' hashes. An empty table
    has no files. Other columns of ``docs`` are left aside.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        context, own = TaskContext.get(), encoder(tokenizer_path)
        fs, root = filesystem(folder)
        fs.create_dir(root)
        part = context.partitionId()
        draft, name = f"{root}/.part-{part:06d}.{context.taskAttemptId()}", f"part-{part:06d}.qfor"
        with fs.open_output_stream(draft) as out:
            writer = Writer(out)
            for batch in batches:
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), own.encode_all(batch["text"].to_pylist()), strict=True):
                    writer.add(doc_id, np.append(ids, np.uint32(END_ID)))
            writer.close()
        if writer.docs:
            fs.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": [len(writer.docs)], "n_tokens": [writer.total]})
        else:
            fs.delete_file(draft)

    return spool(ordered.mapInArrow(encode, "part int, file string, n_docs bigint, n_tokens bigint"), "token-files")


def read_back(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (over all files), n_tokens, ids_crc32. The window runs over files."""
    placed = files.selectExpr("*", "coalesce(sum(n_tokens) over (order by part rows between unbounded preceding and 1 preceding), 0) as file_start")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, at in zip(batch["file"], batch["file_start"], strict=True):
                rows = []
                for doc_id, ids in read_file(*filesystem(path)):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) >= 50_000:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    return placed.repartition(max(1, spark.sparkContext.defaultParallelism), "part").mapInPandas(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    doc_id, start, n, crc = zip(*rows, strict=True)
    return pd.DataFrame({"doc_id": pd.array(doc_id, "Int64"), "start": start, "n_tokens": n, "ids_crc32": crc})


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write(read(spark, sf_dir, "documents"), new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_back(spark, files)
