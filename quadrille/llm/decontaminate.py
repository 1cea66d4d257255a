"""Benchmark decontamination (operator 10): a broadcast set of normalised test n-grams against all token windows.

The benchmark's windows of ``n`` words are hashed into a sorted array that every executor holds.
Benchmarks beyond ``BLOCK_BYTES`` are cut by item into blocks of that size, scanned one after the
other, so what is broadcast stays bounded. Documents are scanned by a rolling hash over all their
words; each hit is then verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import textkit
from quadrille.llm.common import free, spool

#: Most bytes of benchmark text in one broadcast.
BLOCK_BYTES = 16 << 20
#: Rows of an Arrow batch of texts where documents are written between two blocks.
TEXT_ROWS = 1000

#: Hits that are verified at a time.
HITS = 1 << 16

_RESULT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"


class WindowSet:
    """All windows of some benchmark items: sorted hashes, the words they stand for, and the items that hold them.

    A window that many items share is one entry with a list of items, so that a hit costs the same whatever
    their number. Words are numbered by their bytes; a hit is verified against these bytes.
    """

    def __init__(self, items: list[tuple[str, str]], n: int) -> None:
        self.names = [name for name, _ in items]
        raw = [(text or "").encode() for _, text in items]
        data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        found = textkit.words(data, bounds, textkit.NON_ALNUM)
        low = textkit.lower(data)
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(low[s:e].tobytes(), len(number)) for s, e in zip(found.start, found.end, strict=True)], np.int64)
        self.bytes = np.frombuffer(b"".join(number), np.uint8)
        self.size = np.array([len(w) for w in number], np.int64)
        self.first = np.cumsum(self.size) - self.size
        #: By window length: hashes in ascending order, each window's words, and where its items begin in a list.
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = np.minimum(np.diff(found.first), n)
        for size in np.unique(sizes[sizes > 0]).tolist():
            hashes, at, first = textkit.windows(found, size)
            item = np.repeat(np.arange(len(items)), np.diff(first))
            own = np.flatnonzero(sizes[item] == size)
            words = ids[at[own][:, None] + np.arange(size)]
            order = np.lexsort((item[own], *words.T[::-1], hashes[own]))
            own, words = own[order], words[order]
            new = np.concatenate([[True], (words[1:] != words[:-1]).any(1)])
            again = ~new & np.concatenate([[False], item[own][1:] == item[own][:-1]])
            begins = np.cumsum(~again)[new] - 1
            self.lengths[size] = hashes[own][new], words[new], np.append(begins, np.count_nonzero(~again)), item[own][~again].astype(np.int32)

    def _same(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether the bytes of each span are those of the numbered word."""
        same = end - start == self.size[word]
        some = np.flatnonzero(same)
        n = self.size[word[some]]
        if n.sum():
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = data[np.repeat(start[some], n) + step] == self.bytes[np.repeat(self.first[word[some]], n) + step]
            same[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return same

    def _hits(self, low: np.ndarray, found: textkit.Words, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text's word at which a window begins, entry) of verified hits of windows of ``size`` words."""
        known, words, _, _ = self.lengths[size]
        hashes, at, first_of = textkit.windows(found, size)
        # A text of fewer words has one window of all; it is no window of this length.
        whole = at + size <= np.repeat(found.first[1:], np.diff(first_of))
        low_slot, high_slot = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
        left = np.flatnonzero(whole & (low_slot < high_slot))
        slot = low_slot[left]
        while len(left):
            for lo in range(0, len(left), HITS):
                begin, entry = at[left[lo : lo + HITS]], slot[lo : lo + HITS]
                place = begin[:, None] + np.arange(size)
                same = self._same(low, found.start[place].ravel(), found.end[place].ravel(), words[entry].ravel()).reshape(place.shape).all(1)
                yield begin[same], entry[same]
            # Windows of other words with the same hash are the next entries.
            slot = slot + 1
            more = slot < high_slot[left]
            left, slot = left[more], slot[more]

    def scan(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]], dict[int, np.ndarray], textkit.Words]:
        """Words a text, items hit by text, and the hit words of each text that has any."""
        found = textkit.words(data, bounds, textkit.NON_ALNUM)
        low = textkit.lower(data)
        items: dict[int, set[str]] = {}
        edges = np.zeros(len(found.hash) + 1, np.int64)
        for size, (_, _, begins, held) in self.lengths.items():
            pairs: list[np.ndarray] = []
            for begin, entry in self._hits(low, found, size):
                np.add.at(edges, begin, 1)
                np.add.at(edges, begin + size, -1)
                text = np.searchsorted(found.first, begin, "right") - 1
                pairs.append(np.unique(np.stack([text, entry], 1), axis=0))
            for text, entry in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else ():
                items.setdefault(text, set()).update(self.names[i] for i in held[begins[entry] : begins[entry + 1]].tolist())
        hit = np.cumsum(edges[:-1]) > 0
        marks = {i: hit[found.first[i] : found.first[i + 1]] for i in items}
        return np.diff(found.first), items, marks, found


def _byte_spans(mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return [{"start": int(start[a]), "end": int(end[b - 1])} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scanner(shared):
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own: WindowSet = shared.value
        for column in columns:
            n_words, n_hit, items, spans = [], [], [], []
            for lo, hi, data, bounds in textkit.text_chunks(column):
                per_text, hit_items, marks, found = own.scan(data, bounds)
                n_words.append(per_text)
                for i in range(hi - lo):
                    mark = marks.get(i)
                    n_hit.append(0 if mark is None else int(mark.sum()))
                    items.append(sorted(hit_items.get(i, ())))
                    a, b = found.first[i], found.first[i + 1]
                    spans.append([] if mark is None else _byte_spans(mark, found.start[a:b] - bounds[i], found.end[a:b] - bounds[i]))
            yield pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["n_words", "n_hit", "items", "spans"],
            )

    return F.arrow_udf(scan, _RESULT).asNondeterministic()


def _blocks(benchmark: DataFrame) -> list[list[tuple[str, str]]]:
    """The benchmark's items, in blocks of bounded size; one block at a time is on the driver."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).filter("text is not null and item is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    for b in range(n):
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == b)
        yield [(r["item"], r["text"]) for r in own.collect()]


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, into: str = "leak") -> DataFrame:
    """Add ``into``: a struct of n_words, n_hit (words inside any occurring window), items (ids of the
    items with occurring windows, sorted as strings) and spans (hit runs as byte offsets in the UTF-8 text).

    Words: runs of characters that are not ASCII, or ASCII letters or digits, A-Z in lower case. An
    item of fewer than ``n`` words, but not none, is one window. Null and empty texts have no words,
    items with a null id or text no windows; an empty benchmark hits nothing. Repeated rows are
    treated alike, each for itself. Long texts are scanned whole. An empty table gives an empty one. A
    column of ``docs`` named ``into`` is replaced, all others are kept.
    """
    spark = docs.sparkSession
    out, parts = docs, []
    for items in _blocks(benchmark):
        if parts:
            out = spool(out, "leak", TEXT_ROWS)
        name = free(f"leak_{len(parts)}", out)
        parts.append(name)
        out = out.withColumn(name, _scanner(spark.sparkContext.broadcast(WindowSet(items, n)))(F.col("text").cast("string")))
    if len(parts) == 1:
        return out.drop(into).withColumnRenamed(parts[0], into) if into in docs.columns else out.withColumnRenamed(parts[0], into)
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(p)["items"] for p in parts]))))
    spans = F.flatten(F.array(*[F.col(p)["spans"] for p in parts]))
    merged = _union_of_spans()(F.col("text").cast("string"), spans)
    return out.withColumn(into, F.struct(F.col(parts[0])["n_words"].alias("n_words"), merged["n_hit"].alias("n_hit"), items.alias("items"), merged["spans"].alias("spans"))).drop(*parts)


def _union_of_spans():
    """Hit words and merged spans of a text from the spans of several blocks."""

    def union(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in columns:
            out = []
            for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                if not own:
                    out.append({"n_hit": 0, "spans": []})
                    continue
                data = np.frombuffer(text.encode(), np.uint8)
                found = textkit.words(data, np.array([0, len(data)]), textkit.NON_ALNUM)
                mark = np.zeros(len(found.hash), bool)
                for s in own:
                    mark |= (found.start >= s["start"]) & (found.end <= s["end"])
                out.append({"n_hit": int(mark.sum()), "spans": _byte_spans(mark, found.start, found.end)})
            yield pa.array(out, pa.struct([("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return F.arrow_udf(union, "n_hit bigint, spans array<struct<start:bigint,end:bigint>>").asNondeterministic()


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents") -> DataFrame:
    """Drop documents with any hit (``documents``) or cut the hit runs out of their texts (``spans``).

    The columns of ``docs`` are kept as they are; clean documents, null and empty texts stay, and
    repeated rows are treated alike.
    """
    leak = free("leak", docs)
    found = find(docs, benchmark, n, leak)
    if mode == "documents":
        return found.filter(F.col(leak)["n_hit"] == 0).select(*docs.columns)
    if mode != "spans":
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    raw = F.encode("text", "UTF-8")
    keep_from = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.col(leak)["spans"], lambda s: s["end"]))
    keep_to = F.concat(F.transform(F.col(leak)["spans"], lambda s: s["start"]), F.array(F.octet_length("text").cast("bigint")))
    pieces = F.transform(F.arrays_zip(keep_from.alias("a"), keep_to.alias("b")), lambda x: F.decode(F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), "UTF-8"))
    cut = F.when(F.col(leak)["n_hit"] > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    return found.withColumn("text", cut).select(*docs.columns)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    from quadrille.llm.common import read

    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    leak = F.col("leak")
    return found.select("doc_id", leak["n_words"].alias("n_words"), leak["n_hit"].alias("n_hit"), F.size(leak["items"]).cast("bigint").alias("n_items"), F.sha2(F.array_join(leak["items"], ","), 256).alias("items_sha256"), (leak["n_hit"] > 0).alias("contaminated"))
