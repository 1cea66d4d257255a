"""Line dedup (operator 12), by DataFrame functions alone: sorted hash ranges, and keep bitmaps instead of text.

Every line with a key is one narrow entry: the key's hash, its document and its position. Entries are
cut into ranges of (hash, document), sorted by hash, document and position, and streamed: the first
occurrence of a key in a document counts the document. A key that a third of all lines share spans
as many ranges as its entries fill, and each range adds up its own part before keys meet.

Keys of enough documents go back to their entries: those with many entries, few by a bound, are
broadcast, all others meet them by hash. What goes on is a compressed bitmap a document, of its 64-line
words that lose a line; words not listed keep all. Texts move once, when bitmaps are applied.

Keys are 96 bits of hashes: two of V distinct ones share them with odds of about V^2 / 2^97.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import discard, free, read, spool

#: What is stripped at both ends of a line: 0x20 and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, MIN_CHARS = 10, 1
#: Keys that are broadcast at most, some 20 bytes each: all if they are no more, else those with more
#: entries than a HOT_KEYS-th of all entries.
HOT_KEYS = 200_000


def lines_of(text: Column) -> Column:
    """A null or empty text is one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without white space at both ends, A-Z (and no others) in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _mark(text: Column) -> Column:
    """Together with the key it names a document; rows equal in both have equal lines and share a bitmap."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def entries(docs: DataFrame, key: str, min_chars: int) -> DataFrame:
    """(h, g, doc, mark, row, pos): every line with a key of at least ``min_chars`` code points, as hashes."""
    rows = docs.select(F.col(key).alias("doc"), _mark(F.col("text")).alias("mark"), F.monotonically_increasing_id().alias("row"), lines_of(F.col("text")).alias("lines"))
    split = rows.select("doc", "mark", "row", F.posexplode("lines").alias("pos", "line"))
    named = split.select("doc", "mark", "row", "pos", key_of(F.col("line")).alias("name"))
    return named.filter(F.char_length("name") >= max(1, min_chars)).select(F.xxhash64("name").alias("h"), F.hash("name").alias("g"), "doc", "mark", "row", "pos")


def _counted(found: DataFrame) -> DataFrame:
    """(h, g, docs, lines, first): documents and lines a key, and where it comes first."""
    ranged = found.repartitionByRange("h", "g", "doc", "row")
    place = F.row_number().over(Window.partitionBy("h", "g", "doc", "row").orderBy("pos"))
    streamed = ranged.withColumn("new", (place == 1).cast("bigint"))
    return streamed.groupBy("h", "g").agg(F.sum("new").alias("docs"), F.count("*").alias("lines"), F.min(F.struct("doc", "mark", "pos")).alias("first"))


def _of_frequent(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """The entries of ``frequent`` keys (spooled), with their first place."""
    keys = frequent.select("h", "g", "first")
    if frequent.count() <= HOT_KEYS:
        return found.join(F.broadcast(keys), ["h", "g"])
    most = found.count() // HOT_KEYS
    hot, cold = (frequent.filter(c).select("h", "g", "first") for c in (F.col("lines") > most, F.col("lines") <= most))
    apart = found.join(F.broadcast(hot.select("h", "g", F.lit(True).alias("hot"))), ["h", "g"], "left")
    return found.join(F.broadcast(hot), ["h", "g"]).unionByName(apart.filter("hot is null").drop("hot").join(cold.hint("merge"), ["h", "g"]))


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: str = "none") -> DataFrame:
    """(doc, mark, n_dropped, words) of each document that loses a line.

    ``words`` lists, in order, the 64-line words that lose one: struct(word, keep), where bit i of keep
    is line 64 * word + i. ``mark`` is the hash of the text. Keys of at least ``min_chars`` code points
    that at least ``min_docs`` rows hold lose all their lines (keep "none"), or all but the first by
    key column, hash of the text and position ("first"). Each row is a document of its own, repeated rows too; rows equal
    in key column and text share a bitmap, and with "first" keep the same. A null in the key column is a
    value like others, first in order. Null and empty texts are one empty line and lose nothing; long
    texts count whole. An empty table gives an empty one.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    found = spool(entries(docs, key, min_chars), "line-entries")
    frequent = spool(_counted(found).filter(F.col("docs") >= min_docs), "frequent-lines")
    hit = _of_frequent(found, frequent)
    if keep == "first":
        hit = hit.filter(~(F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.mark") == F.col("mark")) & (F.col("first.pos") == F.col("pos"))))
    bits = hit.groupBy("doc", "mark", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("gone"))
    words = bits.groupBy("doc", "mark").agg(F.sum(F.bit_count("gone")).cast("bigint").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("keep")))).alias("words"))
    made = spool(words, "keep-bitmaps")
    discard(found, frequent)
    return made


def dense(words: Column) -> Column:
    """A bitmap's words from the first to the last listed, as array<bigint>; all bits of words between are set."""
    at = F.transform(words, lambda w: w["word"])
    before = F.concat(F.array(F.lit(-1)), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))))
    return F.flatten(F.zip_with(words, before, lambda w, b: F.concat(F.array_repeat(F.lit(-1).cast("bigint"), w["word"] - b - 1), F.array(w["keep"]))))


def apply(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", into: str = "lines") -> DataFrame:
    """``docs`` with the lines that ``bitmaps`` keep, joined by line feeds, and ``into``: struct(n_lines, n_dropped).

    ``n_lines`` counts lines before. Null texts stay null. A column named ``into`` is replaced; all
    others stay.
    """
    doc, mark, n, bits, own = (free(x, docs) for x in ("doc", "mark", "n_dropped", "bits", "own_lines"))
    small = bitmaps.select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("n_dropped").alias(n), dense(F.col("words")).alias(bits))
    met = docs.join(small, F.col(key).eqNullSafe(F.col(doc)) & (_mark(F.col("text")) == F.col(mark)), "left")
    kept = F.array_join(F.filter(F.col(own), lambda x, i: F.coalesce(F.getbit(F.get(F.col(bits), F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))), F.lit(1).cast("tinyint")) == 1), "\n")
    told = F.struct(F.size(own).cast("bigint").alias("n_lines"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("n_dropped"))
    out = met.withColumn(own, lines_of(F.col("text"))).withColumns({"text": F.when(F.col(n).isNull(), F.col("text").cast("string")).otherwise(kept), into: told})
    return out.drop(doc, mark, n, bits, own)


def dedup(docs: DataFrame, key: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: str = "none", into: str = "lines") -> DataFrame:
    """``apply`` of ``keep_bitmaps``: documents without the lines that many documents hold."""
    return apply(docs, keep_bitmaps(docs, key, min_docs, min_chars, keep), key, into)


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("lines.n_lines"), F.col("lines.n_dropped"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
