"""Fill-in-middle transformation (operator 13): a text's middle moves to its end, between marks.

A text is a run of units, each a match of one pattern. One full match of ``(unit)*`` keeps every
repetition of its group, so ``match.ends(1)`` gives the number of units and the offset behind each,
from which both cuts are read. Draws come from a SHA-256 of seed and key: they depend on a row's
own key and number of units only, so any lost task gives the same rows again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import read

CHARACTER = "(?s:.)"
#: Units of a single match: a longer text takes several, each going on where the last one ended.
MATCH_UNITS = 1 << 20

_RESULT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@dataclass(frozen=True)
class Settings:
    """``plain`` and ``spm`` are shares in per cent: of texts that stay, and of the others' second form."""

    unit: str = CHARACTER
    seed: int = 1
    plain: int = 10
    spm: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or any(a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j):
            raise ValueError("marks are not empty, and none is part of another")
        if any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)))):
            raise ValueError("no mark begins as one ends, or texts could not be rebuilt")


def _ends_by_pieces(text: str, pattern: regex.Pattern) -> np.ndarray:
    """The offset behind each unit of ``text``, match after match of a bounded number of units."""
    parts, at = [], 0
    while at < len(text):
        found = pattern.match(text, at)
        if found is None or found.end() == at:
            raise ValueError(f"no unit at code point {at}")
        parts.append(np.array(found.ends(1), np.int64))
        at = found.end()
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def compiled(unit: str, most: int = MATCH_UNITS) -> tuple[regex.Pattern, regex.Pattern]:
    """A whole text's pattern, and one for the pieces of a text of more than ``most`` code points."""
    return regex.compile(f"({unit})*"), regex.compile(f"({unit}){{1,{most}}}+")


def ends_of(text: str, whole: regex.Pattern, piece: regex.Pattern, most: int = MATCH_UNITS) -> Sequence[int]:
    """One full match where the text has no more than ``most`` code points, else match after match, packed."""
    if len(text) > most:
        return _ends_by_pieces(text, piece)
    found = whole.fullmatch(text)
    if found is None:
        raise ValueError("the text is no run of units")
    return found.ends(1)


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transformed(text: str, key: str, own: Settings, whole: regex.Pattern, piece: regex.Pattern, most: int = MATCH_UNITS) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    ends = ends_of(text, whole, piece, most)
    n = len(ends)
    one, two, three, four = draws(key, own.seed)
    if not text or any(mark in text for mark in (own.prefix, own.suffix, own.middle)) or three % 100 >= 100 - own.plain:
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = (int(ends[i - 1]) if i else 0 for i in (low, high))
    if four % 100 < own.spm:
        return n, "spm", a, b - a, f"{own.suffix}{text[b:]}{own.prefix}{text[:a]}{own.middle}{text[a:b]}"
    return n, "psm", a, b - a, f"{own.prefix}{text[:a]}{own.suffix}{text[b:]}{own.middle}{text[a:b]}"


def _transformer(own: Settings):
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        whole, piece = compiled(own.unit)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
        for keys, texts in columns:
            rows = [transformed(text.as_py() or "", key.as_py() or "", own, whole, piece) for key, text in zip(keys, texts, strict=True)]
            parts = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(parts, kinds, strict=True)], names=["n", "form", "prefix_chars", "middle_chars", "output"])

    return F.arrow_udf(run, _RESULT)


def transform(docs: DataFrame, key: str = "doc_id", settings: Settings | None = None, into: str = "fim") -> DataFrame:
    """Add ``into``: a struct of n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    The prefix ends after the smaller, the middle after the larger of two draws modulo n + 1. psm is
    prefix, suffix, middle, each after its mark, spm suffix, prefix, middle. Texts that are null or
    empty, hold a mark, or are drawn to stay are plain, with themselves as output (null: empty).
    A null key counts as empty text; equal rows have equal results. A text of more than MATCH_UNITS
    code points is matched in several steps and held whole by one task, as strings are. All columns
    stay, but one named ``into`` is replaced. An empty table gives an empty one. A text that is no run
    of ``unit`` is an error.
    """
    own = settings or Settings()
    return docs.withColumn(into, _transformer(own)(F.col(key).cast("string"), F.col("text").cast("string")))


def restored(output: Column, form: Column, settings: Settings | None = None) -> Column:
    """The text behind an output. A transformed text holds no mark of its own, so its marks cut it into four."""
    own = settings or Settings()
    quoted = "|".join("\\Q" + mark + "\\E" for mark in (own.prefix, own.suffix, own.middle))
    parts = F.split(output, quoted, -1)
    piece = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(piece(2), piece(4), piece(3))).when(form == "spm", F.concat(piece(3), piece(4), piece(2))).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = transform(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), F.sha2(F.encode(back, "UTF-8"), 256).alias("restored_sha256"))
