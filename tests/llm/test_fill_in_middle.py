"""Fill-in-middle against a plain version: nulls, marks, long texts, other units, and back again."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quadrille.llm import fill_in_middle as fim


def plain_version(text: str | None, key: str) -> tuple:
    text = text or ""
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    parts = ["<P>" + text[:a], "<S>" + text[b:], "<M>" + text[a:b]]
    if h[3] % 100 < 20:
        parts[:2] = parts[1::-1]
    return n, "psm" if h[3] % 100 >= 20 else "spm", a, b - a, "".join(parts)


def texts() -> list[str | None]:
    draw = random.Random(5)
    alphabet = "ab<>PSM \n\r\x00é你😀́"
    made = ["".join(draw.choices(alphabet, k=draw.randint(1, 40))) for _ in range(300)]
    return [None, "", "a", "\n", "<P", "<", "P>", "a<<S", "x<S>y", "<M>", "😀" * 9, "é", "long 你 " * 40_000, "\r\n\r\n", *made, *made[:5]]


def test_rows_match_and_texts_come_back(spark):
    rows = [(i if i % 17 else None, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fim string").repartition(3)
    made = fim.transform(docs).withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert made[0].__fields__ == ["doc_id", "text", "fim", "back"]
    want = sorted(((i, t, *plain_version(t, "" if i is None else str(i))) for i, t, _ in rows), key=repr)
    assert sorted(((r["doc_id"], r["text"], *r["fim"]) for r in made), key=repr) == want
    assert all(r["back"] == (r["text"] or "") for r in made)
    assert {r["fim"]["form"] for r in made} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


def test_pieces_of_a_long_text_give_the_same_ends():
    whole, piece = fim.compiled(fim.CHARACTER, 7)
    for text in ("", "a" * 7, "a" * 8, "é\n" * 50):
        assert list(fim.ends_of(text, whole, piece, 7)) == list(fim.ends_of(text, whole, piece)) == list(range(1, len(text) + 1))
    whole, piece = fim.compiled(r"[^\n]*\n|[^\n]+", 2)
    text = "one\ntwo\n\nthree\nfour"
    assert list(fim.ends_of(text, whole, piece, 4)) == list(fim.ends_of(text, whole, piece)) == [4, 8, 9, 15, 19]
    with pytest.raises(ValueError):
        fim.ends_of("ab", *fim.compiled("a"))


def test_lines_and_words_as_units(spark):
    docs = spark.createDataFrame([(i, f"line {i}\nnext\n\nlast") for i in range(60)], "doc_id bigint, text string")
    own = fim.Settings(unit=r"[^\n]*\n|[^\n]+", seed=9, plain=0, spm=50, prefix="[[A]]", suffix="[[B]]", middle="[[C]]")
    made = fim.transform(docs, settings=own).withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"), own)).collect()
    assert all(r["fim"]["n"] == 4 and r["back"] == r["text"] for r in made) and {r["fim"]["form"] for r in made} == {"psm", "spm"}
    ends = {0, len("line 1\n"), len("line 11\n"), len("line 1\nnext\n"), len("line 11\nnext\n"), len("line 1\nnext\n\n"), len("line 11\nnext\n\n"), len("line 1\nnext\n\nlast"), len("line 11\nnext\n\nlast")}
    assert {r["fim"]["prefix_chars"] for r in made} <= ends


@pytest.mark.parametrize("marks", [("", "b", "c"), ("a", "a", "c"), ("ab", "b", "c"), ("<a", "a<", "x")])
def test_marks_that_could_not_be_told_apart_are_errors(marks):
    with pytest.raises(ValueError):
        fim.Settings(prefix=marks[0], suffix=marks[1], middle=marks[2])
