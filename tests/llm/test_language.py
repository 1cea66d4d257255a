"""Language identification: words, scores, paths and spans against brute force."""

from __future__ import annotations

import unicodedata

import numpy as np
import pytest

from quadrille.llm import language_id as L
from quadrille.llm import textkit


def bounds_of(texts):
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def script_of(c: str) -> int:
    if c.isascii():
        return 0
    return next((k for k, (_, a, b) in enumerate(L.SCRIPT_RANGES) if a <= ord(c) <= b), L.OTHER)


def words_of(text: str) -> list[tuple[str, int]]:
    out, word = [], ""

    def close(word):
        piece, own, run = "", L.OTHER, 0
        for i, c in enumerate(word):
            k = script_of(c)
            if i and k != L.OTHER and own != L.OTHER and k != own:
                out.append((piece, own))
                piece, run = "", 0
            elif i and k != L.OTHER and L.UNSPACED[k] and run % 2 == 0:
                out.append((piece, own))
                piece, own = "", L.OTHER
            piece, run = piece + c, run + 1
            own = k if k != L.OTHER else own
        if piece:
            out.append((piece, own))

    for c in text + " ":
        if c.isascii() and not c.isalpha():
            close(word)
            word = ""
        else:
            word += c
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = [
        ("the quick brown fox jumps over the lazy dog and runs through the green fields", "en"),
        ("le renard brun saute par dessus le chien paresseux et court dans les champs verts", "fr"),
        ("быстрая коричневая лиса прыгает через ленивую собаку и бежит по зелёным полям", "ru"),
        ("敏捷的棕色狐狸跳过懒狗然后穿过绿色的田野奔跑在阳光下面", "zh"),
    ]
    return L.train(spark.createDataFrame(rows * 3, "text string, lang string"))


TEXTS = [
    "the quick brown привет лисой fox jumps over the dog",
    "the quick brown 敏捷的棕色狐狸跳过懒狗然后穿过绿色的田野 jumps over the lazy dog",
    "renardбыстраяfox 狐狸dog “le chien” l’été",
    "", "...", "é", "敏捷的", "α the",
    "le renard brun saute par dessus the quick brown fox jumps over the lazy dog",
]


def test_words_are_cut_at_scripts():
    data, bounds = bounds_of(TEXTS)
    cut = L.cut_words(data, bounds)
    found = [(data[a:b].tobytes().decode(), int(k)) for a, b, k in zip(cut.start, cut.end, cut.script, strict=True)]
    assert found == [w for t in TEXTS for w in words_of(t)]
    assert np.diff(cut.first).tolist() == [len(words_of(t)) for t in TEXTS]
    assert all(L.cut_words(*bounds_of(["".join(w for w, _ in words_of(t))])).start.size >= 0 for t in TEXTS)


def test_only_candidates_have_a_word(model):
    data, bounds = bounds_of(TEXTS)
    cut = L.cut_words(data, bounds)
    scores = L.word_scores(cut, model)
    allowed = model.candidate[cut.script]
    assert np.isneginf(scores[~allowed]).all() and (scores[allowed] >= -L.WORD_LIMIT).all()
    assert (scores.max(1) == 0).all()


def best_path(scores: np.ndarray, switch: float) -> float:
    """The greatest sum over all label sequences, by trying every label at every word."""
    now = scores[0].astype(float)
    for row in scores[1:]:
        now = np.array([max(now[j] - (switch if j != k else 0) for j in range(len(now))) + row[k] for k in range(len(row))])
    return now.max()


def worth(path, scores, switch):
    return sum(float(scores[i, k]) for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path[:-1], path[1:], strict=True))


def test_viterbi_matches_brute_force():
    draw = np.random.default_rng(11)
    counts = [0, 1, 7, 2, 0, 30, 1]
    first = np.cumsum([0, *counts])
    scores = -draw.exponential(4, (first[-1], 3)).astype(np.float32)
    scores[draw.random(scores.shape) < 0.2] = -np.inf
    scores[np.isneginf(scores).all(1)] = 0
    path = L.viterbi(scores, first, 2.5)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            assert worth(path[a:b].tolist(), scores[a:b], 2.5) == pytest.approx(best_path(scores[a:b], 2.5))


def test_spans_of_mixed_texts(spark, model, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["language"] for r in L.identify(docs, model).collect()}
    said = lambda i: [(TEXTS[i].encode()[s["start"] : s["end"]].decode(), s["lang"]) for s in found[i]["spans"]]
    assert said(0) == [("the quick brown", "en"), ("привет лисой", "ru"), ("fox jumps over the dog", "en")]
    assert [x[1] for x in said(1)] == ["en", "zh", "en"] and said(1)[1][0] == "敏捷的棕色狐狸跳过懒狗然后穿过绿色的田野"
    assert [x[1] for x in said(8)] == ["fr", "en"]
    assert found[3]["lang"] == found[4]["lang"] == "und" and found[6]["lang"] == "zh"
    # Segments of a long text and runs of short ones make no difference.
    before = {i: tuple(r) for i, r in found.items()}
    data, bounds = bounds_of([" ".join(TEXTS) * 50])
    whole = L._label_run(data, bounds, model)
    monkeypatch.setattr(textkit.segments, "__defaults__", (300,))
    for a, b in zip(whole[3], L._label_run(data, bounds, model)[3], strict=True):
        assert a.tolist() == b.tolist()
    assert {r["doc_id"]: tuple(r["language"]) for r in L.identify(docs.repartition(3), model).collect()} == before


def test_letters_are_what_unicode_calls_letters(spark, model):
    texts = ["“”", "²", "中", "ـ", "123"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["language"]["lang"] for r in L.identify(docs, model).collect()}
    assert {i: x == "und" for i, x in found.items()} == {i: not any(unicodedata.category(c)[0] == "L" for c in t) for i, t in enumerate(texts)}
