"""Line dedup against a plain version: bitmaps, both modes, hot and cold keys, nulls and repeated rows."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from quadrille.llm import line_dedup as ld

SCHEMA = "doc_id bigint, text string, mark string, pos string"


def name(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain_version(rows, min_docs, min_chars=1, keep="none"):
    holders = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    for i in order:
        for pos, line in enumerate((rows[i][1] or "").split("\n")):
            if len(name(line)) >= min_chars:
                holders[name(line)].append((i, pos))
    bad = {k: v[0] for k, v in holders.items() if len({i for i, _ in v}) >= min_docs}
    out = []
    for i, (doc, text, *_) in enumerate(rows):
        lines = (text or "").split("\n")
        first = lambda k: keep == "first" and rows[bad[k][0]][:2] == (doc, text)
        kept = [x for pos, x in enumerate(lines) if name(x) not in bad or (first(name(x)) and bad[name(x)][1] == pos)]
        out.append((doc, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def rows(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    pool = ["common", " Common\t", "COMMON", "é shared", "É shared", "", "  ", "\x0bpair\x0c", "Pair\r", " nbsp", "x" * 300]
    own = [(i, "\n".join(draw.choice([*pool, f"only {i} {draw.random()}"]) for _ in range(draw.randint(1, 9)))) for i in range(80)]
    own += [(200, None), (201, ""), (202, "\n"), (203, "common\n" * 400 + "tail\n" + "common\n" * 99), (204, "often here\n" * 50), (None, "common\nfree"), (None, "common\nfree"), own[0], own[0], (own[1][0], "same id\nother text")]
    return [(*r, "m", "p") for r in own]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(1), SCHEMA).repartition(5)


@pytest.mark.parametrize(("min_docs", "min_chars", "keep", "hot"), [(10, 1, "none", 200_000), (2, 1, "none", 3), (5, 7, "none", 1), (10, 1, "first", 200_000), (4, 1, "first", 2)])
def test_same_as_plain_version(docs, monkeypatch, min_docs, min_chars, keep, hot):
    monkeypatch.setattr(ld, "HOT_KEYS", hot)
    found = ld.dedup(docs, min_docs=min_docs, min_chars=min_chars, keep=keep)
    assert found.columns == [*docs.columns, "lines"]
    got = sorted(((r["doc_id"], r["text"], *r["lines"]) for r in found.collect()), key=repr)
    assert got == plain_version(rows(1), min_docs, min_chars, keep)


def test_bitmaps_list_only_words_that_lose_a_line(spark):
    text = "\n".join("gone" if i in (3, 64 * 5 + 63, 64 * 9) else f"line {i}" for i in range(700))
    docs = spark.createDataFrame([(1, text), (2, "gone"), (3, "stays")], "doc_id bigint, text string")
    found = {r["doc"]: r for r in ld.keep_bitmaps(docs, min_docs=2).collect()}
    assert set(found) == {1, 2} and found[1]["n_dropped"] == 3 and found[2]["n_dropped"] == 1
    assert [(w["word"], ~w["keep"]) for w in found[1]["words"]] == [(0, 8), (5, -(1 << 63)), (9, 1)]
    kept = {r["doc_id"]: r["text"] for r in ld.dedup(docs, min_docs=2).collect()}
    assert kept == {1: "\n".join(x for x in text.split("\n") if x != "gone"), 2: "", 3: "stays"}


def test_empty_table_and_wrong_mode(docs):
    assert ld.dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ld.keep_bitmaps(docs, keep="last")


def test_no_python_workers_and_one_range_shuffle(docs):
    plan = ld._counted(ld.entries(docs, "doc_id", 1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("rangepartitioning") == 1 and plan.count("hashpartitioning") == 1
