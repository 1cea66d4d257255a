"""Resampling against a plain version: buckets, weights, draws, and the order of the radix sort."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from quadrille.llm import resampling as rs
from quadrille.llm.queries import QUERIES
from tests import oracle

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: str | None, runs: int) -> tuple[list[int], int]:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, runs + 1) for i in range(len(words) - k + 1)], len(words)


def plain_version(docs: list[tuple], target: list[str | None], own: rs.Settings) -> list[tuple]:
    """(doc, n_features, weight, score, rank), rows that share score and doc in any order."""
    made = [(i, t, *features(t, own.runs)) for i, t, *_ in docs]
    s, t = Counter(f % own.buckets for _, _, fs, _ in made for f in fs), Counter(f % own.buckets for x in target for f in features(x, own.runs)[0])
    big_s, big_t, b = sum(s.values()), sum(t.values()), own.buckets
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (big_s + b) / ((s[k] + 1) * (big_t + b))))
    rows = []
    for doc, _, fs, words in made:
        weight = sum(gain(f % b) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{own.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    order = sorted((r for r in rows if r[4] >= own.min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): k for k, r in enumerate(order, 1) if k <= len(order) * own.share // 100}
    return [(*r[:4], place.get(id(r))) for r in rows]


def test_whole_query_matches_the_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{oracle.SF_DIR}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{oracle.SF_DIR}/benchmark.parquet").collect()]
    found = QUERIES["op11_resample"](spark, oracle.SF_DIR)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in found.dtypes} == {"bigint"}
    want = plain_version(docs, target, rs.Settings())
    assert sorted(map(tuple, found.collect())) == sorted(want, key=lambda r: r[0]) and sum(r[4] is not None for r in want) > 20


def mixed(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    pool = ["alpha", "Beta", "gämma", "x" * 200, "é" * 90, "7", "你好", "of", "the", "THE"]
    rows = [(draw.choice([i, -i, 2**62 + i]), " ".join(draw.choices(pool, k=draw.randint(0, 12))), "s", "r") for i in range(150)]
    rows += [(1000, None, "s", "r"), (1001, "", "s", "r"), (1002, " ,;", "s", "r"), (None, "alpha beta the of 7", "s", "r"), (None, "the the the the", "s", "r")]
    return rows + rows[:30]


def test_nulls_repeated_rows_and_wide_ids(spark):
    own = rs.Settings(runs=3, buckets=101, share=60, min_words=3, seed=5)
    rows, target = mixed(3), ["alpha the of", None, "7 7 7 beta"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, seq string, rank string").repartition(4)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    found = sorted((tuple(r) for r in rs.weigh(docs, bench, settings=own).select("doc", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert found == sorted(plain_version(rows, target, own), key=repr)
    drawn = rs.draw(docs, bench, settings=own)
    assert drawn.columns == docs.columns
    text = Counter((r[0], r[1]) for r in rows)
    got = drawn.collect()
    assert sorted(r["rank"] for r in got) == sorted(r[4] for r in found if r[4] is not None)
    assert not Counter((r["doc_id"], r["text"]) for r in got) - text
    assert rs.weigh(docs.limit(0), bench, settings=own).count() == 0
    assert rs.weigh(docs, bench.limit(0), settings=own).count() == len(rows)


def test_order_of_many_ties_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(rs, "PART_ROWS", 37)
    draw = np.random.default_rng(2)
    rows = [(i, int(d), int(m), int(s)) for i, (d, m, s) in enumerate(zip(draw.integers(-5, 5, 1500) * 10**11, draw.integers(-(2**63), 2**63 - 1, 1500), draw.choice([-70_000, 0, 3, 300], 1500), strict=True))]
    from quadrille.llm.common import spool

    found = rs.ranked(spool(spark.createDataFrame(rows, "seq bigint, doc bigint, mark bigint, score bigint"), "rows")).collect()
    mark = lambda m: m % 2**64
    want = sorted(rows, key=lambda r: (-r[3], r[1], mark(r[2])))
    assert [r["seq"] for r in sorted(found, key=lambda r: r["rank"])] == [r[0] for r in want]


def test_long_texts_in_pieces_have_the_same_runs():
    own = rs.Settings(runs=3, buckets=10_000)
    text = ("ab cd, " * 40 + "w" * 300 + " é你 ; " * 30 + "tail").encode()
    data = np.frombuffer(text, np.uint8)
    want = Counter(f % own.buckets for f in features(text.decode(), 3)[0])
    for most in (5, 64, 1000, 1 << 20):
        words, got = 0, Counter()
        for n, _, buckets in rs.run_buckets(data, np.array([0, len(data)]), own, most):
            words += int(n[0])
            got.update(buckets.tolist())
        assert got == want and words == features(text.decode(), 3)[1]
