"""The stages against plain Python on the small table."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from quadrille.llm import mixing
from tests import oracle

SPACES, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def windows(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def one_of_each_class(docs):
    """The ids that stay: of linked sets the least doc_id; shared shingles find the pairs."""
    sets = {d["doc_id"]: windows(SPACES.findall(lower(d["text"])), 5) for d in docs}
    root, holders, shared = {i: i for i in sets}, defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for ids in holders.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i for i in sets if find(i) == i}


def clean(docs, items):
    own = [(len(w := ALNUM.findall(lower(t["text"]))), windows(w, 10)) for t in items]
    short = {x for n, s in own if n < 10 for x in s}
    full = {x for n, s in own if n >= 10 for x in s}
    out = set()
    for d in docs:
        words = ALNUM.findall(lower(d["text"]))
        hit = any(tuple(words[i : i + 10]) in full for i in range(len(words) - 9))
        hit = hit or any(tuple(words[i : i + len(s)]) == s for s in short for i in range(len(words) - len(s) + 1))
        if not hit:
            out.add(d["doc_id"])
    return out


def test_each_stage_does_what_plain_python_does(spark):
    docs = spark.read.parquet(f"{oracle.SF_DIR}/documents.parquet")
    items = spark.read.parquet(f"{oracle.SF_DIR}/benchmark.parquet").collect()
    columns, kept = docs.columns, {}
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.spool(stage(spark, docs, oracle.SF_DIR), name)
        assert docs.columns == columns
        now = docs.collect()
        ids = [r["doc_id"] for r in now]
        if name == "language_id":
            assert sorted(ids) == sorted(d["doc_id"] for d in before if any(c.isalpha() for c in d["text"] or ""))
        elif name == "ngram_jaccard":
            assert sorted(ids) == sorted(one_of_each_class(before)) and len(ids) < len(before)
        elif name == "decontamination":
            assert sorted(ids) == sorted(clean(before, items)) and len(ids) < len(before)
        else:
            # Copies as the mix decides, from its multipliers: floor(rate + mark) by source, at most two.
            sized, sources = mixing.plan(spark.createDataFrame(before, docs.schema))
            few = {r["source"]: r for r in sources.collect()}
            import math

            want = Counter()
            for r in sized.collect():
                s = few[r["source"]]
                rate = 2.0 if s["lam"] is None else min(2.0, math.exp(min(s["lam"] * r["size"] / max(s["mean_size"], 1e-9), math.log(2.0))))
                if n := min(2, math.floor(rate + (r["mark"] + s["shift"]) % 1.0)):
                    want[r["key"]] += n
            assert Counter(ids) == want
            # The rates meet the targets: the multipliers solve the dual.
            for s in few.values():
                own = [r["size"] for r in sized.collect() if r["source"] == s["source"]]
                got = sum(n * (2.0 if s["lam"] is None else min(2.0, math.exp(min(s["lam"] * n / max(s["mean_size"], 1e-9), math.log(2.0))))) for n in own)
                assert abs(got - s["target"]) <= 1e-4 * max(1.0, s["target"])
        kept[name] = len(ids)
        before = now
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, oracle.SF_DIR).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in before)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < 40 and r["size"] == len((r["text"] or "").encode()) + 16
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({zlib.crc32(str([r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]).encode()), zlib.crc32(str(sorted(r["doc_id"] for r in rows)).encode())}) == 2
