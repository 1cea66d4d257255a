"""The numbered queries against SQL, brute force, exact round trips or held-out accuracy."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quadrille.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{oracle.SF_DIR}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    oracle.same(spark, name, QUERIES[name], ORACLE_SQL[name])


def test_language_is_found_in_held_out_documents(spark, documents):
    truth = {d["doc_id"]: d["lang"] for d in documents}
    found = QUERIES["op1_language"](spark, oracle.SF_DIR).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_base_scores_by_brute_force(spark, documents):
    tokens = {d["doc_id"]: [*SPACES.findall(lower(d["text"] or "")), None] for d in documents}
    train = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 10 for t in ts)
    n, v = sum(train.values()), len(train)
    held_base, held_model = 0.0, 0.0
    for r in QUERIES["op2_score"](spark, oracle.SF_DIR).collect():
        own = tokens[r["doc_id"]]
        base = sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(train[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        if r["held_out"]:
            held_base, held_model = held_base + base, held_model + r["score"]
    assert held_model > held_base


def test_shards_are_gapless_and_grow_only_into_the_new_one(spark, documents):
    rows = QUERIES["op6_shard"](spark, oracle.SF_DIR).collect()
    text = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    slots = defaultdict(list)
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_token_files_give_back_what_the_tokenizer_gives(spark, documents):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r["doc_id"]: r for r in QUERIES["op7_token_files"](spark, oracle.SF_DIR).collect()}
    at = 0
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        r = found.pop(d["doc_id"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not found


def test_mix_meets_its_targets(spark, documents):
    rows = QUERIES["op9_mix"](spark, oracle.SF_DIR).collect()
    size = {d["doc_id"]: len(SPACES.findall(d["text"] or "")) for d in documents}
    source = {d["doc_id"]: d["source"] for d in documents}
    own = Counter()
    for i, n in size.items():
        own[source[i]] += n
    # Filling by weight, the excess shared anew until no source is above its limit.
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(own, key=lambda s: (s is None, s or "")))}
    left, open_, target = 1.5 * sum(own.values()), set(own), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * own[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * own[s] for s in full}
        left -= sum(2 * own[s] for s in full)
        open_ -= full
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == own[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    longest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= max(longest, 0.02 * target[s]) for s in own)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op9_mix"](spark, oracle.SF_DIR).collect()))


def test_token_counts_match_brute_force(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    sizes = [len(x.ids) for x in own.encode_batch([d["text"] or "" for d in documents], add_special_tokens=False)]
    found = {r["n_tokens"]: r for r in QUERIES["op4_token_counts"](spark, oracle.SF_DIR).collect()}
    assert {k: r["docs"] for k, r in found.items()} == dict(Counter(sizes))
    for k, r in found.items():
        assert r["tokens"] == k * r["docs"] and r["docs_at_least"] == sum(s >= k for s in sizes)
        assert r["tokens_at_least"] == sum(s for s in sizes if s >= k) and r["kept_tokens"] == sum(min(s, k) for s in sizes)
        assert r["docs_at_most"] == sum(s <= k for s in sizes) and math.isclose(r["share_at_most"], r["docs_at_most"] / len(sizes))
