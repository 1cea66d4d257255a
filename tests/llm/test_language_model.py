"""The mixture's scores by brute force, and the packing of keys and counts."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quadrille.llm import language_model as M


def test_keys_and_counts_survive_packing():
    draw = np.random.default_rng(3)
    for keys in ([], [5], [0, 2**64 - 1], np.unique(draw.integers(0, 2**63, 999, dtype=np.uint64))):
        keys = np.array(keys, np.uint64)
        assert M.unpack_sorted(M.pack_sorted(keys)).tolist() == keys.tolist()
    for n in ([], [0, 0], [1, 254, 255, 256, 0, 5_000_000_000, 255]):
        assert M.unpack_counts(M.pack_counts(np.array(n, np.int64)), len(n)).tolist() == n


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_scores_by_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(M, "BLOCK_BYTES", block_bytes)
    draw = random.Random(5)
    words = [f"w{min(int(draw.paretovariate(0.7)), 60)}" for _ in range(400)]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 40))) for _ in range(160)] + [None, "", "only here", "W1 w2\tW1\nw2", "w1 " * 600]
    fold = [zlib.crc32(str(i).encode()) % 10 for i in range(len(texts))]
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    pairs = [list(zip([None, *ts[:-1]], ts, strict=True)) for ts in tokens]
    unigram = Counter(t for ts, f in zip(tokens, fold, strict=True) if f for t in ts)
    bigram = Counter(p for ps, f in zip(pairs, fold, strict=True) if f for p in ps)
    n, v = sum(unigram.values()), len(unigram)
    # The weights, by EM on held-out tokens against the counts without them; the cells round probabilities.
    kept_1 = Counter(t for ts, f in zip(tokens, fold, strict=True) if f > 1 for t in ts)
    kept_2 = Counter(p for ps, f in zip(pairs, fold, strict=True) if f > 1 for p in ps)
    n_kept, v_kept = sum(kept_1.values()), len(kept_1)
    bucket = lambda c: min(int(math.log2(c + 1)), M.MOST_BUCKET)
    at = lambda p: 0.0 if p == 0 else 10 ** (round((math.log10(p) + M.DECADES) * M.CELLS) / M.CELLS - M.DECADES)
    held = [(bucket(kept_1[a]), at(kept_2[a, b] / max(kept_1[a], 1)), at(kept_1[b] / n_kept), 1 / (v_kept + 1)) for ps, f in zip(pairs, fold, strict=True) if f == 1 for a, b in ps]
    w = [[1 / 3] * 3 for _ in range(M.MOST_BUCKET + 1)]
    for _ in range(M.EM_ROUNDS):
        sums = [[0.0, 0.5, 0.5] for _ in w]
        for k, *p in held:
            shares = [x * y for x, y in zip(w[k], p, strict=True)]
            for j in range(3):
                sums[k][j] += shares[j] / sum(shares)
        w = [[x / sum(s) for x in s] for s in sums]
    w[0] = [0, w[0][1] / (w[0][1] + w[0][2]), w[0][2] / (w[0][1] + w[0][2])]

    fitted = {}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: r for r in M.score(docs, fitted=fitted).collect()}
    assert len(found) == len(texts) and (fitted["tokens"], fitted["distinct"]) == (n, v)
    assert np.allclose(fitted["weights"], w, rtol=1e-6)
    for i, (ts, ps) in enumerate(zip(tokens, pairs, strict=True)):
        r = found[i]
        assert (r["part"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold[i], len(ts), sum(unigram[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((unigram[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
        own = 0.0
        for a, b in ps:
            c = w[bucket(unigram[a])]
            own += math.log10(c[0] * bigram[a, b] / max(unigram[a], 1) + c[1] * unigram[b] / n + c[2] / (v + 1))
        assert r["score"] == pytest.approx(own, rel=1e-6)
