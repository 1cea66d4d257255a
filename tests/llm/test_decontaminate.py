"""Windows that many items or words share, equal hashes, and spans, against a plain version."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from quadrille.llm import decontaminate, textkit

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> bytes:
    return re.sub(rb"[A-Z]+", lambda m: m[0].lower(), text.encode())


def plain_version(texts, items, n):
    windows = {}
    for name, text in items:
        words = WORD.findall(lower(text))
        for i in range(max(1, len(words) - n + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(name)
    out = []
    for text in texts:
        words, hit, names = WORD.findall(lower(text)), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(words) - k + 1):
                if (found := windows.get(tuple(words[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    names |= found
        out.append((len(words), hit, names))
    return out


def scanned(texts, items, n):
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    per_text, names, marks, _ = decontaminate.WindowSet(items, n).scan(data, bounds)
    return [(int(c), set(np.flatnonzero(marks[i]).tolist()) if i in marks else set(), names.get(i, set())) for i, c in enumerate(per_text)]


@pytest.mark.parametrize("hashed", [True, False])
def test_scan_matches_plain_version(monkeypatch, hashed):
    if not hashed:  # all words, and so all windows of a length, share a hash
        monkeypatch.setattr(textkit, "mix", lambda h: np.zeros_like(h))
    monkeypatch.setattr(decontaminate, "HITS", 7)
    draw = random.Random(2)
    pool = ["a", "A", "bb", "ccc", "é", "你好", "d" * 300, "7"]
    text = lambda most: " ".join(draw.choices(pool, k=draw.randint(0, most)))
    items = [(f"i{k}", text(5)) for k in range(12 if not hashed else 60)] + [("e", ""), ("f", ",;"), ("g", "bb bb bb bb bb"), ("h", "bb bb bb bb bb")]
    texts = [text(12) for _ in range(30)] + ["", "...", "bb " * 40, "a,a;a"]
    assert scanned(texts, items, 3) == plain_version(texts, items, 3)


def test_many_items_with_one_window_cost_no_more_than_one():
    texts = ["the " * 2400] * 40
    took = []
    for n in (1, 1000):
        begin = time.perf_counter()
        found = scanned(texts, [(f"i{k}", "The") for k in range(n)], 10)
        took.append(time.perf_counter() - begin)
        assert all(c == 2400 and len(hit) == 2400 and len(names) == n for c, hit, names in found)
    assert took[1] < 5 * took[0] + 1
