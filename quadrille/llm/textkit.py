"""Words and word windows of whole texts, as 64-bit hashes computed over Arrow buffers with numpy.

All separators in use are ASCII, so words can be cut on UTF-8 bytes; bytes from 0x80 on always
belong to words. A text is never cut: a chunk holds whole texts and grows for a long one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes between words: white space (0x20, 0x09-0x0D), or all ASCII but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:0x80] = [not chr(b).isalnum() for b in range(0x80)]

#: Bytes from which on a word is hashed by BLAKE2b.
LONG_WORD = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_RNG = np.random.default_rng(20240229)
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW_ODDS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_chunks(column, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into runs of whole texts: (first row, last row + 1, bytes, bounds).

    Text i of a run is ``bytes[bounds[i]:bounds[i + 1]]``. Null texts are empty.
    """
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = "large" in str(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def segments(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray, max_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A run of texts as (offset, bytes, bounds); a single text beyond ``max_bytes`` is cut after a separator.

    Where the last 64 KiB of a segment hold no separator, it ends at a character instead.
    """
    if len(bounds) > 2 or len(data) <= max_bytes:
        yield 0, data, bounds
        return
    at = 0
    while at < len(data):
        stop = min(at + max_bytes, len(data))
        if stop < len(data):
            gaps = np.flatnonzero(separators[data[max(at, stop - (1 << 16)) : stop]])
            if len(gaps):
                stop = max(at, stop - (1 << 16)) + int(gaps[-1]) + 1
            else:
                while stop > at + 1 and data[stop] & 0xC0 == 0x80:
                    stop -= 1
        yield at, data[at:stop], np.array([0, stop - at])
        at = stop


def spans(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs of bytes that aren't separators; none goes over a text's bounds."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


@dataclass
class Words:
    """Words of a run of texts, in order: hash, byte span, and the first word of each text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # one more than texts: words of text i are first[i]:first[i + 1]


def words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> Words:
    """Lower-case A-Z and hash all maximal runs of bytes that aren't separators.

    Two different words share a hash with odds of about 2^-64. Short ones are hashed by a polynomial;
    from ``LONG_WORD`` bytes on, where such polynomials have systematic collisions, by BLAKE2b.
    """
    start, end = spans(data, bounds, separators)
    if not len(start):
        return Words(np.zeros(0, np.uint64), start, end, np.zeros(len(bounds), np.int64))
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * power[: len(data)], out=total[1:])
    found = mix((total[end] - total[start]) * inverse[start])
    for i in np.flatnonzero(end - start >= LONG_WORD).tolist():
        found[i] = int.from_bytes(hashlib.blake2b(_LOWER[data[start[i] : end[i]]].tobytes(), digest_size=8).digest(), "little")
    return Words(found, start, end, np.searchsorted(start, bounds))


def windows(found: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each text: (hash, first word, first window of each text).

    A text of fewer words, but not none, has its whole sequence as one window.
    """
    h, first = found.hash, found.first
    counts = np.diff(first)
    full = np.zeros(len(h), np.uint64)
    n = len(h) - k + 1
    if n > 0:
        for j in range(k):
            full[:n] += h[j : j + n] * _WINDOW_ODDS[j]
    per_text = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(per_text)])
    at = np.arange(out_first[-1]) - np.repeat(out_first[:-1], per_text) + np.repeat(first[:-1], per_text)
    out = full[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        value = counts[short].astype(np.uint64) * np.uint64(_BASE)
        for j in range(k - 1):
            has = counts[short] > j
            value[has] += h[first[short[has]] + j] * _WINDOW_ODDS[j]
        out[out_first[short]] = value
    return mix(out), at, out_first
