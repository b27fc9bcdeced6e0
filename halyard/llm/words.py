"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a run of ASCII letters, ASCII digits and characters beyond ASCII of the lower-cased text,
so it can be found on the bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[ord("0") : ord("9") + 1] = True
_WORD_BYTE[ord("a") : ord("z") + 1] = True
_WORD_BYTE[0x80:] = True
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, np.uint64))
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: list[str | None], chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about this many characters each (more only where one text is larger)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chunk:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (with the end last)."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = _WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.arange(len(data), dtype=np.int64) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    value = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * _POWERS[at & 4095], np.uint64(0))
    hashes = mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of k words; with fewer words, one of all words; none without words."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        words, begins = word_hashes(texts[a:b])
        n = len(words)
        rolled = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k):
            if n >= k:
                rolled += words[j : n - k + 1 + j] * _POWERS[j + 7]
        rolled = mix(rolled)
        for i in range(b - a):
            lo, hi = begins[i], begins[i + 1]
            if hi - lo >= k:
                out.append(np.unique(rolled[lo : hi - k + 1]))
            elif hi > lo:
                out.append(mix(np.array([np.sum(words[lo:hi] * _POWERS[7 : 7 + hi - lo]) + np.uint64(hi - lo)], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out
