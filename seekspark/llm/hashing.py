"""Vectorised hashing of bytes, words and word sequences in numpy (64-bit, wrapping)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and digits, and all bytes of other characters.
WORDY = np.zeros(256, bool)
WORDY[48:58] = WORDY[65:91] = WORDY[97:123] = WORDY[128:] = True

_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(64, 2 * n), BASE, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
    return _powers[:n]


def joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All texts (None: empty) as one array of bytes, each followed by a newline, and where each begins, with the end last."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([0] + [len(r) + 1 for r in raw])
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), ends


class Words:
    """The words of a byte array: starts, ends, and hashes of whole words or of their first k bytes."""

    def __init__(self, buf: np.ndarray, inside: np.ndarray):
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.sizes = self.ends - self.starts
        if len(self.starts):
            low = LOWER[buf]
            at = np.flatnonzero(inside)
            where = np.arange(len(at)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[low[at]] * powers(int(self.sizes.max()))[where], dtype=np.uint64)])
            self.first = np.cumsum(self.sizes) - self.sizes

    def hashes(self, k: int | None = None) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        n = self.sizes if k is None else np.minimum(self.sizes, k)
        return mix(self.sums[self.first + n] - self.sums[self.first] + n.astype(np.uint64))


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole, if it has fewer words; none of nothing."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * BASE + words[i : len(words) - k + 1 + i] + np.uint64(k))
    return out


def shingle_sets(texts: list, n: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, words being runs of other than [\\x20\\x09-\\x0D]."""
    buf, ends = joined(texts)
    w = Words(buf, ~SPACE[buf])
    h = w.hashes()
    cut = np.searchsorted(w.starts, ends)
    for a, b in zip(cut[:-1], cut[1:]):
        yield np.unique(sequences(h[a:b], n))
