"""Words of whole texts as arrays: places and hashes of all words of an Arrow batch at once.

A word is a run of bytes other than space and 0x09-0x0D.  Hashes are 64-bit polynomial sums over
random byte values, mixed at the end; ``salt`` gives independent ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
U = np.uint64
HASHED_BYTES = 500_000  # bytes of words hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_values(salt: int, lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(salt))
    return values[_LOWER] if lower else values


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, U(base), U)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


class Words:
    """The words of a run of texts.

    ``starts``/``ends``: byte places in ``raw``; ``first``: index of each text's first word (one more
    entry at the end); ``doc``: text of each word.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw
        solid = ~_GAP[raw]
        before = np.empty(len(raw), bool)
        before[:1], before[1:] = False, solid[:-1]
        behind = np.empty(len(raw), bool)
        behind[-1:], behind[:-1] = False, solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        before[inner] = False
        behind[inner - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~behind) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, salt: int = 0, lower: bool = False) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, U)
        size = self.ends - self.starts
        values, powers = _byte_values(salt, lower), _powers(int(size.max()), 0x9E3779B97F4A7C15 | 1)
        out = np.empty(len(size), U)
        # Runs of words of about HASHED_BYTES, or of one longer word: the arrays over bytes stay small.
        ends = np.cumsum(size)
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HASHED_BYTES, "right")))
            n = size[a:b]
            first = np.cumsum(n) - n
            rank = np.arange(int(n.sum())) - np.repeat(first, n)
            value = values[self.raw[rank + np.repeat(self.starts[a:b], n)]] * powers[rank]
            out[a:b] = np.add.reduceat(value, first)
            a = b
        return mix(out + size.astype(U) * U(0xD6E8FEB86659FD93))

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k words from each word on; meaningless where ``fits(k)`` is false."""
        n = len(words)
        out = np.zeros(n, U)
        for i in range(min(k, n)):
            out *= U(0xC2B2AE3D27D4EB4F)
            out[:n - i] += words[i:]
        return mix(out + U(k))

    def fits(self, k: int) -> np.ndarray:
        """Does a window of k words from here end in the same text?"""
        return np.arange(len(self.starts)) + k <= self.first[1:][self.doc]


def slices(text: pa.Array, most_bytes: int = 4_000_000) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of runs of rows of about ``most_bytes``, or of one longer row."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2] if len(text) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(text):
        b = int(np.searchsorted(offsets, offsets[a] + most_bytes, "right")) - 1
        b = min(max(b, a + 1), len(text))
        yield a, b, Words(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        a = b
