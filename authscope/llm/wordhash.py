"""Words of many texts as arrays: where they start and end, and a 64-bit hash of each and of each run of them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

RADIX = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_values = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, RADIX, np.uint64)
    down = np.full(size, pow(RADIX, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Words:
    """Words (maximal runs of anything but ASCII white space) of ``texts`` in order; A-Z count as a-z in the hashes.

    starts, ends: bytes in ``raw``; hashes; first: of each text, the number of its first word, and one past the last.
    """

    def __init__(self, texts: list[bytes], fold: bool = True):
        self.raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        n = len(self.raw)
        inside = ~_white.take(self.raw)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if n else np.empty(0, np.int64)
        if n and inside[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        up, down = powers(1 << max(22, (n + 1).bit_length()))
        values = _values.take(_lower.take(self.raw) if fold else self.raw)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=sums[1:])
        self.hashes = mixed((sums.take(self.ends) - sums.take(self.starts)) * down.take(self.starts) + (self.ends - self.starts).astype(np.uint64))
        self.text_starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        self.first = np.searchsorted(self.starts, self.text_starts)

    def runs(self, k: int) -> np.ndarray:
        """Hash of each run of ``k`` words, by its first word; runs may reach into the next text."""
        n = max(0, len(self.hashes) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(RADIX) + self.hashes[j : j + n]
        return mixed(out)
