"""Hashes of words and word shingles, computed per text with numpy.

Words are runs of bytes other than ASCII white space; A-Z count as a-z. A text
becomes one 64-bit hash per word, and from those one per shingle, without a
Python object per word. Long texts go through in blocks cut at white space.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 18
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_WORD = np.ones(256, np.int8)
_IS_WORD[list(WHITE)] = 0
_BYTE[list(WHITE)] = 0
_STEP = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, up to a length."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, BLOCK + 4096)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.full(size, base, np.uint64) for base in (_BASE, inverse))
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def _block_hashes(data: np.ndarray) -> np.ndarray:
    inside = _IS_WORD[data]
    edges = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = POWERS.upto(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up)])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word of ``text``, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) <= BLOCK:
        return _block_hashes(data)
    found, start = [], 0
    while start < len(data):
        end = start + BLOCK
        while end < len(data):
            white = np.flatnonzero(_IS_WORD[data[end : end + BLOCK]] == 0)
            if len(white):
                end += int(white[0])
                break
            end += BLOCK
        found.append(_block_hashes(data[start:end]))
        start = end
    return np.concatenate(found)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash per run of ``k`` words; all words as one run when there are fewer."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    total = np.zeros(n - width + 1, np.uint64)
    factor = 1
    for j in range(width):
        total += words[j : n - width + 1 + j] * np.uint64(factor)
        factor = factor * _STEP % (1 << 64)
    return mixed(total)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(word_hashes(text or ""), k))
