"""Words of a block of texts as arrays: positions and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# one random odd factor, and a random value for each byte (fixed by the seed)
_RANDOM = np.random.Generator(np.random.PCG64(20240501))
_FACTOR = int(_RANDOM.integers(1 << 62, 1 << 63)) * 2 + 1
_VALUE = _RANDOM.integers(1, 1 << 63, size=256, dtype=np.uint64)
# Words that long are hashed apart: whatever the factor, a polynomial modulo a
# power of two can't tell some words of 1024 bytes (Thue-Morse) from each other.
LONG_BYTES = 512


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _FACTOR, dtype=np.uint64)
    down = np.full(n, pow(_FACTOR, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@dataclass
class Words:
    """``starts`` and ``stops`` are byte positions in ``data``; the words of
    text i are those from ``edges[i]`` to ``edges[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    edges: np.ndarray

    def hashes(self, lower: bool = False, exact: bool = True) -> np.ndarray:
        """A hash of every word's bytes: a polynomial from prefix sums, or
        BLAKE2 where words are long (not so if ``exact`` is false)."""
        n = len(self.data)
        # few sizes, so that slices of one kind share the powers
        up, down = _powers(((n >> 20) + 1) << 20 if n >= 1 << 19 else 1 << 19)
        data = _LOWER[self.data] if lower else self.data
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data] * up[:n], out=prefix[1:])
        h = (prefix[self.stops] - prefix[self.starts]) * down[self.starts]
        h = mixed(h + (self.stops - self.starts).astype(np.uint64))
        for i in np.flatnonzero(self.stops - self.starts >= LONG_BYTES).tolist() if exact else ():
            word = data[self.starts[i] : self.stops[i]].tobytes()
            h[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and their n + 1 offsets; a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_in(texts: pa.Array) -> Words:
    """The words [^\\x20\\x09-\\x0D]+ of every text."""
    data, offsets = text_bytes(texts)
    n = len(data)
    ink = ~_SPACE[data]
    fresh = np.zeros(n + 1, dtype=bool)  # places where a text begins, and the end
    fresh[offsets] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | fresh[1:n]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:] | fresh[1:n]
    starts = np.flatnonzero(start)
    return Words(
        data, offsets, starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)
    )


def runs_hash(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k consecutive word hashes, across text borders too."""
    factor = np.uint64((0x9E3779B97F4A7C15 + 2 * seed * 0x632BE59BD9B4E019) % (1 << 64) | 1)
    n = max(0, len(h) - k + 1)
    g = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        g = g * factor + h[j : j + n]
    return mixed(g + np.uint64(seed))
