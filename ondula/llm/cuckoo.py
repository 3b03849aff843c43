"""Cuckoo filters (Fan et al. 2014) over 64-bit keys, as numpy arrays.

A filter has a power of two of buckets with four 16-bit fingerprints each; a
key may stand in two buckets, either found from the other and the fingerprint.
Keys may be inserted and deleted; one that finds no place goes to the stash.
``contains`` is never false for a key that is in.
"""

from __future__ import annotations

import numpy as np

from ondula.llm.words import mixed

SLOTS = 4
LOAD = 0.8  # share of the slots that a new filter fills
MAX_KICKS = 200


def _print_of(keys: np.ndarray) -> np.ndarray:
    """Fingerprints; none is 0, which marks a free slot."""
    return ((keys >> np.uint64(48)) % np.uint64(0xFFFF)).astype(np.uint16) + np.uint16(1)


class Cuckoo:
    def __init__(self, table: np.ndarray, stash: np.ndarray):
        self.table, self.stash = table, stash

    @staticmethod
    def of_size(n: int) -> Cuckoo:
        """An empty filter with room for ``n`` keys."""
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, n) / (SLOTS * LOAD)))))
        return Cuckoo(np.zeros((buckets, SLOTS), np.uint16), np.zeros(0, np.uint64))

    @staticmethod
    def of_bytes(table: bytes, stash: bytes) -> Cuckoo:
        return Cuckoo(
            np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy(),
            np.frombuffer(stash, np.uint64).copy(),
        )

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.table.tobytes(), self.stash.tobytes()

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        turn = mixed(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)
        return place ^ turn.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one = _print_of(keys), self._first(keys)
        found = (self.table[one] == prints[:, None]).any(axis=1)
        found |= (self.table[self._other(one, prints)] == prints[:, None]).any(axis=1)
        return found | np.isin(keys, self.stash)

    def _fill(self, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; which did fit."""
        order = np.argsort(place, kind="stable")
        at = place[order]
        start = np.searchsorted(at, at)
        rank = np.arange(len(at)) - start
        free = self.table[at] == 0
        nth = np.cumsum(free, axis=1)
        fits = rank < nth[:, -1]
        slot = np.argmax(nth == (rank + 1)[:, None], axis=1)
        self.table[at[fits], slot[fits]] = prints[order][fits]
        done = np.zeros(len(place), bool)
        done[order] = fits
        return done

    def insert(self, keys: np.ndarray) -> None:
        """Add distinct keys that are not in yet."""
        prints, place = _print_of(keys), self._first(keys)
        done = self._fill(place, prints)
        left = np.flatnonzero(~done)
        there = self._other(place[left], prints[left])
        done = self._fill(there, prints[left])
        left, there = left[~done], there[~done]
        for key, p, at in zip(keys[left], prints[left], there.tolist()):
            self._kick(key, p, at)

    def _kick(self, key: np.uint64, p: np.uint16, at: int) -> None:
        """Displace fingerprints along a walk until one finds a free slot; a
        walk that ends nowhere is undone, and its key stashed."""
        walk = []
        for n in range(MAX_KICKS):
            slot = (int(key) + n) % SLOTS
            walk.append((at, slot, self.table[at, slot]))
            self.table[at, slot], p = p, self.table[at, slot]
            at = int(self._other(np.array([at]), np.array([p]))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return
        for where, slot, old in reversed(walk):
            self.table[where, slot] = old
        self.stash = np.append(self.stash, key)

    def delete(self, keys: np.ndarray) -> None:
        """Take out distinct keys that are in."""
        stashed = np.isin(keys, self.stash)
        self.stash = self.stash[~np.isin(self.stash, keys)]
        keys = keys[~stashed]
        prints, one = _print_of(keys), self._first(keys)
        two = self._other(one, prints)
        for p, a, b in zip(prints.tolist(), one.tolist(), two.tolist()):
            for at in (a, b):
                hit = np.flatnonzero(self.table[at] == p)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break
