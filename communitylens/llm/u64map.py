"""A read-only map from 64-bit keys to positions, probed by numpy."""

from __future__ import annotations

import numpy as np


class U64Map:
    """Open addressing over distinct keys; two to four slots for each key.
    The key 2**64 - 1 is not allowed."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(len(keys) * 2).bit_length())
        self.slots = np.full(1 << self.bits, np.uint64(2**64 - 1), dtype=np.uint64)
        self.where = np.full(1 << self.bits, -1, dtype=np.int32 if len(keys) < 2**31 else np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.where[at[todo]] < 0]
            slot, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.slots[slot], self.where[slot] = keys[placed], placed
            rest = np.ones(len(keys), dtype=bool)
            rest[placed] = False
            todo = todo[rest[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key in the keys that the map was made of, or -1."""
        at = self._slot(keys)
        out = np.where(self.slots[at] == keys, self.where[at], -1)
        miss = np.flatnonzero((out < 0) & (self.where[at] >= 0))
        while len(miss):
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            here = at[miss]
            hit = self.slots[here] == keys[miss]
            out[miss[hit]] = self.where[here[hit]]
            miss = miss[~hit & (self.where[here] >= 0)]
        return out
