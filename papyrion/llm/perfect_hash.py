"""A minimal perfect hash over different 64-bit keys, with the keys stored for verification.

Keys hash into a bit array of SPARSE bits a key; a key alone at its bit keeps it, the others go to
the next, smaller array, until none is left. A key's slot is the number of set bits before its own.
A key that was not among those hashed meets some set bit or none; comparing it with the key (or a
second hash) stored at the slot tells it apart.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bits of an array for each key that enters it.
SPARSE = 2


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key."""
    x = keys ^ U((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64)
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def _bit(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return ((mixed(keys, level) >> U(32)) * U(bits)) >> U(32)


class PerfectHash:
    """Slots from 0 to n - 1 for n different keys."""

    def __init__(self, keys: np.ndarray, stored: np.ndarray | None = None) -> None:
        """stored: what to verify by, in the order of the keys; else the keys themselves."""
        self.levels, left, before = [], keys, 0
        while len(left):
            bits = max(64, SPARSE * len(left))
            at = _bit(left, len(self.levels), bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            words = np.packbits(np.pad(alone, (0, -bits % 64)), bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            self.levels.append((bits, words, before + np.cumsum(counts) - counts))
            before += int(counts.sum())
            left = left[~alone[at.astype(np.int64)]]
        self.stored = np.empty(len(keys), U)
        if len(keys):
            self.stored[self._slots(keys)] = keys if stored is None else stored

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        found, open_, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys
        for level, (bits, words, before) in enumerate(self.levels):
            bit = _bit(at, level, bits)
            word, low = words[(bit >> U(6)).astype(np.int64)], bit & U(63)
            set_ = ((word >> low) & U(1)).astype(bool)
            own = (bit[set_] >> U(6)).astype(np.int64)
            found[open_[set_]] = before[own] + np.bitwise_count(word[set_] & ((U(1) << low[set_]) - U(1)))
            open_, at = open_[~set_], at[~set_]
        return found

    def slots(self, keys: np.ndarray, verify: np.ndarray | None = None) -> np.ndarray:
        """The slot of each key, and -1 for those that were not hashed."""
        if not len(self.stored):
            return np.full(len(keys), -1, np.int64)
        found = self._slots(keys)
        return np.where((found >= 0) & (self.stored[found] == (keys if verify is None else verify)), found, -1)
