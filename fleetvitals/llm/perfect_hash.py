"""Minimal perfect hashing of distinct 64-bit keys: n keys to 0 .. n - 1, in about three bits a key.

Keys are thrown into a bit array of twice their number. Keys alone in their
slot set its bit; the others go on to the next, smaller array. A key's index is
the number of set bits before its own.
"""

from __future__ import annotations

import numpy as np

from fleetvitals.llm.words import U64, mix

SPACE = 2.0  # slots for a key at each level
_STEP = 0x9E3779B97F4A7C15


class PerfectHash:
    def __init__(self, keys: np.ndarray):
        """keys: distinct integers of 64 bits."""
        left = np.asarray(keys).astype(U64)
        self.size = len(left)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # slots, words of bits, set bits before each word
        before = 0
        while len(left):
            slots = -int(-len(left) * SPACE // 64) * 64
            at = self._slots(left, len(self.levels), slots)
            alone = np.bincount(at, minlength=slots)[at] == 1
            bits = np.zeros(slots, dtype=np.uint8)
            bits[at[alone]] = 1
            words = np.packbits(bits, bitorder="little").view(U64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((slots, words, before + np.cumsum(ones) - ones))
            before += int(ones.sum())
            left = left[~alone]
            if len(self.levels) > 200:
                raise ValueError("the keys are not distinct")

    @staticmethod
    def _slots(keys: np.ndarray, level: int, slots: int) -> np.ndarray:
        high = mix(keys + U64((level + 1) * _STEP % (1 << 64))) >> U64(32)
        return ((high * U64(slots)) >> U64(32)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index. A key that was not among those given gets any index, or -1: compare it with the key kept there."""
        keys = np.asarray(keys).astype(U64)
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for level, (slots, words, before) in enumerate(self.levels):
            if not len(rest):
                break
            at = self._slots(keys[rest], level, slots)
            word, bit = words[at >> 6], (at & 63).astype(U64)
            found = ((word >> bit) & U64(1)).astype(bool)
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
            out[rest[found]] = before[at[found] >> 6] + below[found]
            rest = rest[~found]
        return out
