"""Minimal perfect hashing of sets of 64-bit keys.

A level gives every key that is left a place by its own hash; keys alone on
their place are settled there (a bit is set), the others go on to the next
level.  A key's number is the count of set bits before its own, so n keys have
the numbers 0 to n - 1.  Keys outside the set may get a number as well or none:
whoever looks up verifies the key that the number stands for.
"""

from __future__ import annotations

import numpy as np

from airlag.llm.words import mix

#: Places per key and level.
ROOM = 2


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2 ** 64 - 1))) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Levels (bit sets) and the number of every key; keys are distinct."""
    levels, numbers, base = [], np.empty(len(keys), np.int64), 0
    left = np.arange(len(keys))
    while len(left):
        size = -(-ROOM * len(left) // 64) * 64
        at = _place(keys[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        numbers[left[mine]] = base + np.cumsum(alone)[at[mine]] - 1
        base += int(alone.sum())
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        left = left[~mine]
    return levels, numbers


class PerfectHash:
    def __init__(self, levels: list[bytes]):
        self.words = [np.frombuffer(x, np.uint64) for x in levels]
        self.before, base = [], 0
        for words in self.words:
            sums = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.before.append(base + np.concatenate(([0], sums[:-1])))
            base += int(sums[-1])
        self.size = base

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of every key; -1 where no level has it."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, words in enumerate(self.words):
            at = _place(keys[left], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) != 0
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[here]] = (self.before[level][at >> 6] + np.bitwise_count(below))[here]
            left = left[~here]
        return out
