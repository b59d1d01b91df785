"""A minimal perfect hash over 64-bit keys, with fingerprints and counts.

Each level has a bit per slot; a key that has a slot to itself sets the
slot's bit, the others go on to the next level under another seed. A key's
index is the number of set bits before its own, so the indices are exactly
0 to n-1 and two arrays of n entries hold what belongs to the keys.
"""

from __future__ import annotations

import io

import numpy as np

SLOTS_PER_KEY = 1.5
_WORD = np.uint64(64)


def mix64(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit words per seed (multiply and shift rounds)."""
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys, 0x5F) >> np.uint64(32)).astype(np.uint32)


class CountIndex:
    """Counts of distinct keys, reached through the perfect hash."""

    def __init__(self, levels: list[np.ndarray], slots: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.levels, self.slots, self.prints, self.counts = levels, slots, prints, counts
        ones = [np.bitwise_count(words).astype(np.int64) for words in levels]
        self.before, start = [], 0
        for each in ones:
            self.before.append(start + np.cumsum(each) - each)
            start += int(each.sum())

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> CountIndex:
        """``keys``: distinct uint64; ``counts``: any integer array."""
        levels, slots, left = [], [], keys
        while len(left):
            size = max(64, int(len(left) * SLOTS_PER_KEY))
            at = (mix64(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, np.uint8)
            bits[:size] = alone
            levels.append(np.packbits(bits, bitorder="little").view(np.uint64))
            slots.append(size)
            left = left[~alone[at]]
        index = cls(levels, np.array(slots, np.int64), np.empty(0, np.uint32), np.empty(0, counts.dtype))
        places = index._places(keys)
        index.prints, index.counts = np.empty(len(keys), np.uint32), np.empty(len(keys), counts.dtype)
        index.prints[places] = fingerprints(keys)
        index.counts[places] = counts
        return index

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for keys that no level holds."""
        places = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for n, (words, size, before) in enumerate(zip(self.levels, self.slots, self.before, strict=True)):
            at = mix64(keys[open_], n + 1) % np.uint64(size)
            word, bit = (at // _WORD).astype(np.int64), at % _WORD
            found = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            places[open_[found]] = (before[word] + np.bitwise_count(below))[found]
            open_ = open_[~found]
            if not len(open_):
                break
        return places

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0 where the fingerprint says it is not in."""
        places = self._places(keys)
        known = places >= 0
        found = np.zeros(len(keys), self.counts.dtype)
        known[known] = self.prints[places[known]] == fingerprints(keys[known])
        found[known] = self.counts[places[known]]
        return found

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        parts = {f"level{n}": words for n, words in enumerate(self.levels)}
        np.savez(out, slots=self.slots, prints=self.prints, counts=self.counts, **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountIndex:
        with np.load(io.BytesIO(data), allow_pickle=False) as parts:
            levels = [parts[f"level{n}"] for n in range(len(parts["slots"]))]
            return cls(levels, parts["slots"], parts["prints"], parts["counts"])
