"""Minimal perfect hashing of distinct numbers by cascading bit arrays."""

from __future__ import annotations

import numpy as np

from claimweir.llm.shingles import mixed

#: Bits of a level for each number that comes to it.
ROOM = 2
_STEP = 0x9E3779B97F4A7C15


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(keys + np.uint64((level + 1) * _STEP % (1 << 64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Sends n distinct numbers to 0, ..., n - 1, one each, with about four bits for each.

    On each level every number has one bit. Numbers that are alone on theirs set it, the others go to the next level. The slot of a
    number is how many bits are set before its own. `members` holds the numbers in the order of their slots, which verifies a lookup.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, members: np.ndarray):
        self.sizes, self.words, self.members = sizes, words, members
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        keys = keys.astype(np.uint64)
        left, sizes, bits = keys, [], []
        while len(left):
            size = -(-ROOM * len(left) // 64) * 64
            at = _place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        packed = np.packbits(np.concatenate(bits) if bits else np.empty(0, bool), bitorder="little").view("<u8")
        out = cls(np.array(sizes, np.int64), packed, np.empty(0, np.uint64))
        members = np.empty(len(keys), np.uint64)
        members[out._slots(keys)] = keys
        out.members = members
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = base + _place(keys[open_], level, size)
            word = self.words[at >> 6]
            bit = (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slots[open_[here]] = (self.ranks[at >> 6] + before)[here]
            open_, base = open_[~here], base + size
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each number, -1 for those that are no members."""
        keys = keys.astype(np.uint64)
        slots = self._slots(keys)
        found = slots >= 0
        found[found] = self.members[slots[found]] == keys[found]
        return np.where(found, slots, -1)

    def to_bytes(self) -> tuple[bytes, bytes, bytes]:
        return self.sizes.astype("<i8").tobytes(), self.words.astype("<u8").tobytes(), self.members.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, sizes: bytes, words: bytes, members: bytes) -> PerfectHash:
        return cls(*(np.frombuffer(b, kind) for b, kind in ((sizes, "<i8"), (words, "<u8"), (members, "<u8"))))
