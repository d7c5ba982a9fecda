"""A cuckoo filter over 128-bit keys, with numpy arrays that probe whole batches."""

from __future__ import annotations

import numpy as np

SLOTS, MAX_KICKS, LOAD = 4, 500, 0.8


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, two buckets to a key. No false negatives; about 1 in 8,000 false positives."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = len(table) - 1

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(n, 1) / (SLOTS * LOAD) + 1))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        """A filter of these distinct keys; it doubles until all fit."""
        out = cls.sized(len(k1))
        while not out.insert(k1, k2):
            out = cls(np.zeros((2 * len(out.table), SLOTS), np.uint16))
        return out

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u1, u2 = k1.view(np.uint64), k2.view(np.uint64)
        mark = (u2 & np.uint64(0xFFFF)).astype(np.int64)
        mark[mark == 0] = 1
        first = ((u1 >> np.uint64(20)) & np.uint64(self.mask)).astype(np.int64)
        return mark, first, first ^ self._step(mark)

    def _step(self, mark):
        return (mark * 0x5BD1E995) & self.mask

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(k1, k2)
        mark = mark.astype(np.uint16)[:, None]
        return ((self.table[first] == mark) | (self.table[second] == mark)).any(axis=1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if a key found no place; the filter must then be built anew, twice as large."""
        rng = np.random.default_rng(0)
        for mark, first, second in zip(*(x.tolist() for x in self._places(k1, k2)), strict=True):
            for at in (first, second):
                if len(free := np.flatnonzero(self.table[at] == 0)):
                    self.table[at, free[0]] = mark
                    break
            else:
                at = second
                for _ in range(MAX_KICKS):
                    slot = int(rng.integers(SLOTS))
                    mark, self.table[at, slot] = int(self.table[at, slot]), mark
                    at ^= self._step(mark)
                    if len(free := np.flatnonzero(self.table[at] == 0)):
                        self.table[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes out keys that are in the filter; others must not be given."""
        for mark, first, second in zip(*(x.tolist() for x in self._places(k1, k2)), strict=True):
            for at in (first, second):
                if len(held := np.flatnonzero(self.table[at] == mark)):
                    self.table[at, held[0]] = 0
                    break
