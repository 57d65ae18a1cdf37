"""A cuckoo filter over 64-bit hashes, filled and probed in numpy batches."""

from __future__ import annotations

import numpy as np

from .common import mix64

SLOTS = 4  # fingerprints of 16 bits in a bucket; 0 marks a free slot
MAX_KICKS = 500


class CuckooFilter:
    """Set membership without false negatives, about 2**-13 false positives, and deletion.

    Each key has two buckets, the second found from the first and the fingerprint alone, so an
    entry can be moved, and removed, without the key. A full filter grows: the owner keeps the
    exact keys and builds it again with twice the buckets."""

    def __init__(self, capacity: int):
        n = max(1, int(capacity / (SLOTS * 0.85)) + 1)
        self.buckets = 1 << (n - 1).bit_length()
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        f = cls.__new__(cls)
        f.table = np.frombuffer(raw, "<u2").reshape(-1, SLOTS).astype(np.uint16)
        f.buckets = len(f.table)
        return f

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, keys: np.ndarray):
        h = mix64(keys.astype(np.uint64))
        tag = ((h >> np.uint64(48)).astype(np.uint16) | np.uint16(1)).astype(np.uint16)
        one = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return tag, one, self._other(one, tag)

    def _other(self, bucket, tag):
        return bucket ^ (mix64(np.asarray(tag, np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        tag, one, two = self._places(keys)
        t = tag[:, None]
        return (self.table[one] == t).any(axis=1) | (self.table[two] == t).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Insert distinct new keys; False when the filter is full (then it must be built anew, larger)."""
        for tag, one, two in zip(*self._places(keys), strict=True):
            if not self._put(one, tag) and not self._put(two, tag) and not self._kick(int(two), tag):
                return False
        return True

    def _put(self, bucket, tag) -> bool:
        row = self.table[bucket]
        for s in range(SLOTS):
            if row[s] == 0:
                row[s] = tag
                return True
        return False

    def _kick(self, bucket: int, tag) -> bool:
        for turn in range(MAX_KICKS):
            s = (turn * 7 + bucket) % SLOTS
            tag, self.table[bucket, s] = self.table[bucket, s].copy(), tag
            bucket = int(self._other(np.int64(bucket), tag))
            if self._put(bucket, tag):
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted before (one entry each)."""
        for tag, one, two in zip(*self._places(keys), strict=True):
            for b in (one, two):
                at = np.flatnonzero(self.table[b] == tag)
                if len(at):
                    self.table[b, at[0]] = 0
                    break


def build(keys: np.ndarray) -> CuckooFilter:
    """The smallest filter (by doubling) that takes all the keys."""
    capacity = max(16, len(keys))
    while True:
        f = CuckooFilter(capacity)
        if f.insert(keys):
            return f
        capacity *= 2
