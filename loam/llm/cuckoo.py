"""A cuckoo filter that supports deletion, and a set of them by shard."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
_M = 0xFFFFFFFFFFFFFFFF


def _spread(tag: int, mask: int) -> int:
    return ((tag * 0x9E3779B97F4A7C15 & _M) >> 32) & mask


class CuckooFilter:
    """32-bit tags in buckets of four.  A key is two 64-bit halves: the first picks bucket, the second the tag."""

    def __init__(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), np.uint32)

    @staticmethod
    def tag(half: int) -> int:
        return half & 0xFFFFFFFF or 1

    def _put(self, bucket: int, tag: int) -> bool:
        row = self.table[bucket]
        for i in range(SLOTS):
            if row[i] == 0:
                row[i] = tag
                return True
        return False

    def insert(self, first: int, second: int) -> bool:
        """False if the filter is too full; it must then be built anew with more buckets."""
        tag, bucket = self.tag(second), first & self.mask
        if self._put(bucket, tag) or self._put(bucket ^ _spread(tag, self.mask), tag):
            return True
        for k in range(KICKS):
            slot = (tag + k) % SLOTS
            tag, self.table[bucket, slot] = int(self.table[bucket, slot]), tag
            bucket ^= _spread(tag, self.mask)
            if self._put(bucket, tag):
                return True
        return False

    def delete(self, first: int, second: int) -> bool:
        """Take out one key that was inserted; False if it is not there."""
        tag, bucket = self.tag(second), first & self.mask
        for b in (bucket, bucket ^ _spread(tag, self.mask)):
            row = self.table[b]
            for i in range(SLOTS):
                if row[i] == tag:
                    row[i] = 0
                    return True
        return False


def build(first: list[int], second: list[int]) -> CuckooFilter:
    """A filter of all keys, at most about 80 % full."""
    buckets = 1 << max(1, (int(len(first) / (0.8 * SLOTS)) + 1).bit_length())
    while True:
        out = CuckooFilter(buckets)
        if all(out.insert(a, b) for a, b in zip(first, second, strict=True)):
            return out
        buckets *= 2


class ShardedFilter:
    """Filters by shard, looked up for many keys at once."""

    def __init__(self, shards: int, tables: dict[int, np.ndarray]) -> None:
        self.shards = shards
        sizes = [len(tables.get(s, np.zeros((1, SLOTS)))) for s in range(shards)]
        self.mask = np.array(sizes, np.uint64) - np.uint64(1)
        self.base = np.cumsum([0, *sizes[:-1]]).astype(np.int64)
        self.table = np.concatenate([tables.get(s, np.zeros((1, SLOTS), np.uint32)) for s in range(shards)]) if shards else np.zeros((1, SLOTS), np.uint32)

    def contains(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """False only for keys that are not in: (n,) booleans of (n,) unsigned 64-bit halves."""
        shard = shard_of(first, self.shards)
        tag = (second & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        tag[tag == 0] = 1
        mask = self.mask[shard]
        one = first & mask
        two = one ^ (((tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) & mask)
        found = np.zeros(len(first), bool)
        for at in (one, two):
            rows = self.table[self.base[shard] + at.astype(np.int64)]
            found |= (rows == tag[:, None]).any(1)
        return found


def shard_of(first: np.ndarray, shards: int) -> np.ndarray:
    """Shard by high bits; buckets are picked by low ones."""
    return ((first >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
