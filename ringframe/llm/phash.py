"""Minimal perfect hashes of byte strings, with the keys stored beside so that every answer is verified.

A key's 128-bit digest gives it a place in a bit array at each of several levels. Keys that have their place of a level to
themselves set the bit there and are done; the others go on to the next level. A key's slot is the number of set bits before
its own, so n keys have the slots 0 to n - 1. All steps are array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPREAD = 1.5
MOST_LEVELS = 64


def digests(keys: list[bytes]) -> np.ndarray:
    """Two unsigned 64-bit words for each key."""
    of = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(map(of, keys)), "<u8").reshape(-1, 2)


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return (words[:, 0] >> np.uint64(16)) % np.uint64(shards)


def place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    x = words[:, 0] + np.uint64(2 * level + 1) * words[:, 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def binary(keys: list[bytes]) -> pa.Array:
    return pa.array(keys, pa.binary())


def build(keys: list[bytes]) -> tuple[bytes, bytes, list[bytes]]:
    """(sizes of the levels, their bits, the keys in the order of their slots) for distinct keys."""
    words = digests(keys)
    left, sizes, bits, slot, done = np.arange(len(keys)), [], [], np.zeros(len(keys), np.int64), 0
    while len(left):
        if len(sizes) == MOST_LEVELS:
            raise ValueError("keys of equal digests")
        size = max(2, int(len(left) * SPREAD))
        at = place(words[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        slot[left[own]] = done + np.cumsum(alone)[at[own]] - 1
        done += int(own.sum())
        sizes.append(size)
        bits.append(np.packbits(alone))
        left = left[~own]
    order = np.empty(len(keys), np.int64)
    order[slot] = np.arange(len(keys))
    return np.array(sizes, "<i8").tobytes(), b"".join(b.tobytes() for b in bits), [keys[i] for i in order]


class PerfectHash:
    """Slots of keys; -1 for what is not among the stored keys."""

    def __init__(self, sizes: bytes, bits: bytes, keys: pa.Array) -> None:
        self.keys, self.levels, at, done = keys, [], 0, 0
        for size in np.frombuffer(sizes, "<i8"):
            width = (int(size) + 7) // 8
            alone = np.unpackbits(np.frombuffer(bits, np.uint8, width, at), count=int(size)).astype(bool)
            rank = (done - 1 + np.cumsum(alone)).astype(np.int32)
            self.levels.append((int(size), np.where(alone, rank, np.int32(-1))))
            at, done = at + width, done + int(alone.sum())

    def slots(self, keys: pa.Array, words: np.ndarray) -> np.ndarray:
        found, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, (size, ranks) in enumerate(self.levels):
            rank = ranks[place(words[left], level, size)]
            hit = rank >= 0
            found[left[hit]] = rank[hit]
            left = left[~hit]
        maybe = np.flatnonzero(found >= 0)
        same = pc.equal(self.keys.take(pa.array(found[maybe])), keys.take(pa.array(maybe))).to_numpy(zero_copy_only=False)
        found[maybe[~same.astype(bool)]] = -1
        return found
