"""Minimal perfect hash index over one bucket of keys, as one file of bytes.

Keys are pairs of 64-bit hashes.  Level after level, keys are hashed into a bit array of
``GAMMA`` bits a key; a key that has a bit to itself is placed, the others go on to the next
level.  The rank of a key's bit over all levels is its slot, 0 to n - 1.  The entry at that slot
holds a fingerprint from the second hash, so a key that was never indexed is refused (but for one
in 2**32).  A lookup reads one bit array word a level (1.4 levels a key on average), one rank and
one entry, however many keys there are.
"""

from __future__ import annotations

import struct

import numpy as np

from tabspark.llm.words import U64, mix

MAGIC = b"KEYIDX01"
GAMMA = 2.0
ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])


def level_hash(h: np.ndarray, g: np.ndarray, level: int) -> np.ndarray:
    return mix(h + g * U64(2 * level + 1) + U64(level))


def build(h: np.ndarray, g: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    """Index of distinct (h, g) pairs."""
    n = len(h)
    sizes, arrays, levels_of = [], [], np.zeros(n, dtype=np.int64)
    bit_of = np.zeros(n, dtype=np.int64)
    left, base = np.arange(n), 0
    while len(left):
        size = -(-int(GAMMA * len(left) + 64) // 64) * 64
        at = (level_hash(h[left], g[left], len(sizes)) % U64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, dtype=np.uint8)
        bits[at[alone]] = 1
        arrays.append(np.packbits(bits, bitorder="little").view("<u8"))
        bit_of[left[alone]] = base + at[alone]
        sizes.append(size)
        base += size
        left = left[~alone]
        if len(sizes) > 200:
            raise ValueError("keys of the index are not distinct")
    words = np.concatenate(arrays) if arrays else np.zeros(0, "<u8")
    ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))[:-1].astype("<u4")
    entries = np.zeros(n, dtype=ENTRY)
    slots = _slots(words, ranks, bit_of)
    for name, x in (("fingerprint", g & U64(0xFFFFFFFF)), ("shard", shard), ("offset", offset), ("length", length)):
        entries[name][slots] = x
    head = MAGIC + struct.pack("<QI", n, len(sizes)) + np.asarray(sizes, "<u8").tobytes()
    return head + words.tobytes() + ranks.tobytes() + entries.tobytes()


def _slots(words: np.ndarray, ranks: np.ndarray, bit: np.ndarray) -> np.ndarray:
    word = bit >> 6
    below = words[word] & ((U64(1) << (bit & 63).astype(U64)) - U64(1))
    return ranks[word].astype(np.int64) + np.bitwise_count(below)


class Bucket:
    """An index file read into memory (or mapped)."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not an index file")
        n, levels = struct.unpack_from("<QI", raw, 8)
        at = 20
        self.sizes = np.frombuffer(raw, "<u8", levels, at).tolist()
        at += 8 * levels
        count = sum(self.sizes) // 64
        self.words = np.frombuffer(raw, "<u8", count, at)
        self.ranks = np.frombuffer(raw, "<u4", count, at + 8 * count)
        self.entries = np.frombuffer(raw, ENTRY, n, at + 12 * count)

    def find(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, entries); entries of keys that are not found are meaningless."""
        bit = np.full(len(h), -1, dtype=np.int64)
        left, base = np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = base + (level_hash(h[left], g[left], level) % U64(size)).astype(np.int64)
            hit = (self.words[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1
            bit[left[hit]] = at[hit]
            left, base = left[~hit], base + size
        found = bit >= 0
        if not len(self.entries):
            return found, np.zeros(len(h), ENTRY)
        entries = self.entries[np.where(found, _slots(self.words, self.ranks, np.maximum(bit, 0)), 0)]
        found &= entries["fingerprint"] == (g & U64(0xFFFFFFFF)).astype("<u4")
        return found, entries
