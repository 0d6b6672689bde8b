"""A vectorised open-addressing table from 64-bit hashes to entry numbers, and per-word values kept in one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tabspark.llm.words import U64


class Slots:
    """Hash -> entry number.  Half of the slots may be taken; the owner starts a new table beyond that."""

    def __init__(self, slots: int):
        self.slots = slots
        self.keys = np.zeros(slots, dtype=U64)
        self.entry = np.zeros(slots, dtype=np.int32)

    @staticmethod
    def nonzero(h: np.ndarray) -> np.ndarray:
        """Hashes with 0, which marks a free slot, made 1."""
        return np.where(h == 0, U64(1), h)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        at = (h & U64(self.slots - 1)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == h, self.entry[at], -1).astype(np.int64)
        open_ = np.flatnonzero((found != h) & (found != 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (self.slots - 1)
            found = self.keys[at]
            hit = found == h[open_]
            out[open_[hit]] = self.entry[at[hit]]
            go = ~hit & (found != 0)
            open_, at = open_[go], at[go]
        return out

    def insert(self, h: np.ndarray, entries: np.ndarray) -> None:
        """New distinct hashes."""
        at = (h & U64(self.slots - 1)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.entry[at[put]] = h[put], entries[put]
            rest = np.ones(len(h), dtype=bool)
            rest[put] = False
            h, entries, at = h[rest], entries[rest], (at[rest] + 1) & (self.slots - 1)


class WordValues:
    """One number a distinct word, worked out when the word is first seen.  Holds up to half of
    ``slots`` words, then starts anew."""

    def __init__(self, value: Callable[[list[bytes]], np.ndarray], slots: int = 1 << 21):
        self.value, self.slots = value, slots
        self.clear()

    def clear(self) -> None:
        self.table, self.values, self.n = Slots(self.slots), np.zeros(self.slots // 2 + 1), 0

    def of(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The value of each word of a block."""
        h = Slots.nonzero(h)
        at = self.table.find(h)
        if len(miss := np.flatnonzero(at < 0)):
            new, first = np.unique(h[miss], return_index=True)
            if self.n + len(new) > self.slots // 2:
                new, first = np.unique(h, return_index=True)
                miss = np.arange(len(h))
                self.slots = max(self.slots, 1 << (4 * len(new)).bit_length())
                self.clear()
            raw, where = data.tobytes(), miss[first]
            words = [raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())]
            self.values[self.n : self.n + len(new)] = self.value(words)
            self.table.insert(new, np.arange(self.n, self.n + len(new), dtype=np.int32))
            self.n += len(new)
            at = self.table.find(h)
        return self.values[at]


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's words; ``first`` is where each row's words begin (and the last ends)."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]
