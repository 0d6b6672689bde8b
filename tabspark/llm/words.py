"""Vectorised word spans and hashes over a column of texts (numpy, inside Arrow tasks).

A column is viewed as one byte buffer with row offsets and cut into blocks of about
``BLOCK_BYTES`` (a longer text makes a block of its own), so memory is bounded by the block,
not by the batch.  NULL counts as the empty text.  Hashes are 64 bits: an avalanche step for every 8 bytes
of a short span, XXH3 for a long one.  (No polynomial modulo 2**64: Thue-Morse words collide under any base.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U64 = np.uint64
SEED = 0x9E3779B97F4A7C15

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACES
#: bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z, all of non-ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

LONG = 64  # spans of more bytes are hashed one by one
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


@dataclass
class Block:
    """Rows ``lo`` to ``hi`` of a batch: their bytes and where each row's bytes begin and end."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def blocks(column, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The whole column in blocks of whole rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + block_bytes, side="right")) - 1)
        hi = min(hi, len(column))
        yield Block(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of word bytes; a run never crosses a row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[offsets] = True  # a row's first byte begins a run, whatever the last row ended with
    at = np.flatnonzero(edge)
    at = at[at < n]
    keep = inside[at]
    ends = np.append(at[1:], n)
    return at[keep], ends[keep]


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row of each span (rows without bytes own none)."""
    return np.searchsorted(offsets, starts, side="right") - 1


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number; beyond the end they are 0."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.as_strided(padded[:8].view(U64), (len(data) + 1,), (1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes."""
    size = ends - starts
    h = mix(size.astype(U64) + U64(SEED))
    words = eights(data)
    some = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, now = starts[some], size[some], h[some]
    while len(some):
        now = mix(now ^ (words[at] & MASKS[np.minimum(left, 8)]))
        more = left > 8
        done = some[~more]
        h[done] = now[~more]
        some, at, left, now = some[more], at[more] + 8, left[more] - 8, now[more]
    if len(some := np.flatnonzero(size > LONG)):
        import xxhash

        raw = memoryview(np.ascontiguousarray(data))
        h[some] = [xxhash.xxh3_64_intdigest(raw[s:e], SEED) for s, e in zip(starts[some].tolist(), ends[some].tolist())]
    return h


def hash_words(block: Block, is_word: np.ndarray, lower: bool = True):
    """(hashes, starts, ends, first word of each row, as offsets into the words)."""
    data = LOWER[block.data] if lower else block.data
    starts, ends = word_spans(data, block.offsets, is_word)
    h = hash_spans(data, starts, ends)
    return h, starts, ends, np.searchsorted(starts, block.offsets).astype(np.int64)


def combine(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (crossing rows too; the caller picks)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(width):
        out = (out + h[k : k + n]) * U64(0xC2B2AE3D27D4EB4F)
        out ^= out >> U64(29)
    return mix(out)
