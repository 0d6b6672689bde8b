"""Whole-text tokenisation with the ``tokenizers`` library, fast on repeated words.

Byte-pair tokenizers first cut a text into pre-tokens and encode each alone.  Texts are cut here
at places where both vocabularies always cut (before a run of ASCII white space; between an ASCII
letter and ASCII punctuation other than the apostrophe), every distinct piece is encoded once by
the library, and the ids are put together again.  Rows with other Unicode white space, where the
first rule would not hold, are one piece.  A known piece is found by its hash and compared byte by byte, so pieces
with one hash keep their own ids.  The result equals encoding the whole text (``tests/llm/test_tokens.py``).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from tabspark.llm.hashtable import Slots
from tabspark.llm.words import LONG, LOWER, MASKS, SPACES, U64, Block, eights, hash_spans, mix
from tabspark.llm.worker import keep

ASCII_LETTER = np.zeros(256, dtype=bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
ASCII_PUNCT = np.zeros(256, dtype=bool)
ASCII_PUNCT[33:48] = ASCII_PUNCT[58:65] = ASCII_PUNCT[91:97] = ASCII_PUNCT[123:127] = True
ASCII_PUNCT[39] = False  # 's, 't, ... are pre-tokens of their own

LEARNT = 2000  # new pieces handed to the library at a time


def encoder(path: str, spaces: bool) -> PieceEncoder:
    """One per Python worker, so its pieces serve the tasks that follow, until the worker turns to other work."""
    return keep("encoder", (path, spaces), lambda: PieceEncoder(path, spaces))


class PieceEncoder:
    """spaces: whether white space has ids (byte-level) or is dropped (word-level, lower case).

    The table of known pieces is bounded: it starts anew when half of its ``slots`` are taken, or
    ``pool`` ids or four times as many bytes are held.
    """

    def __init__(self, path: str, spaces: bool, slots: int = 1 << 21, pool: int = 1 << 23):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.spaces, self.slots, self.pool = spaces, slots, pool
        self.clear()

    def clear(self) -> None:
        self.table = Slots(self.slots)
        self.ids = np.zeros(1 << 16, dtype=self.dtype)
        self.n_ids = 0
        self.begin = np.zeros(1 << 16, dtype=np.int32)
        self.length = np.zeros(1 << 16, dtype=np.int32)
        self.bytes = np.zeros(1 << 18, dtype=np.uint8)  # of the pieces; 8 more than are in use
        self.n_bytes = 0
        self.byte_begin = np.zeros(1 << 16, dtype=np.int32)
        self.byte_size = np.zeros(1 << 16, dtype=np.int32)
        self.n = 0

    def pieces(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the pieces of a block."""
        data, n = block.data, len(block.data)
        space = SPACES[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[1:n] = (ASCII_LETTER[data[:-1]] & ASCII_PUNCT[data[1:]]) | (space[1:] & ~space[:-1])
        if not self.spaces:
            cut[1:n] |= ~space[1:] & space[:-1]
        after = np.append(data[1:], np.uint8(0))
        third = np.append(data[2:], np.zeros(min(2, n), np.uint8))
        odd = (data == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (data == 0xE1) & (after == 0x9A) | (data == 0xE3) & (after == 0x80)
        odd |= (data == 0xE2) & ((after == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)) | (after == 0x81) & (third == 0x9F))
        for row in np.unique(np.searchsorted(block.offsets, np.flatnonzero(odd), side="right") - 1):
            cut[block.offsets[row] : block.offsets[row + 1]] = False
            space[block.offsets[row]] = False
        cut[block.offsets] = True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        if not self.spaces:
            keep = ~space[starts]
            starts, ends = starts[keep], ends[keep]
        return starts, ends

    def learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]
        flat, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        while self.n_bytes + len(flat) + 8 > len(self.bytes):
            self.bytes = np.append(self.bytes, np.zeros_like(self.bytes))
        lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        total = int(lengths.sum())
        while self.n_ids + total > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while self.n + len(got) > len(self.begin):
            self.begin, self.length, self.byte_begin, self.byte_size = (np.append(x, np.zeros_like(x)) for x in (self.begin, self.length, self.byte_begin, self.byte_size))
        self.bytes[self.n_bytes : self.n_bytes + len(flat)] = flat
        self.byte_begin[self.n : self.n + len(got)] = self.n_bytes + np.cumsum(sizes) - sizes
        self.byte_size[self.n : self.n + len(got)] = sizes
        self.n_bytes += len(flat)
        self.ids[self.n_ids : self.n_ids + total] = np.fromiter((i for x in got for i in x), dtype=self.dtype, count=total)
        self.begin[self.n : self.n + len(got)] = self.n_ids + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + len(got)] = lengths
        self.table.insert(h, np.arange(self.n, self.n + len(got), dtype=np.int32))
        self.n, self.n_ids = self.n + len(got), self.n_ids + total

    def same(self, at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the spans are byte for byte the pieces number ``at``."""
        size = ends - starts
        out = self.byte_size[at] == size
        some = np.flatnonzero(out & (size <= LONG))
        known, words = np.lib.stride_tricks.as_strided(self.bytes[:8].view(U64), (len(self.bytes) - 7,), (1,)), eights(data)
        one, two, left = starts[some], self.byte_begin[at[some]], size[some]
        while len(some):
            equal = (words[one] ^ known[two]) & MASKS[np.minimum(left, 8)] == 0
            out[some[~equal]] = False
            more = equal & (left > 8)
            some, one, two, left = some[more], one[more] + 8, two[more] + 8, left[more] - 8
        for k in np.flatnonzero(out & (size > LONG)).tolist():
            begin = self.byte_begin[at[k]]
            out[k] = np.array_equal(data[starts[k] : ends[k]], self.bytes[begin : begin + size[k]])
        return out

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the block's rows one after another, first id of each row as offsets into them)."""
        if len(block.data) == 0:
            return np.zeros(0, self.dtype), np.zeros(block.rows + 1, np.int64)
        data = block.data if self.spaces else LOWER[block.data]
        starts, ends = self.pieces(Block(block.lo, block.hi, data, block.offsets))
        h = Slots.nonzero(hash_spans(data, starts, ends))
        if self.n_ids > self.pool or self.n_bytes > 4 * self.pool:
            self.clear()
        while True:
            at = self.table.find(h)
            if len(miss := np.flatnonzero(at < 0)):
                new, first = np.unique(h[miss], return_index=True)
                if self.n + len(new) > self.slots // 2:
                    new, first = np.unique(h, return_index=True)
                    miss = np.arange(len(h))
                    self.slots = max(self.slots, 1 << int(4 * len(new)).bit_length())  # one text with very many words
                    self.clear()
                raw = data.tobytes()
                where = miss[first]
                for k in range(0, len(new), LEARNT):  # the library's answer takes far more memory than the ids
                    some = where[k : k + LEARNT]
                    self.learn(new[k : k + LEARNT], [raw[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist())])
                at = self.table.find(h)
            other = ~self.same(at, data, starts, ends)
            if not other.any():
                break
            h[other] = Slots.nonzero(mix(h[other] + U64(1)))  # another piece has this hash: on to the next one
        lengths = self.length[at].astype(np.int64)
        before = np.concatenate(([0], np.cumsum(lengths)))
        flat = np.arange(before[-1]) + np.repeat(self.begin[at] - before[:-1], lengths)
        return self.ids[flat], before[np.searchsorted(starts, block.offsets)]

    def rows(self, block: Block) -> Iterator[np.ndarray]:
        """The ids of each row."""
        ids, first = self.encode(block)
        for k in range(block.rows):
            yield ids[first[k] : first[k + 1]]
