"""Best-fit packing of token sequences (operator 5).

Bounded-space online best fit: pieces arrive one after another; the open bins, at most
``open_bins``, lie in a bitset keyed by free space, so the bin with the least sufficient space is
the lowest set bit at or above the piece's length.  When a bin must be opened beyond the limit,
the fullest open bin closes.  A document longer than ``size`` is cut into pieces of ``size``; full
pieces are sequences of their own.

Each task packs the documents of its own partition as it encodes them, memory bounded by a block of texts and the open bins.
Within a block the pieces arrive in descending length, which fills bins better than the order of the rows.  The pieces of bins still
open at the end of a task are dealt to tasks of about ``REPACK`` pieces and packed again, so the number of sequences does not depend
on how many partitions the table happens to have; no other piece is shuffled.

Defined cases: a NULL text is empty (the end id alone, one piece of length 1); repeated rows are
packed each; an empty table gives no rows; other columns are not read.  Output columns that have the name of the key get an underscore.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.encode import encoder
from tabspark.llm.files import fresh, prepare, quoted, saved
from tabspark.llm.words import blocks
from tabspark.llm.worker import lean

OPEN_BINS = 1024
REPACK = 20_000  # pieces of a task of the second pass


class Bins:
    """Best fit over a bounded number of open bins of ``size`` tokens."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.limit = size, open_bins
        self.free = 0  # bit f is set if an open bin has f free places
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = self.made = 0
        self.closed: list[int] = []  # bins that no piece will enter any more, for the owner to take

    def _take(self, bit: int) -> int:
        own = self.by_free[bit]
        number = own.pop()
        if not own:
            self.free ^= 1 << bit
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``length``, 1 to ``size``."""
        fits = self.free >> length << length
        if fits:
            space = (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if length < self.size and self.open >= self.limit:
                self.closed.append(self._take((self.free & -self.free).bit_length() - 1))
            space, number = self.size, self.made
            self.made += 1
        if left := space - length:
            self.by_free[left].append(number)
            self.free |= 1 << left
            self.open += 1
        else:
            self.closed.append(number)
        return number, self.size - space


class Packer:
    """Bins with the pieces in them: (key, piece, start, length, crc, ids)."""

    def __init__(self, first: int, size: int, open_bins: int, schema: pa.Schema):
        self.bins, self.first, self.schema = Bins(size, open_bins), first, schema
        self.held: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def add(self, pieces: list[tuple]) -> None:
        for piece in sorted(pieces, key=lambda p: -p[3]):
            number, offset = self.bins.place(piece[3])
            self.held.setdefault(number, []).append((*piece[:5], self.first + number, offset, *piece[5:], True))
            for done in self.bins.closed:
                self.out += self.held.pop(done)
            self.bins.closed.clear()

    def take(self, last: bool = False, closed: bool = True) -> Iterator[pa.RecordBatch]:
        """What is in closed bins; at the end what is in the open ones too, marked as such."""
        if last:
            self.out += [(*p[:-1], closed) for own in self.held.values() for p in own]
        for k in range(0, len(self.out), 4096):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.out[k : k + 4096]), self.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.out = []


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, size: int = 2048, open_bins: int = OPEN_BINS, spaces: bool = False, with_ids: bool = True) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    prepare(docs.sparkSession)
    rows = docs.select(*(c.alias(n) for c, n in zip(quoted([key, text]), ("key", "text"))))
    key_type = rows.schema["key"].dataType.simpleString()
    kinds = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "sequence_id": "long", "offset": "long"} | ({"ids": "array<int>"} if with_ids else {})
    schema = f"key {key_type}, " + ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", closed boolean"

    def packer(batch: pa.RecordBatch, second: bool) -> Packer:
        from pyspark import TaskContext

        arrow = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}
        fields = [("key", batch.schema.field("key").type), *((n, arrow[t]) for n, t in kinds.items()), ("closed", pa.bool_())]
        return Packer(second << 62 | TaskContext.get().partitionId() << 33, size, open_bins, pa.schema(fields))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bins = encoder(tokenizer, spaces), None
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            bins = bins or packer(batch, False)
            keys = batch["key"].to_pylist()
            for block in blocks(batch["text"]):
                pieces = []
                for k, ids in enumerate(own.rows(block), block.lo):
                    ids = np.append(ids.astype("<u4"), end)
                    for piece, start in enumerate(range(0, len(ids), size)):
                        part = ids[start : start + size].tobytes()
                        pieces.append((keys[k], piece, start, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] * with_ids)))
                bins.add(pieces)
                yield from bins.take()
        if bins:
            yield from bins.take(last=True, closed=False)

    def repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = None
        for batch in batches:
            bins = bins or packer(batch, True)
            columns = [batch[n].to_pylist() for n in ("key", "piece", "start", "length", "ids_crc32")]
            ids = [[x.values.to_numpy() for x in batch["ids"]]] if with_ids else []
            bins.add(list(zip(*columns, *ids)))
            yield from bins.take()
        if bins:
            yield from bins.take(last=True)

    first = saved(rows.mapInArrow(lean(packed, "encoder"), schema), "packed", outlives=True)
    open_ = first.where("NOT closed")
    tasks = max(1, -(-open_.count() // REPACK))
    again = open_.repartition(tasks).sortWithinPartitions(F.desc("length")).mapInArrow(lean(repacked, "encoder"), schema)
    out = first.where("closed").unionAll(again)
    return out.select(F.col("key").alias(key), *(F.col(n).alias(fresh([key], n)) for n in kinds))


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences from ``pack``'s pieces: sequence_id, n_tokens and the ids in order (at most ``size``)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
