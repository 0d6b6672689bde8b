"""Suffix-array deduplication by a common-prefix-aware distributed merge sort (operator 12).

Every byte covered by a string of ``width`` bytes that also starts elsewhere is removed.  Texts are packed into runs of about
``RUN_BYTES``.  A run sorts suffixes (cut to the bytes that matter), front-codes them (each with the length of the prefix it
shares with the one before) and deals them to ranges of the order; a range merges the runs' pieces with a loser tree whose
nodes keep common prefix lengths, so that two strings are compared from the first byte that is not yet known equal, if at
all.  A string that its neighbours in the merged order share in full occurs elsewhere.

Sorting every suffix would move hundreds of bytes for each byte of text, so suffixes are grouped and thinned without loss:

* The *anchor* of a window is the leftmost position in it with the least 8-byte hash, so equal windows have equal anchors at
  equal distance.  Windows of one anchor whose distances lie in one interval of ``cuts`` are a *cell*, and the cell's
  string is their union.  If the cell's string occurs elsewhere, so do all its windows: one sorted suffix settles up to 100.
* All windows of a cell contain its *core*.  A window that occurs elsewhere occurs there in a cell with the same core, so
  cells whose core's hash occurs once are dropped before the sort.  Hashes only ever drop what is unique, the sort decides.
* What is not settled, because a repeated passage begins or ends inside the cell, goes on to finer cells (8 windows, then 1),
  together with the settled cells of the same core, one for each string and run.  At the last level the sorted suffixes are
  the windows themselves.

A run hands on each hash and each string once, however often it holds it, so a passage that fills a third of the rows is one
entry a run.  Texts of runs lie in files in the shared folder; tables between the steps hold a row a run.

What is on disk at a time stays near the size of the texts: cells whose strings can be equal, or one the beginning of the other,
have the same core, so the strings are sorted in slices by their core's hash, each of about half the texts' bytes; and a
step's shuffle files and tables go as soon as the next step is written.

Defined cases: a NULL text is empty (no bytes, the digest of nothing); texts shorter than ``width`` keep all; a text longer
than ``RUN_BYTES`` is a run of its own; repeated rows and rows with the same or no id are texts of their own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.files import new_file, prepare, quoted, read_bytes, saved, scratch, shared_folder, shuffles_dropped
from tabspark.llm.words import U64, blocks, eights, mix

WIDTH = 200
GRAM = 8  # bytes of the hash that makes an anchor
RUN_BYTES = 8 << 20
SEGMENT = 1 << 20  # windows whose anchors are found at a time
BUCKET_KEYS, RANGE_BYTES = 1 << 20, 4 << 20  # of a hash bucket, of a range of strings
MAX_RANGES = 1 << 16  # their first strings are broadcast
SLICE_BYTES = 64 << 20  # of the strings sorted at a time, or half the texts' bytes, if that is more
SMALL = {"compression": "zstd"}
CELL = np.dtype([("a", "<i4"), ("lo", "<i2"), ("hi", "<i2"), ("known", "u1")])  # anchor, distances to its windows' starts
ODD = U64(0x9E3779B97F4A7C15)


def levels(width: int) -> list[np.ndarray]:
    """Bounds of the distance intervals of each level."""
    spans = width - GRAM + 1
    return [np.array([0, width // 2, spans]), np.append(np.arange(0, spans, 8), spans), np.arange(spans + 1)]


class Text:
    """The bytes of a run, read when first used, and where its texts begin and end."""

    def __init__(self, uri: str, sizes: bytes):
        self.uri = uri
        self.offsets = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<i8"))))

    @cached_property
    def raw(self) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(read_bytes(self.uri)) if self.uri else b""

    @cached_property
    def words(self) -> np.ndarray:
        """The 8 bytes from each position as one number."""
        return eights(np.frombuffer(self.raw, np.uint8))

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of each span of at least 8 bytes."""
        out = size.astype(U64)
        for length in np.unique(size):
            some = np.flatnonzero(size == length)
            at, h = start[some], out[some]
            for k in [*range(0, length - 7, 8), length - 8]:
                h = (h ^ self.words[at + k]) * ODD
                h ^= h >> U64(29)
            out[some] = mix(h)
        return out

    def shared(self, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the spans from ``one`` and from ``two``, at most ``size``."""
        out = np.zeros(len(size), np.int64)
        some, at = np.flatnonzero(size > 0), 0
        while len(some):
            apart = self.words[one[some] + at] ^ self.words[two[some] + at]
            first = np.log2(np.maximum(apart & (~apart + U64(1)), U64(1)).astype(float)).astype(np.int64) // 8  # byte of the lowest bit
            out[some] = np.minimum(at + np.where(apart == 0, 8, first), size[some])
            at += 8
            some = some[(apart == 0) & (size[some] > at)]
        return out

    def anchors(self, width: int) -> np.ndarray:
        """A cell for each anchor, of all its windows.  The windows of a text longer than ``SEGMENT`` are cut there too."""
        begins, ends = self.offsets[:-1], self.offsets[1:] - width + 1
        some = ends > begins
        edge = np.zeros(len(self.raw) + 1, np.int8)
        edge[begins[some]] = 1
        np.add.at(edge, ends[some], -1)
        valid = np.cumsum(edge, dtype=np.int8).astype(bool)
        spans, out = width - GRAM + 1, []
        for first in range(0, len(self.raw), SEGMENT):
            ok = valid[first : first + SEGMENT]
            last = int(ok.nonzero()[0][-1]) + 1 if ok.any() else 0
            if not last:
                continue
            h = mix(self.words[first : first + last + spans - 1] * ODD)
            bits = U64(len(h).bit_length())
            least = h >> bits << bits | np.arange(len(h), dtype=U64)  # of equal hashes the leftmost
            reach = 1
            while 2 * reach <= spans:
                least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
            least = np.minimum(least[:last], least[spans - reach :][:last])
            p = np.flatnonzero(ok[:last])
            a = (least[p] & ((U64(1) << bits) - U64(1))).astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1))))
            end = np.append(new[1:], len(p)) - 1
            cells = np.zeros(len(new), CELL)
            cells["a"], cells["hi"], cells["lo"] = a[new] + first, a[new] - p[new], a[new] - p[end]
            out.append(cells)
        return np.concatenate(out) if out else np.zeros(0, CELL)


def divided(cells: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Cells cut at the bounds of a finer level."""
    one, two = (np.searchsorted(cuts, cells[c], side="right") - 1 for c in ("lo", "hi"))
    n = two - one + 1
    out = np.repeat(cells, n)
    k = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(one, n)
    out["lo"], out["hi"] = np.maximum(out["lo"], cuts[k]), np.minimum(out["hi"], cuts[k + 1] - 1)
    return out


def cores(text: Text, cells: np.ndarray, cuts: np.ndarray, width: int) -> np.ndarray:
    """Hash of what all windows in the cell's interval of distances contain."""
    k = np.searchsorted(cuts, cells["lo"], side="right") - 1
    return text.hashes(cells["a"].astype(np.int64) - cuts[k], width - (cuts[k + 1] - 1 - cuts[k]))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def spans(cells: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of the cells' strings."""
    a = cells["a"].astype(np.int64)
    return a - cells["hi"], a - cells["lo"] + width


def ordered(text: Text, cells: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(one cell of each distinct string, in the strings' order; for each cell the place of its string there)."""
    strings = [text.raw[s:e] for s, e in zip(*(x.tolist() for x in spans(cells, width)))]
    one = {s: k for k, s in enumerate(strings)}
    number = {s: k for k, s in enumerate(sorted(one))}
    of = np.fromiter((number[s] for s in strings), np.int64, len(strings))
    first = np.empty(len(one), np.int64)
    first[of] = np.arange(len(of))
    return first, of


def common_prefix(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(x), len(y))
    while known < n:
        a, b = x[known : min(known + 48, n)], y[known : min(known + 48, n)]
        if a != b:
            apart = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
            return known + len(a) - (apart.bit_length() + 7) // 8
        known += len(a)
    return n


def front_coded(text: Text, begins: np.ndarray, ends: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(common prefix with the string before, length of the rest, the rests) of strings in order, given as spans of the run."""
    shared = np.zeros(len(begins), np.int64)
    shared[1:] = text.shared(begins[:-1], begins[1:], np.minimum(ends - begins, np.roll(ends - begins, 1))[1:])
    starts = begins + shared
    rests = b"".join([text.raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())])
    return shared.astype("<i4").tobytes(), (ends - starts).astype("<i4").tobytes(), rests


def decoded(shared: bytes, sizes: bytes, rests: bytes) -> tuple[list[int], list[bytes]]:
    out, at, last = [], 0, b""
    shared = np.frombuffer(shared, "<i4").tolist()
    for n, size in zip(shared, np.frombuffer(sizes, "<i4").tolist()):
        last = last[:n] + rests[at : at + size]
        at += size
        out.append(last)
    return shared, out


def merged(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, common prefix with the string given before) of all strings in order.

    A loser tree: each node keeps the run that lost there and the common prefix of its string with the winner's, which is also
    its common prefix with the string given last when that winner's successor comes by.  Of two strings with different common prefixes
    with the string given last, the longer one is smaller, and the shorter is their own common prefix; only at equal lengths are bytes compared, from
    there on."""
    size = 1 << max(len(runs) - 1, 1).bit_length()
    place = [0] * size
    head: list[bytes | None] = [strings[0] if strings else None for _, strings in runs] + [None] * (size - len(runs))
    loser, shared = [-1] * size, [-1] * size
    winner, known = -1, -1
    for start in range(size):  # the first tournament: a node keeps its first comer until the other one arrives
        run, h, node = start, 0 if head[start] is not None else -1, (start + size) >> 1
        while node:
            if loser[node] < 0:
                loser[node], shared[node] = run, h
                break
            run, h = _match(loser, shared, head, node, run, h)
            node >>= 1
        else:
            winner, known = run, h
    while head[winner] is not None:
        yield winner, place[winner], known
        place[winner] += 1
        prefixes, strings = runs[winner]
        if place[winner] < len(strings):
            head[winner], known = strings[place[winner]], prefixes[place[winner]]
        else:
            head[winner], known = None, -1  # behind all others
        node = (winner + size) >> 1
        while node:
            if shared[node] > known:  # shares more with the last string given: smaller, without a look at the bytes
                loser[node], winner = winner, loser[node]
                shared[node], known = known, shared[node]
            elif shared[node] == known >= 0:
                winner, known = _match(loser, shared, head, node, winner, known)
            node >>= 1


def _match(loser: list[int], shared: list[int], head: list, node: int, run: int, h: int) -> tuple[int, int]:
    """(winner, its common prefix) at a node; the node keeps the other."""
    other, n = loser[node], shared[node]
    if n != h or h < 0:
        if n <= h:
            return run, h
        loser[node], shared[node] = run, h
        return other, n
    x, y = head[run], head[other]
    n = shared[node] = common_prefix(x, y, h)
    if n < len(x) and (n == len(y) or y[n] < x[n]):
        loser[node] = run
        return other, h
    return run, h


class Steps:
    """The steps between the tables of a job; each maps rows of runs (run, uri, sizes, cells, ...)."""

    def __init__(self, spark, width: int, runs: DataFrame):
        self.spark, self.width, self.runs = spark, width, runs
        self.number, self.bytes = runs.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        self.tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(self.number, 20_000))

    def spread(self, df: DataFrame) -> DataFrame:
        """A run is little to read but much to work on: as many tasks as there are runs.  Tables written so are read so."""
        return df.repartition(self.tasks, "run")

    def map(self, df: DataFrame, step: Callable[[dict, Text], Iterator[dict]], schema: str) -> DataFrame:
        names = [part.split()[0] for part in schema.split(", ")]

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    if found := list(step(row, Text(row["uri"], row["sizes"]))):
                        yield pa.RecordBatch.from_pylist(found, schema=arrow)

        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
        arrow = pa.schema([(n, kinds[part.split()[1]]) for n, part in zip(names, schema.split(", "))])
        return df.mapInArrow(each, schema)

    def with_flags(self, cells: DataFrame, flags: DataFrame) -> DataFrame:
        """Rows of runs with the flags that came back to them, in the order of the parts they had sent."""
        own = flags.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("part", "flags"))).alias("parts"))
        own = own.select("run", F.transform("parts", lambda p: p["flags"]).alias("flags"))
        return self.spread(cells).join(self.spread(own), "run", "left")

    def asked(self, cells: DataFrame, cuts: np.ndarray, total: int, proven: bool) -> DataFrame:
        """(run, part, flags): for each distinct core of a run, in order of its hash, whether it occurs at least twice, and in a cell
        that is not known, or proven, to occur elsewhere."""
        width, buckets = self.width, max(4 * self.tasks, -(-total // BUCKET_KEYS))

        def send(row, text):
            own = np.frombuffer(row["cells"], CELL)
            mark = 1 - (own["known"] | np.frombuffer(row["proven"], np.uint8) if proven else own["known"])
            hashes = np.frombuffer(row["cores"], U64) if proven else cores(text, own, cuts, width)
            keys, of, n = np.unique(hashes, return_inverse=True, return_counts=True)
            marks = np.zeros(len(keys), np.uint8)
            np.maximum.at(marks, of, mark)
            marks |= (n > 1).astype(np.uint8) << 1
            bucket = bucket_of(keys, buckets)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                yield {"run": row["run"], "part": int(bucket[lo]), "keys": keys[lo:hi].tobytes(), "marks": marks[lo:hi].tobytes()}

        def meet(table: pa.Table) -> pa.Table:
            sent = [np.frombuffer(x, U64) for x in table["keys"].to_pylist()]
            marks = np.concatenate([np.frombuffer(x, np.uint8) for x in table["marks"].to_pylist()])
            keys, of = np.unique(np.concatenate(sent), return_inverse=True)
            several = np.bincount(of, weights=1 + (marks >> 1), minlength=len(keys)) > 1
            wanted = np.bincount(of, weights=marks & 1, minlength=len(keys)) > 0
            flags = (several & wanted)[of].astype(np.uint8)
            ends = np.cumsum([len(k) for k in sent])
            return pa.table({"run": table["run"], "part": table["part"], "flags": pa.array([f.tobytes() for f in np.split(flags, ends[:-1])], pa.binary())})

        needed = ["run", "uri", "sizes", "cells", *(["cores", "proven"] if proven else [])]
        sent = self.map(cells.select(*needed), send, "run long, part long, keys binary, marks binary")
        return sent.groupBy("part").applyInArrow(meet, "run long, part long, flags binary")

    def open_cells(self, cells: DataFrame, flags: DataFrame, cuts: np.ndarray) -> DataFrame:
        """Rows of runs with only the cells whose core may have to be sorted, their strings in order and their cores."""
        width = self.width

        def keep(row, text):
            own = np.frombuffer(row["cells"], CELL)
            hashes = cores(text, own, cuts, width)
            kept = np.frombuffer(b"".join(row["flags"]), bool)[np.unique(hashes, return_inverse=True)[1]]
            own = own[kept]
            if len(own):
                first, of = ordered(text, own, width)
                begin, end = spans(own[first], width)
                yield {
                    "run": row["run"], "uri": row["uri"], "sizes": row["sizes"], "cells": own.tobytes(), "cores": hashes[kept].tobytes(),
                    "first": first.astype("<i4").tobytes(), "of": of.astype("<i4").tobytes(), "n": len(first), "bytes": int((end - begin).sum()),
                }

        schema = "run long, uri string, sizes binary, cells binary, cores binary, first binary, of binary, n long, bytes long"
        return saved(self.map(self.with_flags(cells.drop("n"), flags), keep, schema), "cells", outlives=True, **SMALL)

    def slices(self, size: int) -> int:
        """In how many slices so many bytes of strings are sorted."""
        return max(1, -(-size // max(self.bytes // 2, SLICE_BYTES)))

    def splitters(self, cells: DataFrame, total: int, size: int, slices: int) -> list[bytes]:
        """First strings of ranges of about ``RANGE_BYTES`` of a slice, from a random sample of 32 strings a range."""
        ranges = min(max(size // RANGE_BYTES, min(4 * self.tasks, total // 64)) // slices + 1, MAX_RANGES)
        rate, width = min(1.0, 32 * ranges / max(total, 1)), self.width

        def pick(row, text):
            own = np.frombuffer(row["cells"], CELL)[np.frombuffer(row["first"], "<i4")]
            begin, end = spans(own[np.random.Generator(np.random.PCG64(row["run"])).random(len(own)) < rate], width)
            yield {"strings": [text.raw[s:e] for s, e in zip(begin.tolist(), end.tolist())]}

        source = cells.select("run", "uri", "sizes", "cells", "first")
        sample = sorted(bytes(s) for r in self.map(source, pick, "strings array<binary>").toLocalIterator() for s in r["strings"])
        return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []

    def proven(self, cells: DataFrame, splitters: list[bytes], slices: int) -> DataFrame:
        """Rows of runs with, for each cell, whether its string occurs elsewhere, by the merge sort of all strings, slice by slice."""
        width, spark = self.width, self.spark
        bounds = spark.sparkContext.broadcast(splitters)

        def send(row, text, number):
            first = np.frombuffer(row["first"], "<i4")
            first = first[bucket_of(np.frombuffer(row["cores"], U64)[first], slices) == number]
            if not len(first):
                return
            begin, end = spans(np.frombuffer(row["cells"], CELL)[first], width)
            string = lambda k: text.raw[begin[k] : end[k]]
            cuts = [0, *(bisect.bisect_left(range(len(begin)), s, key=string) for s in bounds.value), len(begin)]
            for part, (lo, hi) in enumerate(zip(cuts, cuts[1:]), number * (len(bounds.value) + 1)):
                if hi > lo:
                    shared, sizes, rests = front_coded(text, begin[lo:hi], end[lo:hi])
                    yield {"run": row["run"], "part": part, "shared": shared, "lengths": sizes, "rests": rests}

        def merge(table: pa.Table) -> pa.Table:
            runs = [decoded(*x) for x in zip(*(table[c].to_pylist() for c in ("shared", "lengths", "rests")))]
            flags = [bytearray(len(strings)) for _, strings in runs]
            last = last_place = last_size = -1
            for run, place, known in merged(runs):
                size = len(runs[run][1][place])
                if last >= 0 and known >= last_size:  # the one before is a prefix of this one, or equal
                    flags[last][last_place] = 1
                if known >= size:
                    flags[run][place] = 1
                last, last_place, last_size = run, place, size
            return pa.table({"run": table["run"], "part": table["part"], "flags": pa.array([bytes(f) for f in flags], pa.binary())})

        def mark(row, text):
            of = np.frombuffer(row["of"], "<i4")
            found, number = np.bincount(of) > 1, np.zeros(of.max() + 1, np.int64)
            number[of] = bucket_of(np.frombuffer(row["cores"], U64), slices)
            found[np.argsort(number, kind="stable")] |= np.frombuffer(b"".join(row["flags"]), bool)  # flags come slice by slice
            yield {c: row[c] for c in ("run", "uri", "sizes", "cells", "cores", "of")} | {"proven": found[of].astype(np.uint8).tobytes()}

        source, flags = cells.select("run", "uri", "sizes", "cells", "cores", "first"), []
        for number in range(slices):
            sent = self.map(source, partial(send, number=number), "run long, part long, shared binary, lengths binary, rests binary")
            flags.append(saved(sent.groupBy("part").applyInArrow(merge, "run long, part long, flags binary"), "flags"))
        bounds.unpersist()
        marked = self.with_flags(cells.drop("first", "n", "bytes"), reduce(DataFrame.unionByName, flags))
        return saved(self.map(marked, mark, "run long, uri string, sizes binary, cells binary, cores binary, of binary, proven binary"), "proven", outlives=True, **SMALL)

    def covered(self, cells: DataFrame) -> DataFrame:
        """(run, starts, ends): the spans that the proven cells of a run cover, in order and apart."""
        width = self.width

        def join(row, text):
            start, end = spans(np.frombuffer(row["cells"], CELL)[np.frombuffer(row["proven"], bool)], width)
            if len(start):
                order = np.argsort(start)
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
                start, end = start[new], end[np.append(new[1:] - 1, len(end) - 1)]
                yield {"run": row["run"], "starts": start.astype("<i8").tobytes(), "ends": end.astype("<i8").tobytes()}

        source = cells.select("run", "uri", "sizes", "cells", "proven")
        return saved(self.map(source, join, "run long, starts binary, ends binary"), "covered", outlives=True, **SMALL)

    def finer(self, cells: DataFrame, flags: DataFrame, next_cuts: np.ndarray) -> DataFrame:
        """The cells of the next level: of cores with an unproven cell, all unproven cells and each proven string once a run."""
        def cut(row, text):
            own, proven = np.frombuffer(row["cells"], CELL).copy(), np.frombuffer(row["proven"], bool)
            wanted = np.frombuffer(b"".join(row["flags"]), bool)[np.unique(np.frombuffer(row["cores"], U64), return_inverse=True)[1]]
            own["known"] |= proven
            once = np.zeros(len(own), bool)
            once[np.unique(np.frombuffer(row["of"], "<i4"), return_index=True)[1]] = True
            out = divided(own[wanted & (once | ~proven)], next_cuts)
            if len(out):
                yield {"run": row["run"], "uri": row["uri"], "sizes": row["sizes"], "cells": out.tobytes(), "n": len(out)}

        return saved(self.map(self.with_flags(cells, flags), cut, "run long, uri string, sizes binary, cells binary, n long"), "cells", outlives=True, **SMALL)


def packed(docs: DataFrame, key: str, text: str, run_bytes: int) -> DataFrame:
    """(run, uri, keys, sizes, bytes): the texts in files of about ``run_bytes``, each with its rows' keys and sizes in bytes."""
    rows = docs.select(*(c.alias(n) for c, n in zip(quoted([key, text]), ("key", "text"))))
    folder = shared_folder(docs.sparkSession, "texts")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        number, first = 0, TaskContext.get().partitionId() << 32
        data, sizes, keys = [], [], []

        def flush():
            uri, out = new_file(folder, "run", ".zst")
            with out:
                out.write(zstandard.ZstdCompressor(3).compress(b"".join(data)))
            own = pa.chunked_array(keys).combine_chunks()
            listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            columns = [pa.array([first + number], pa.int64()), pa.array([uri]), listed, pa.array([np.concatenate(sizes).astype("<i8").tobytes()], pa.binary()), pa.array([sum(map(len, data))], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["run", "uri", "keys", "sizes", "bytes"])

        for batch in batches:
            for block in blocks(batch["text"], run_bytes):
                if data and sum(map(len, data)) + len(block.data) > run_bytes:
                    yield flush()
                    number, data, sizes, keys = number + 1, [], [], []
                data.append(block.data.tobytes())
                sizes.append(np.diff(block.offsets))
                keys.append(batch["key"].slice(block.lo, block.rows))
        if data:
            yield flush()

    kind = rows.schema["key"].dataType.simpleString()
    return saved(rows.mapInArrow(pack, f"run long, uri string, keys array<{kind}>, sizes binary, bytes long"), "runs")


def repeated(steps: Steps) -> DataFrame:
    """(run, found): the spans of each run's bytes that cells with proven strings cover, level by level."""
    width, cuts = steps.width, levels(steps.width)

    def first(row, text):
        own = divided(text.anchors(width), cuts[0])
        if len(own):
            yield {"run": row["run"], "uri": row["uri"], "sizes": row["sizes"], "cells": own.tobytes(), "n": len(own)}

    schema, found, raw = "run long, uri string, sizes binary, cells binary, n long", [], None
    for level, now in enumerate(cuts):
        with scratch(steps.spark):  # of a level only what was proven and the next level's cells are kept
            with scratch(steps.spark):
                with scratch(steps.spark):
                    if not level:
                        raw = saved(steps.map(steps.spread(steps.runs.drop("keys")), first, schema), "cells", **SMALL)
                    total = raw.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
                    kept = steps.open_cells(raw, steps.asked(raw, now, total, False), now)
                total, size = kept.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
                slices = steps.slices(size)
                cells = steps.proven(kept, steps.splitters(kept, total, size, slices), slices)
            found.append(steps.covered(cells))
            if level + 1 < len(cuts):
                raw = steps.finer(cells, steps.asked(cells, now, total, True), cuts[level + 1])
    return reduce(DataFrame.unionByName, found).groupBy("run").agg(F.collect_list(F.struct("starts", "ends")).alias("found"))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, run_bytes: int = RUN_BYTES, with_text: bool = False) -> DataFrame:
    """Per row: ``key``, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the bytes that stay."""
    if not 2 * GRAM <= width < 1 << 15:
        raise ValueError(f"width is {width}: it must be at least {2 * GRAM} and below {1 << 15}")
    prepare(docs.sparkSession)
    with scratch(docs.sparkSession), shuffles_dropped(docs.sparkSession):
        return saved(_removed(docs, key, text, width, run_bytes, with_text), "deduplicated", outlives=True)


def _removed(docs: DataFrame, key: str, text: str, width: int, run_bytes: int, with_text: bool) -> DataFrame:
    runs = packed(docs, key, text, run_bytes)
    steps = Steps(docs.sparkSession, width, runs)
    both = steps.spread(runs).join(steps.spread(repeated(steps)), "run", "left")
    numbers = ["n_bytes", "n_removed", "n_spans"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                own = row.select(["uri", "sizes", "found"]).to_pylist()[0]
                full = Text(own["uri"], own["sizes"])
                edge = np.zeros(len(full.raw) + 1, np.int64)
                for part in own["found"] or []:
                    np.add.at(edge, np.frombuffer(part["starts"], "<i8"), 1)
                    np.add.at(edge, np.frombuffer(part["ends"], "<i8"), -1)
                gone = np.cumsum(edge[:-1]) > 0
                begins = gone & np.concatenate(([True], ~gone[:-1]))[: len(gone)]
                begins[full.offsets[:-1][full.offsets[:-1] < len(gone)]] |= gone[full.offsets[:-1][full.offsets[:-1] < len(gone)]]
                before = [np.concatenate(([0], np.cumsum(x))) for x in (gone, begins)]
                removed, spans = (np.diff(x[full.offsets]) for x in before)
                stays = np.frombuffer(full.raw, np.uint8)[~gone].tobytes()
                ends = full.offsets - before[0][full.offsets]
                kept = [stays[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                digests = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
                columns = [row["keys"].flatten(), *(pa.array(x.astype(np.int64)) for x in (np.diff(full.offsets), removed, spans)), digests]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_text, [key, *numbers, "kept_sha256"] + ["kept"] * with_text)

    kind = docs.schema[key].dataType.simpleString()
    return both.select("uri", "keys", "sizes", "found").mapInArrow(cut, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
