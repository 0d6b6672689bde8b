"""Token-id files with keyed access (operator 1).

``write`` encodes every text and appends the end id.  Documents are dealt to shards by ranges of
the key and lie in ascending key order; a shard is one file of raw little-endian ids, 2 bytes each
if the vocabulary allows, else 4.  A catalogue table has one row a document.  ``build_index`` hashes the keys
to buckets and writes a minimal perfect hash file for each (``mph.py``): key -> (shard, offset, length)
behind a stored fingerprint.  ``lookup`` finds many keys, ``get`` one, ``read`` takes located
documents from the shards.  Memory in a task is bounded by a block of texts or one index bucket.

Defined cases: a NULL text is empty and has the end id alone; rows of equal key are told
apart by ``ordinal`` (0, 1, ... in the order of the file, which is by text hash); rows
whose key is NULL are written first and are in the catalogue, but no key leads to them; an empty table
gives no shards and finds nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm import mph
from tabspark.llm.encode import encoder
from tabspark.llm.files import filesystem, new_file, prepare, read_bytes, saved, shared_folder
from tabspark.llm.words import U64, blocks
from tabspark.llm.worker import lean

SHARD_BYTES = 32 << 20  # text bytes a shard is cut for
BUCKET_KEYS = 1 << 18  # keys in an index bucket, about


@dataclass
class TokenFiles:
    """What ``write`` left.  ``shards``: file and first token number of each shard, a few bytes per
    ``SHARD_BYTES`` of text; ``buckets``: index file of each bucket."""

    catalogue: DataFrame
    shards: dict[int, tuple[str, int]]
    buckets: dict[int, str]
    id_bytes: int


def _hashes(key) -> list:
    """Two 64-bit hashes of (key, ordinal), the same as ``key_hashes`` computes outside Spark."""
    return [F.xxhash64(key, F.col("ordinal")).alias("_h"), F.xxhash64(F.lit(1).cast("long"), key, F.col("ordinal")).alias("_g")]


def key_hashes(key: int | str, ordinal: int = 0) -> tuple[int, int]:
    from xxhash import xxh64_intdigest

    raw = key.encode() if isinstance(key, str) else int(key).to_bytes(8, "little", signed=True)
    rank = int(ordinal).to_bytes(8, "little")
    h = xxh64_intdigest(rank, xxh64_intdigest(raw, 42))
    g = xxh64_intdigest(rank, xxh64_intdigest(raw, xxh64_intdigest((1).to_bytes(8, "little"), 42)))
    return h, g


def write(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, spaces: bool = True, shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = shared_folder(spark, "token-shards")
    key_type = rows.schema["key"].dataType.simpleString()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(tokenizer, spaces)
        number, uri, out, at, last, ordinal = TaskContext.get().partitionId(), None, None, 0, None, -1
        end = np.array([end_id], dtype=own.dtype)
        for batch in batches:
            if out is None:
                uri, out = new_file(folder, f"shard-{number:06d}", ".ids")
            offsets, lengths, ordinals = [], [], []
            for block in blocks(batch["text"]):
                for ids in own.rows(block):
                    out.write(ids.tobytes() + end.tobytes())
                    offsets.append(at)
                    lengths.append(len(ids) + 1)
                    at += len(ids) + 1
            for k in batch["key"].to_pylist():
                ordinal = ordinal + 1 if k == last else 0
                last = k
                ordinals.append(ordinal)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array(ordinals, pa.int64()), pa.array([number] * n, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array([uri] * n, pa.string())],
                ["key", "ordinal", "shard", "offset", "length", "file"],
            )
        if out is not None:
            out.close()

    dealt = rows.repartitionByRange(max(1, -(-size // shard_bytes)), "key").sortWithinPartitions("key", F.xxhash64("text"), "text")
    catalogue = saved(dealt.mapInArrow(lean(shard, "encoder"), f"key {key_type}, ordinal long, shard int, offset long, length long, file string"), "token-catalogue")
    begin, shards = 0, {}
    for r in catalogue.groupBy("shard", "file").agg(F.sum("length").alias("n")).orderBy("shard").collect():
        shards[r["shard"]] = (r["file"], begin)
        begin += r["n"]
    id_bytes = encoder(tokenizer, spaces).dtype.itemsize
    return TokenFiles(catalogue, shards, build_index(catalogue), id_bytes)


def _to_buckets(keys: DataFrame, n: int) -> DataFrame:
    """Rows with ``key`` and ``ordinal``, one partition a bucket."""
    hashed = keys.select("*", *_hashes(F.col("key")))
    return hashed.repartitionById(n, F.pmod(F.col("_h"), F.lit(n)).cast("int"))


def build_index(catalogue: DataFrame, bucket_keys: int = BUCKET_KEYS) -> dict[int, str]:
    spark = catalogue.sparkSession
    keys = catalogue.where("key IS NOT NULL")
    n = max(1, -(-keys.count() // bucket_keys))
    folder = shared_folder(spark, "token-index")

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [[b[c].to_numpy() for c in ("_h", "_g", "shard", "offset", "length")] for b in batches if b.num_rows]
        if parts:
            h, g, *rest = (np.concatenate(x) for x in zip(*parts))
            number = TaskContext.get().partitionId()
            uri, out = new_file(folder, f"bucket-{number:06d}", ".idx")
            with out:
                out.write(mph.build(h.view(U64), g.view(U64), *rest))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([uri])], ["bucket", "file"])

    rows = _to_buckets(keys, n).select("_h", "_g", "shard", "offset", "length")
    found = {r["bucket"]: r["file"] for r in rows.mapInArrow(bucket, "bucket int, file string").collect()}
    return {k: found.get(k, "") for k in range(n)}


def lookup(files: TokenFiles, keys: DataFrame, key: str = "doc_id", ordinal: str | None = None) -> DataFrame:
    """(key, ordinal, shard, offset, length) of the keys that the index has, each row of ``keys`` apart."""
    buckets = files.buckets
    rows = keys.select(F.col(key).alias("key"), (F.col(ordinal) if ordinal else F.lit(0)).cast("long").alias("ordinal")).where("key IS NOT NULL")
    key_type = rows.schema["key"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if index is None:
                if not (uri := buckets[TaskContext.get().partitionId()]):
                    return
                index = mph.Bucket(read_bytes(uri))
            found, entries = index.find(batch["_h"].to_numpy().view(U64), batch["_g"].to_numpy().view(U64))
            rows = pa.Table.from_batches([batch]).select(["key", "ordinal"])
            for name, kind in (("shard", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())):
                rows = rows.append_column(name, pa.array(entries[name].astype(np.int64)).cast(kind))
            yield from rows.filter(pa.array(found)).to_batches()

    return _to_buckets(rows, len(buckets)).mapInArrow(find, f"key {key_type}, ordinal long, shard int, offset long, length long")


def read(files: TokenFiles, located: DataFrame) -> DataFrame:
    """``lookup``'s rows with ``start`` (ids of all documents before) and ``ids`` (little-endian 32-bit)."""
    shards, width = files.shards, files.id_bytes
    n = max(1, max(shards, default=0) + 1)
    schema = located.select("key", "ordinal", "length").schema

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, at, source = None, None, None
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                starts, ids = [], []
                for shard, offset, length in zip(*(part[c].to_pylist() for c in ("shard", "offset", "length"))):
                    if shard != at:
                        if source is not None:
                            source.close()
                        system, path = filesystem(shards[shard][0])
                        source, at = system.open_input_file(path), shard
                    raw = source.read_at(length * width, offset * width)
                    ids.append(raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                    starts.append(shards[shard][1] + offset)
                yield pa.RecordBatch.from_arrays([part["key"], part["ordinal"], part["length"], pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["key", "ordinal", "length", "start", "ids"])
        if source is not None:
            source.close()

    dealt = located.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "offset")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return dealt.mapInArrow(load, f"{fields}, start long, ids binary")


def get(spark: SparkSession, files: TokenFiles, key: int | str, ordinal: int = 0) -> np.ndarray | None:
    """The ids of one document (with the end id), or None if no such key was written."""
    h, g = key_hashes(key, ordinal)
    signed = h - (1 << 64) if h >> 63 else h
    if not (uri := files.buckets[signed % len(files.buckets)]):
        return None
    found, entries = mph.Bucket(read_bytes(uri)).find(np.array([h], U64), np.array([g], U64))
    if not found[0]:
        return None
    system, path = filesystem(files.shards[int(entries["shard"][0])][0])
    with system.open_input_file(path) as source:
        raw = source.read_at(int(entries["length"][0]) * files.id_bytes, int(entries["offset"][0]) * files.id_bytes)
    return np.frombuffer(raw, f"<u{files.id_bytes}").astype(np.int64)
