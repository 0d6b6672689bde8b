"""Bloom filters as plain tables, with DataFrame functions only.

A filter is a table (part, word, bits) of its 64-bit words that are not zero; a key belongs to one part by its hash and
sets or tests two bits there.  There are 16 bits a key at any size: a part has at most ``MAX_BITS`` bits, so its table has at
most ``MAX_BITS / 64`` rows and can be broadcast, and more keys make more parts, each tested with a broadcast of its own.
A filter only decides which rows go through the exact step that follows; results never depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.llm.files import fresh, quoted, saved

MAX_BITS = 1 << 26  # of a part: 8 MB of bits, at most 2**20 rows to broadcast


@dataclass
class Bloom:
    words: DataFrame
    bits: int
    parts: int


def size_for(keys: int) -> tuple[int, int]:
    """(bits of a part, parts) for so many keys."""
    bits = min(MAX_BITS, 1 << max(10, (16 * keys - 1).bit_length()))
    return bits, max(1, -(-16 * keys // bits))


def _part(h: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), h), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)


def _cells(h: Column, bits: int) -> tuple[Column, Column]:
    mask = F.lit(bits - 1).cast("long")
    return h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)


def _words(cells: DataFrame, bits: int, parts: int, kind: str) -> Bloom:
    bit = F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")
    words = cells.groupBy("part", F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return Bloom(saved(words, kind), bits, parts)


def _each_cell(keys: DataFrame, h: Column, bits: int, parts: int) -> DataFrame:
    return keys.select(_part(h, parts).alias("part"), F.explode(F.array(*_cells(h, bits))).alias("cell"))


def repeated(keys: DataFrame, h: Column, n: int) -> Bloom:
    """First pass: the cells that at least two of ``n`` rows hit.  Every hash that occurs twice tests
    positive; of the others, those whose two cells other rows hit."""
    bits, parts = size_for(n)
    cells = _each_cell(keys, h, bits, parts)
    return _words(cells.groupBy("part", "cell").count().where("count > 1"), bits, parts, "bloom-repeated")


def members(keys: DataFrame, h: Column, n: int) -> Bloom:
    """Filter of ``n`` keys."""
    bits, parts = size_for(n)
    return _words(_each_cell(keys, h, bits, parts), bits, parts, "bloom-members")


def tested(df: DataFrame, bloom: Bloom, h: Column, name: str) -> DataFrame:
    """``df`` with the boolean column ``name``: whether the filter may hold the row's hash.  Part after part, each over its own rows."""
    out = None
    for part in range(bloom.parts):
        own = df if bloom.parts == 1 else df.where(_part(h, bloom.parts) == part)
        marked = _tested(own, bloom, part, h, name)
        out = marked if out is None else out.unionAll(marked)
    return out


def _tested(df: DataFrame, bloom: Bloom, part: int, h: Column, name: str) -> DataFrame:
    taken = [*df.columns]
    new = lambda stem: (taken.append(fresh(taken, stem)), taken[-1])[1]
    hashed = new("bloom_hash")
    out = df.withColumn(hashed, h)
    hits = []
    for cell in _cells(F.col(hashed), bloom.bits):
        at, word, bits = new("bloom_cell"), new("bloom_word"), new("bloom_bits")
        words = F.broadcast(bloom.words.where(F.col("part") == part).select(F.col("word").alias(word), F.col("bits").alias(bits)))
        out = out.withColumn(at, cell)
        out = out.join(words, F.shiftright(at, 6) == F.col(word), "left")
        hits.append(F.coalesce(F.getbit(bits, F.col(at).bitwiseAND(F.lit(63).cast("long"))) == 1, F.lit(False)))
    return out.select(*quoted(df.columns), (hits[0] & hits[1]).alias(name))


def split(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the keys, rows that have none); ``keys`` is a written table."""
    on = [on] if isinstance(on, str) else list(on)
    bloom = members(keys, F.xxhash64(*on), keys.count())
    maybe = fresh(df.columns, "bloom_maybe")
    marked = tested(df, bloom, F.xxhash64(*on), maybe)
    return tuple(marked.where(c).select(*quoted(df.columns)) for c in (F.col(maybe), ~F.col(maybe)))


def anti_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` without a key in ``keys`` (a written table).  Only rows that the filter lets
    through are shuffled, the others stay where they are."""
    maybe, rest = split(df, keys, on)
    gone = fresh(df.columns, "gone_key")
    out = maybe.join(keys.select(F.col(on).alias(gone)).distinct(), F.col(on) == F.col(gone), "left_anti")
    return out.select(*quoted(df.columns)).unionByName(rest)
