"""Benchmark decontamination over a distributed positional inverted index (operator 10).

``build_index`` stores the postings of all training words: documents are cut into segments (runs of documents of
about ``BLOCK_BYTES`` of text), and a segment's row has its distinct word hashes, how many postings each has, and the
positions, sorted by word and place.  Positions run over the segment; documents are set apart by a gap, so no phrase
crosses them.  Postings never leave their segment: no shuffle, and no list of a frequent word meets in one task.

``search`` matches every window of the test items against every segment: windows with a word that the segment
lacks are dropped at once; the others start from the postings of their rarest word there, moved back by its
place in the window, and are intersected with the other words' lists, next rarest first.  What is left are
exact phrase matches.  ``proximity`` instead keeps those places of the rarest word that have each other word within a distance.

Test windows are taken in blocks of ``BLOCK_WINDOWS``, each of a bounded size and released before the next, so a benchmark of any
size does.  Windows that several items share are matched once and name the set of their items, so hits are as many as occurrences.

Defined cases: NULL and empty texts, and texts without words, have n_words 0 and no hits; items without words have no window; an item
shorter than ``window`` is one window; repeated items and items that share windows count by their distinct item_id; a NULL item_id is ignored in the
list of items but its windows hit; documents are matched row by row, repeated ones and those without an id too; an empty table gives no rows, an empty benchmark no
hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm import bloom
from tabspark.llm.files import numbered, prepare, quoted, saved, scratch
from tabspark.llm.words import ALNUM, BLOCK_BYTES, U64, blocks, hash_words
from tabspark.llm.worker import lean

WINDOW = 10
BLOCK_WINDOWS = 200_000  # windows matched at a time: 8 bytes a word, 16 MB
CHUNK = 1 << 20  # places looked at together
GAP = 64  # free positions between documents; no phrase of more words is searched for

SEGMENT = "first long, ids binary, known binary, starts binary, n_words binary, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a segment: the number of its first document, unique over all segments, and arrays, little-endian (ids and
    terms 8 bytes, known, whether there is an id, 1, the others 4)."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, known = batch["id"].fill_null(0).to_numpy(), batch["id"].is_valid().to_numpy(zero_copy_only=False)
            for block in blocks(batch["text"], 2 * BLOCK_BYTES):
                h, _, _, first = hash_words(block, ALNUM)
                n_words = np.diff(first)
                starts = first[:-1] + GAP * np.arange(block.rows)
                places = np.arange(len(h)) + GAP * np.repeat(np.arange(block.rows), n_words)
                order = np.argsort(h, kind="stable")
                terms, counts = np.unique(h[order], return_counts=True)
                own = [ids[block.lo : block.hi].astype("<i8"), known[block.lo : block.hi].astype("u1"), starts.astype("<u4"), n_words.astype("<u4"), terms.astype("<u8"), counts.astype("<u4"), places[order].astype("<u4")]
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in own)], ["first", "ids", "known", "starts", "n_words", "terms", "counts", "positions"])
                row += block.rows

    return saved(source.mapInArrow(lean(index), SEGMENT), "positional-index", compression="zstd")


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, length, words): the word hashes of each distinct window of each item."""
    source = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch["item"].to_pylist()
            rows = []
            for block in blocks(batch["text"]):
                h, _, _, first = hash_words(block, ALNUM)
                for k in range(block.rows):
                    own = h[first[k] : first[k + 1]].view(np.int64)
                    if len(own):
                        length = min(window, len(own))
                        rows += [(names[block.lo + k], length, own[i : i + length].tolist()) for i in range(len(own) - length + 1)]
            for part in (rows[k : k + 5000] for k in range(0, len(rows), 5000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.int32(), pa.list_(pa.int64())))], ["item", "length", "words"])

    return source.mapInArrow(lean(windows), "item string, length int, words array<long>").distinct()


class Segment:
    """A segment's postings."""

    def __init__(self, row: dict):
        self.first = row["first"]
        kinds = {"ids": "<i8", "known": "u1", "starts": "<u4", "n_words": "<u4", "terms": "<u8", "counts": "<u4", "positions": "<u4"}
        for name, kind in kinds.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.starts = self.starts.astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.counts, dtype=np.int64)))
        #: (word number, position) as one ascending number: a list is searched without being cut out
        self.postings = (np.repeat(np.arange(len(self.terms), dtype=U64), self.counts) << U64(32)) | self.positions

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Number of each word hash in this segment, or -1."""
        if not len(self.terms):
            return np.full(words.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def rarest_first(self, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows all of whose words are here, their word places by ascending list length)."""
        used = np.arange(numbers.shape[1]) < lengths[:, None]
        here = np.flatnonzero(((numbers >= 0) | ~used).all(axis=1))
        sizes = np.where(used[here], np.diff(self.begin)[np.maximum(numbers[here], 0)] if len(self.terms) else 0, np.iinfo(np.int64).max)
        return here, np.argsort(sizes, axis=1, kind="stable")

    def starts_of(self, numbers: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index into ``numbers``, position) of every posting of these words, in chunks."""
        sizes = np.diff(self.begin)[numbers]
        total = np.concatenate(([0], np.cumsum(sizes)))
        lo = 0
        while lo < len(numbers):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + CHUNK, side="right")) - 1)
            which = np.repeat(np.arange(lo, hi), sizes[lo:hi])
            at = np.arange(total[lo], total[hi]) - total[which] + self.begin[numbers[which]]
            yield which, self.positions[at].astype(np.int64) - places[which]
            lo = hi

    def phrases(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of every exact match."""
        numbers = self.numbers(words)
        here, order = self.rarest_first(numbers, lengths)
        numbers, lengths = numbers[here], lengths[here]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if not len(here):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.arange(len(here))
        for which, start in self.starts_of(numbers[rows, order[:, 0]], order[:, 0]):
            for step in range(1, words.shape[1]):
                more = lengths[which] > step
                place = order[which, step]
                want = (np.maximum(numbers[which, place], 0).astype(U64) << U64(32)) | np.maximum(start + place, 0).astype(U64)
                at = np.minimum(np.searchsorted(self.postings, want), len(self.postings) - 1)
                ok = ~more | (self.postings[at] == want) & (start >= 0)
                which, start = which[ok], start[ok]
                if not len(which):
                    break
            found.append((here[which], start))
        return tuple(np.concatenate(x) for x in zip(*found))

    def near(self, words: np.ndarray, lengths: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest word) where each other word of the window is at most ``within`` words away, in the same document."""
        numbers = self.numbers(words)
        here, order = self.rarest_first(numbers, lengths)
        numbers, lengths = numbers[here], lengths[here]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for which, at in self.starts_of(numbers[np.arange(len(here)), order[:, 0]], np.zeros(len(here), np.int64)) if len(here) else ():
            doc = np.searchsorted(self.starts, at, side="right") - 1
            low = np.maximum(at - within, self.starts[doc])
            high = np.minimum(at + within, self.starts[doc] + self.n_words[doc].astype(np.int64) - 1)
            ok = np.ones(len(which), dtype=bool)
            for step in range(1, words.shape[1]):
                number = np.maximum(numbers[which, order[which, step]], 0).astype(U64) << U64(32)
                some = np.searchsorted(self.postings, number | high.astype(U64), side="right") > np.searchsorted(self.postings, number | low.astype(U64))
                ok &= (lengths[which] <= step) | some
            found.append((here[which[ok]], at[ok]))
        return tuple(np.concatenate(x) for x in zip(*found))


def window_sets(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct windows: number, length, words, set; items of each set).  Windows with the same items, as those of a passage
    that items share, are of one set, so a hit names its set and not each of its items."""
    windows = saved(windows, "item-windows")
    own = windows.groupBy("length", "words").agg(
        F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), F.coalesce("item", F.lit("")), F.col("item").isNull())).alias(f"x{k}") for k in (1, 2))
    )
    own = saved(own.withColumn("number", F.monotonically_increasing_id()), "windows")
    first = own.groupBy("n", "x1", "x2").agg(F.min("number").alias("set"))
    own = saved(own.join(first, ["n", "x1", "x2"]).select("number", "length", "words", "set"), "window-sets")
    leaders = own.where(F.col("number") == F.col("set")).select("length", "words", "set")
    return own, saved(windows.join(leaders, ["length", "words"]).select("set", "item"), "set-items")


def _window_blocks(windows: DataFrame, window: int, block_windows: int):
    """The windows as (words, lengths, sets) in blocks of a bounded size, one after another."""
    n = windows.count()
    count = max(1, -(-n // block_windows))
    for k in range(count):
        own = windows.where(F.pmod(F.xxhash64("number"), F.lit(count)) == k).toArrow() if count > 1 else windows.toArrow()
        words = np.zeros((own.num_rows, window), dtype=U64)
        lengths = own["length"].to_numpy().astype(np.int64)
        flat = own["words"].combine_chunks().flatten().to_numpy().view(U64) if own.num_rows else np.zeros(0, U64)
        words[np.arange(window) < lengths[:, None]] = flat
        yield words, lengths, own["set"].to_numpy().astype(np.int64)


def matches(index: DataFrame, windows: DataFrame, window: int = WINDOW, within: int | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document, written: row, id, n_words, hits: array of (first word, words, set) for each place of a distinct window.
    A block's windows are released when its hits are written, so one block is held at a time."""
    if window > GAP:
        raise ValueError(f"windows of more than {GAP} words are not supported")
    spark = index.sparkSession
    schema = "row long, id long, n_words long, hits array<struct<at: int, words: int, set: long>>"
    hit_type = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.int32()), ("set", pa.int64())]))
    parts = []
    for block in _window_blocks(windows, window, block_windows):
        shared = spark.sparkContext.broadcast(block)  # at most block_windows * (window + 2) * 8 bytes

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, lengths, sets = shared.value
            for batch in batches:
                for row in range(batch.num_rows):
                    own = Segment({c: batch[c][row].as_py() for c in batch.schema.names})
                    which, at = own.phrases(words, lengths) if within is None else own.near(words, lengths, within)
                    doc = np.searchsorted(own.starts, at, side="right") - 1
                    order = np.argsort(doc, kind="stable")
                    which, at, doc = which[order], at[order], doc[order]
                    ends = np.searchsorted(doc, np.arange(len(own.ids) + 1)).astype(np.int32)
                    flat = pa.StructArray.from_arrays(
                        [pa.array((at - own.starts[doc]).astype(np.int32)), pa.array((lengths[which] if within is None else np.ones(len(which))).astype(np.int32)), pa.array(sets[which])],
                        fields=list(hit_type.value_type),
                    )
                    for lo in range(0, len(own.ids), 1000):
                        hi = min(lo + 1000, len(own.ids))
                        hits = pa.ListArray.from_arrays(pa.array(ends[lo : hi + 1] - ends[lo]), flat.slice(ends[lo], ends[hi] - ends[lo]))
                        ids = pa.array(own.ids[lo:hi], mask=own.known[lo:hi] == 0)
                        yield pa.RecordBatch.from_arrays([pa.array(own.first + np.arange(lo, hi)), ids, pa.array(own.n_words[lo:hi].astype(np.int64)), hits.cast(hit_type)], ["row", "id", "n_words", "hits"])

        found = index.mapInArrow(lean(match), schema)
        parts.append(saved(found if not parts else found.where("size(hits) > 0"), "hits"))  # the first block has every row
        shared.unpersist()
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return saved(out.groupBy("row", "id", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits")), "hits")


def search(index: DataFrame, windows: DataFrame, window: int = WINDOW, within: int | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: id, n_words, hits: array of (first word, words, item), one for each item of a window that matches.  Exact phrases; with
    ``within``, proximity matches (first word: the place of the window's rarest word there, words: 1)."""
    own, items = window_sets(windows)
    found = matches(index, own, window, within, block_windows)
    each = found.select("row", F.explode("hits").alias("hit")).select("row", "hit.at", "hit.words", "hit.set").join(items, "set")
    hits = each.groupBy("row").agg(F.collect_list(F.struct("at", "words", "item")).alias("named"))
    none = F.from_json(F.lit("[]"), "array<struct<at: int, words: int, item: string>>")
    return found.join(hits, "row", "left").select("id", "n_words", F.coalesce("named", none).alias("hits"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Per document: ``key``, n_words, n_hit (words inside a match), n_items, items_sha256, contaminated."""
    prepare(docs.sparkSession)
    with scratch(docs.sparkSession):
        return saved(_contamination(docs, items, key, text, item_key, window), "contamination", outlives=True)


def _contamination(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, window: int) -> DataFrame:
    own, named = window_sets(item_windows(items, item_key, text, window))
    found = matches(build_index(docs, key, text), own, window)
    # words covered by the hits, in order of their first word: what each adds beyond the last covered word
    sorted_ = F.array_sort(F.transform("hits", lambda h: F.struct(h["at"].alias("at"), (h["at"] + h["words"]).alias("upto"))))
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        sorted_, start,
        lambda s, h: F.struct(
            F.greatest(s["upto"], h["upto"]).alias("upto"),
            (s["n"] + F.greatest(F.lit(0), h["upto"] - F.greatest(s["upto"], h["at"]))).cast("long").alias("n"),
        ),
        lambda s: s["n"],
    )
    sets = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["set"])))
    out = saved(found.select("id", "n_words", covered.alias("n_hit"), sets.alias("sets")), "covered")
    # documents that hit the same sets have the same items, which are put together once
    lists = out.select("sets").where("size(sets) > 0").distinct()
    items_of = lists.select("sets", F.explode("sets").alias("set")).join(named.where("item IS NOT NULL"), "set").select("sets", "item").distinct()
    names = items_of.groupBy("sets").agg(F.array_sort(F.collect_list("item")).alias("names"))
    told = names.select("sets", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256"))
    hit = out.where("size(sets) > 0").join(saved(told, "set-lists"), "sets", "left")
    every = hit.unionByName(out.where("size(sets) = 0"), allowMissingColumns=True)
    return every.select(
        F.col("id").alias(key), "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns; each row is judged by itself, whatever its id."""
    prepare(docs.sparkSession)
    with scratch(docs.sparkSession):
        rows, number = numbered(docs)
        narrow = rows.select(*(c.alias(n) for c, n in zip(quoted([number, text]), ("number", "text"))))
        found = contamination(narrow, items, "number", "text", **options).where("contaminated")
        found = saved(found.select(F.col("number").alias(number)), "contaminated", outlives=True)
    return bloom.anti_join(rows, found, number).select(*quoted(docs.columns))
