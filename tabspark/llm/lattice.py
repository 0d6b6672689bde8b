"""Document likelihood over a subword lattice (operator 6).

A public piece vocabulary (BPE: no unigram one with scores is at hand) spans a lattice over each word (its bytes after a space that marks its beginning): every way to cut
the word into pieces is a path, and a byte that no piece of its own covers is one.  The vocabulary's
scores, its ranks, give the pieces' first weights; rounds of expectation maximisation over the distinct words of all training
texts refine them (each word weighs what its count is discounted by, the same for all: that mass is what the lattice has to spread).  A word's subword probability is the sum over all paths,
by a forward recursion in log space, so no segmentation is singled out.

Each training word is also one whole piece beside the lattice, with its discounted count: P(word) =
max(c - D, 0) / N + D * V / N * (sum over paths), D = n1 / (n1 + 2 n2) from the numbers of words that occur once and twice.  The
end of a text is a token that only counts.  A document's probability is the product over its words and its end.

Counting, the rounds and the lookup of counts are Spark jobs: a word's counts are added up before the shuffle, frequent
words (at least N / ``FREQUENT`` occurrences, so at most ``FREQUENT`` of them) are broadcast, and only the
rest is joined by word.  The driver gets the pieces' weights, whose number is the vocabulary's.

Defined cases: NULL and empty texts have the end token only; without training texts every count is 0, and words have the probability of the lattice with the vocabulary's own weights; repeated
rows are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.files import prepare, saved
from tabspark.llm.hashtable import Slots, WordValues, row_sums
from tabspark.llm.words import LOWER, NOT_SPACE, U64, blocks, hash_words, mix

ROUNDS = 2
FREQUENT = 4_000_000  # bound of the words that are broadcast, 16 bytes each
HELD_WORDS = 500_000  # words that a task counts before it hands them on
BATCH = 8192
CLASSES = np.array([6, 8, 10, 12, 16, 20, 24, 32, 48, 64])


BASE = 0x9E3779B97F4A7C15  # of the hashes of pieces, which are far shorter than the words that such hashes confuse; odd, so it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def span_hash(prefix: np.ndarray, last: np.ndarray, back: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of spans from sums of (byte + 1) * BASE**place: up to their first byte, up to their end, and INVERSE**(first place)."""
    return Slots.nonzero(mix((last - prefix) * back + size.astype(U64) * U64(0xA24BAED4963EE407)))


class Lattice:
    """The pieces of a vocabulary file, with the log weight of each."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[bytes, int] = {}
        for k in range(model.get_piece_size()):
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
                piece = model.id_to_piece(k).replace("▁", " ").encode()
                if b" " not in piece[1:]:
                    pieces.setdefault(piece, len(pieces))
        # the score of a piece falls with its rank; weights as if by Zipf's law, and a single byte of its own last
        ranked = len(pieces)
        for b in range(256):
            pieces.setdefault(bytes([b]), len(pieces))
        weight = 1.0 / (10.0 + np.arange(len(pieces)))
        weight[ranked:] = 1e-3 / len(pieces)
        self.n = len(pieces)
        self.longest = max(map(len, pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate(([0], ends[:-1]))
        prefix = np.concatenate(([U64(0)], np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, len(data)))))
        h = span_hash(prefix[starts], prefix[ends], powers(INVERSE, len(data))[starts], ends - starts)
        self.table = Slots(1 << (4 * self.n).bit_length())
        self.table.insert(h, np.arange(self.n, dtype=np.int32))
        self.weights = np.log(weight / weight.sum())

    def _grids(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which words, their bytes after a space, padded, and their lengths with it) in batches of similar length."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        width = lengths.copy()
        short = lengths <= CLASSES[-1]
        width[short] = CLASSES[np.searchsorted(CLASSES, lengths[short])]
        for n in np.unique(width):
            own = np.flatnonzero(width == n)
            step = max(1, min(BATCH, (1 << 18) // int(n)))
            for which in (own[k : k + step] for k in range(0, len(own), step)):
                grid = np.frombuffer(b"".join(b" " + words[k] + b"\0" * (int(n) - len(words[k]) - 1) for k in which), np.uint8)
                yield which, grid.reshape(len(which), int(n)), lengths[which]

    def _arcs(self, grid: np.ndarray) -> list[np.ndarray]:
        """For each end j = 1 .. n: the piece from each of the last ``longest`` begins to j, or -1."""
        rows, n = grid.shape
        prefix = np.zeros((rows, n + 1), dtype=U64)
        np.cumsum((grid.astype(U64) + U64(1)) * powers(BASE, n), axis=1, out=prefix[:, 1:])
        back = powers(INVERSE, n + 1)
        out = []
        for j in range(1, n + 1):
            lo = max(0, j - self.longest)
            h = span_hash(prefix[:, lo:j], prefix[:, j : j + 1], back[lo:j], j - np.arange(lo, j))
            out.append(self.table.find(h.ravel()).reshape(rows, j - lo).astype(np.int32))
        return out

    def _forward(self, arcs: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
        """log of the sum over all paths up to each place; ``weights`` ends with -inf, for no piece."""
        rows, n = arcs[0].shape[0], len(arcs)
        alpha = np.zeros((rows, n + 1))
        for j, pieces in enumerate(arcs, 1):
            terms = alpha[:, j - pieces.shape[1] : j] + weights[pieces]
            top = terms.max(axis=1)
            alpha[:, j] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
        return alpha

    def log_probability(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        open_ = np.append(weights, -np.inf)
        for which, grid, lengths in self._grids(words):
            alpha = self._forward(self._arcs(grid), open_)
            out[which] = alpha[np.arange(len(which)), lengths]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """How often each piece is used, in expectation over all paths, when each word occurs ``counts`` times."""
        total = np.zeros(self.n)
        open_ = np.append(weights, -np.inf)
        for which, grid, lengths in self._grids(words):
            arcs = self._arcs(grid)
            alpha = self._forward(arcs, open_)
            rows, n = grid.shape
            whole = alpha[np.arange(rows), lengths]
            beta = np.where(np.arange(n + 1) == lengths[:, None], 0.0, -np.inf)
            times = counts[which].astype(float)
            for i in range(n - 1, -1, -1):
                ends = range(i + 1, min(n, i + self.longest) + 1)
                pieces = np.column_stack([arcs[j - 1][:, i - (j - arcs[j - 1].shape[1])] for j in ends])
                terms = open_[pieces] + beta[:, i + 1 : i + 1 + len(ends)]
                top = np.maximum(terms.max(axis=1), -1e300)
                here = top + np.log(np.maximum(np.exp(terms - top[:, None]).sum(axis=1), 1e-300))
                used = np.exp(np.minimum(terms + (alpha[:, i] - whole)[:, None], 0.0)) * times[:, None]
                live = np.isfinite(terms)
                total += np.bincount(pieces[live], weights=used[live], minlength=self.n)
                beta[:, i] = np.where(i < lengths, here, beta[:, i])
        return total


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


@dataclass
class Model:
    """What training gathered: words (h, word, c), written; tokens, kinds and texts; the discount; log weights of the pieces."""

    path: str
    words: DataFrame
    tokens: int
    kinds: int
    texts: int
    discount: float
    weights: np.ndarray

    @property
    def back_off(self) -> float:
        return self.discount * self.kinds / self.tokens if self.tokens else 1.0


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, word, c): how often each word occurs in all texts, written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, n, table = [], np.zeros(2 * HELD_WORDS, np.int64), 0, Slots(1 << 21)

        def handed() -> Iterator[pa.RecordBatch]:
            for lo in range(0, n, 20_000):
                part = slice(lo, min(n, lo + 20_000))
                hs, ws = zip(*held[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(hs, U64).view(np.int64)), pa.array(ws, pa.binary()), pa.array(counts[part])], ["h", "word", "c"])

        for batch in batches:
            for block in blocks(batch["text"]):
                h, starts, ends, _ = hash_words(block, NOT_SPACE)
                new, first, times = np.unique(Slots.nonzero(h), return_index=True, return_counts=True)
                if n and n + len(new) > HELD_WORDS:
                    yield from handed()
                    held, n, table = [], 0, Slots(1 << 21)
                if n + len(new) > len(counts):
                    counts, table = np.zeros(2 * len(new), np.int64), Slots(1 << (4 * len(new)).bit_length())
                at = table.find(new)
                counts[at[at >= 0]] += times[at >= 0]
                fresh = np.flatnonzero(at < 0)
                table.insert(new[fresh], np.arange(n, n + len(fresh), dtype=np.int32))
                counts[n : n + len(fresh)] = times[fresh]
                raw, where = LOWER[block.data].tobytes(), first[fresh]
                held += [(k, raw[s:e]) for k, s, e in zip(new[fresh].tolist(), starts[where].tolist(), ends[where].tolist())]
                n += len(fresh)
        yield from handed()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "h long, word binary, c long")
    return saved(counted.groupBy("h", "word").agg(F.sum("c").alias("c")), "word-counts")


def fit(docs: DataFrame, vocabulary: str, text: str = "text", rounds: int = ROUNDS) -> Model:
    """Learn from every row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    words = count_words(docs, text)
    texts = docs.count()
    row = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    kinds, tokens = row[0] + (texts > 0), row[1] + texts
    discount = min(0.95, max(0.05, row[2] / max(1, row[2] + 2 * row[3])))
    weights = lattice(vocabulary).weights
    for _ in range(rounds if row[0] else 0):
        shared = spark.sparkContext.broadcast(weights)  # one number a piece

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = lattice(vocabulary)
            total = np.zeros(own.n)
            for batch in batches:
                total += own.expected(batch["word"].to_pylist(), np.ones(batch.num_rows), shared.value)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "used"])

        found = words.select("word").mapInArrow(expect, "piece long, used double").groupBy("piece").agg(F.sum("used").alias("used")).toArrow()
        used = np.full(len(weights), 0.01)
        used[found["piece"].to_numpy()] += found["used"].to_numpy()
        weights = np.log(used / used.sum())
    return Model(vocabulary, words, tokens, kinds, texts, discount, weights)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, n_known, train_tokens, base_score (add-one word unigram) and score, both log10."""
    spark = docs.sparkSession
    prepare(spark)
    floor = max(1, math.ceil(model.tokens / FREQUENT))
    top = model.words.where(F.col("c") >= floor).select("h", "c").toArrow()  # at most FREQUENT rows
    shared = spark.sparkContext.broadcast((top["h"].to_numpy().view(U64), top["c"].to_numpy(), model.weights))
    n, back_off, discount, path = max(1, model.tokens), model.back_off, model.discount, model.path
    least = math.log10(model.tokens + model.kinds + 1)
    end = (model.texts, max(model.texts - discount, 0) / n)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, counts, weights = shared.value
        own = lattice(path)
        known = Slots(1 << max(8, (4 * len(keys)).bit_length()))
        known.insert(keys, np.arange(len(keys), dtype=np.int32))
        counts = np.append(counts.astype(float), 0.0)
        values = WordValues(lambda words: own.log_probability(words, weights))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in blocks(batch["text"]):
                h, starts, ends, first = hash_words(block, NOT_SPACE)
                h = Slots.nonzero(h)
                log_p = values.of(h, LOWER[block.data], starts, ends)
                at = known.find(h)
                c = counts[at]
                p = np.maximum(c - discount, 0) / n + back_off * np.exp(log_p)
                # a word whose paths are all too small for a number: its logarithm alone
                value = np.where(p > 1e-290, np.log10(np.maximum(p, 1e-300)), math.log10(back_off) + log_p / math.log(10))
                of_row = [np.diff(first) + 1, row_sums((at >= 0) * 1.0, first).astype(np.int64), row_sums(np.log10(c + 1), first), row_sums(value, first)]
                rows = row + np.arange(block.rows)
                row += block.rows
                whole = pa.StructArray.from_arrays([batch["id"].slice(block.lo, block.rows), pa.array(of_row[0]), pa.array(of_row[1]), pa.array(of_row[2]), pa.array(of_row[3])], ["id", "n_tokens", "n_known", "base", "value"])
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(mix(rows.astype(U64)).view(np.int64)), pa.nulls(len(rows), pa.float64()), whole], ["row", "h", "log_p", "whole"])
                rare = np.flatnonzero(at < 0)
                who = np.repeat(rows, np.diff(first))[rare]
                for part in (slice(k, k + 20_000) for k in range(0, len(rare), 20_000)):
                    k = rare[part]
                    yield pa.RecordBatch.from_arrays([pa.array(who[part]), pa.array(h[k].view(np.int64)), pa.array(log_p[k]), pa.nulls(len(k), whole.type)], ["row", "h", "log_p", "whole"])

    whole = f"struct<id: {kind}, n_tokens: long, n_known: long, base: double, value: double>"
    rows = source.mapInArrow(tokens, f"row long, h long, log_p double, whole {whole}")
    rare_words = model.words.where(F.col("c") < floor).select("h", "c")
    joined = rows.join(rare_words, "h", "left")
    hit = F.col("log_p").isNotNull() & F.col("c").isNotNull()
    low = F.lit(math.log10(back_off)) + F.col("log_p") / math.log(10)
    p = F.greatest(F.col("c") - discount, F.lit(0.0)) / n + back_off * F.exp("log_p")
    more = F.when(hit, F.when(p > 1e-290, F.log10(p)).otherwise(low) - low)
    sums = joined.groupBy("row").agg(
        F.max("whole.id").alias("id"), F.max("whole.n_tokens").alias("n_tokens"), F.sum("whole.n_known").alias("seen"), F.sum("whole.base").alias("base"), F.sum("whole.value").alias("value"),
        F.count_if(hit).alias("hits"), F.sum(F.when(hit, F.log10(F.col("c") + 1))).alias("base_more"), F.sum(more).alias("more"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ended = math.log10(end[1]) if end[1] > 0 else 0.0
    return sums.select(
        F.col("id").alias(key), "n_tokens", (F.col("seen") + F.col("hits") + int(end[0] > 0)).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (zero("base") + zero("base_more") + math.log10(end[0] + 1) - F.col("n_tokens") * least).alias("base_score"), (zero("value") + zero("more") + ended).alias("score"),
    )
