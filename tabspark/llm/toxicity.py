"""Toxicity by class-conditional Kneser-Ney models (operator 7).

Two models read words letter by letter (UTF-8 bytes, lower case, from a word's first byte to its end): one learnt from toxic, one
from ordinary texts.  Each discounts its own counts of runs of ``ORDER`` bytes and backs off to a modified Kneser-Ney model that both
share: the pooled counts, interpolated with lower orders of continuation counts (in how many kinds of context a
run occurs).  The back-off has the Kneser-Ney mass and ``STRENGTH`` observations more, so an expression that a class has hardly seen
is read by both models alike and does not count as evidence.

Most words of a toxic text are ordinary ones, so its likelihood takes each word from the toxic model with the rate ``RATE`` and from the
ordinary model otherwise.  A text's evidence is the difference of the toxic and the ordinary log-likelihood, a word: the mean
over its words of log(1 - RATE + RATE * P(word | toxic) / P(word | ordinary)).  A logistic curve in that mean, the total and the
number of words, fitted on training rows that the counts were not taken from, makes it a probability.

Counting is a Spark job over the training rows; the counts are grouped before the shuffle.  The labelled rows to learn
from are bounded: at most about ``max_rows`` of each class, chosen by a hash of their id (a Bernoulli sample;
all if there are fewer).  Where that keeps the classes at different rates, the rows of the curve weigh 1 / rate of their class, and so do the
counts that the shared model pools, so the scores have the level of all labelled rows, whatever ``max_rows`` is.  Scoring
covers every row and whole texts.

Defined cases: NULL and empty texts and texts without words have the evidence 0 and get the score of the prior; without labelled rows of both
classes every score is 0.5 or the only label; a row labelled more than once counts as toxic if any label says so; NULL labels and NULL ids are
not learnt from; repeated rows are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.files import prepare, saved
from tabspark.llm.hashtable import WordValues, row_sums
from tabspark.llm.words import ALNUM, LOWER, U64, blocks, hash_words

ORDER = 6  # bytes of a run: five of context and the next
STRENGTH = 5.0  # observations that the shared model counts as, besides the discounted mass
RATE = 0.01  # share of a toxic text's words that the toxic model is to explain
MAX_ROWS = 40_000
CALIBRATION = 0.2  # share of the training rows kept for the curve


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, word of each): for each byte of each word and its end, the last ``order`` bytes up to there as one number.
    Before a word's first byte, and at its end, stands a space."""
    sizes = ends - starts + 1
    word = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded = np.append(data, np.uint8(32))
    codes = np.zeros(len(word), dtype=U64)
    for back in range(order - 1, -1, -1):
        at = within - back
        own = (at >= 0) & (at < sizes[word] - 1)
        byte = np.where(own, padded[np.where(own, starts[word] + at, 0)], 32)
        codes = (codes << U64(8)) | byte.astype(U64)
    return codes, word


def _tail(code, n: int):
    """The last ``n`` bytes of a run, as SQL."""
    return F.expr(f"{code} & {(1 << 8 * n) - 1}L")


@dataclass
class Level:
    """Runs of one order, ascending, with their counts, and per context the total and kinds of what follows."""

    runs: np.ndarray
    counts: list[np.ndarray]
    contexts: np.ndarray
    totals: list[np.ndarray]
    discounts: list[tuple[float, float, float]]
    weights: list[np.ndarray]
    scale: np.ndarray | None  # of the last counts: what an observation of each run stands for, if not one

    @classmethod
    def of(cls, runs: np.ndarray, counts: list[np.ndarray], scale: np.ndarray | None = None) -> Level:
        order = np.argsort(runs)
        runs, counts = runs[order], [c[order].astype(np.float64) for c in counts]
        scale = None if scale is None else scale[order]
        contexts, first = np.unique(runs >> U64(8), return_index=True)
        group = np.append(first, len(runs))
        totals, discounts, weights = [], [], []
        for k, c in enumerate(counts):
            ones, twos, threes, fours = (max(1, int((c == k).sum())) for k in (1, 2, 3, 4))
            y = ones / (ones + 2 * twos)
            # modified Kneser-Ney discounts of counts 1, 2 and more, kept inside their ranges
            d = tuple(float(np.clip(x, 0.1, upto - 0.05)) for upto, x in ((1, 1 - 2 * y * twos / ones), (2, 2 - 3 * y * threes / twos), (3, 3 - 4 * y * fours / threes)))
            # what is discounted depends on the observations, what it stands for on the scale
            each = 1.0 if scale is None or k < len(counts) - 1 else scale
            total = row_sums(c * each, group)
            gone = d[0] * row_sums((c == 1) * each, group) + d[1] * row_sums((c == 2) * each, group) + d[2] * row_sums((c >= 3) * each, group)
            totals.append(total)
            discounts.append(d)
            weights.append(np.where(total > 0, gone / np.maximum(total, 1), 1.0))
        return cls(runs, counts, contexts, totals, discounts, weights, scale)

    def probability(self, k: int, codes: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """P(last byte | the others) by model ``k``, interpolated with ``lower``."""
        here = self._find(self.runs, codes)
        c = self.counts[k][here] * (self._found(self.runs, codes))
        at, known = self._find(self.contexts, codes >> U64(8)), self._found(self.contexts, codes >> U64(8))
        d = self.discounts[k]
        taken = np.where(c == 0, 0.0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))
        total = self.totals[k][at]
        known = known & (total > 0)
        each = self.scale[here] if self.scale is not None and k == len(self.counts) - 1 else 1.0
        return np.where(known, np.maximum(c - taken, 0) * each / np.maximum(total, 1) + self.weights[k][at] * lower, lower)

    def apart(self, k: int, codes: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """P(last byte | the others) by class ``k``, backed off to the ``shared`` model of the same order."""
        c = self.counts[k][self._find(self.runs, codes)] * self._found(self.runs, codes)
        at, known = self._find(self.contexts, codes >> U64(8)), self._found(self.contexts, codes >> U64(8))
        d = self.discounts[k]
        taken = np.where(c == 0, 0.0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))
        total = self.totals[k][at] * known
        return (c - taken + (self.weights[k][at] * total + STRENGTH) * shared) / (total + STRENGTH)

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(keys, x), len(keys) - 1)

    @classmethod
    def _found(cls, keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        return keys[cls._find(keys, x)] == x


class ClassModels:
    """levels: orders 1 to ``ORDER``; the last has the counts of toxic, ordinary and all texts, the others continuation counts."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """log(1 - RATE + RATE * P(word | toxic) / P(word | ordinary)) of each word."""
        if not words:
            return np.zeros(0)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        codes, word = runs_of(data, ends - [len(w) for w in words], ends, len(self.levels))
        kinds, back = np.unique(codes, return_inverse=True)
        p = np.full(len(kinds), 1 / 256)
        for n, level in enumerate(self.levels[:-1], 1):
            p = level.probability(0, kinds & U64((1 << 8 * n) - 1), p)
        top = self.levels[-1]
        shared = top.probability(2, kinds, p)
        ratio = np.log(top.apart(0, kinds, shared) / top.apart(1, kinds, shared))
        return np.log(1 - RATE + RATE * np.exp(np.minimum(np.bincount(word, weights=ratio[back], minlength=len(words)), 50)))


@dataclass
class Toxicity:
    models: ClassModels | None
    curve: tuple[float, ...]  # weights of the mean evidence, of the total and of the words (both as signed logarithms), and the constant


def _evidence(source: DataFrame, models) -> DataFrame:
    """(id, label if given, evidence, words) of each row."""
    extra = [c for c in source.columns if c not in ("id", "text")]
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in ["id", *extra])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = WordValues(models.value.evidence) if models is not None else None
        for batch in batches:
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for block in blocks(batch["text"]):
                h, starts, ends, first = hash_words(block, ALNUM)
                count[block.lo : block.hi] = np.diff(first)
                if values is not None:
                    total[block.lo : block.hi] = row_sums(values.of(h, LOWER[block.data], starts, ends), first)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ["id", *extra]), pa.array(total / np.maximum(count, 1)), pa.array(count)], ["id", *extra, "evidence", "words"])

    return source.mapInArrow(score, f"{kinds}, evidence double, words long")


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int) -> tuple[DataFrame, tuple[float, float]]:
    """(id, text, y, share): a bounded sample of the training rows; share, a hash of the id, is uniform on [0, 1).
    With it, how many rows one of the sample stands for, if it is ordinary and if it is toxic."""
    ys = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = {r["y"]: r["count"] for r in ys.groupBy("y").count().collect()}
    uniform = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    toxic, ordinary = (min(1.0, max_rows / max(1, m)) for m in (n.get(1, 0), sum(v for k, v in n.items() if k != 1)))
    chosen = saved(ys.where(uniform(1) < F.when(F.col("y") == 1, toxic).otherwise(ordinary)).withColumn("share", uniform(2)), "label-sample")
    # at most about 2 * max_rows rows of 20 bytes
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id"), (1 / ordinary, 1 / toxic)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, order: int = ORDER) -> Toxicity:
    """``labels`` holds the rows that may be learnt from."""
    spark = docs.sparkSession
    prepare(spark)
    sample, stands_for = _labelled(docs, labels, key, text, label, max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y in (0, 1):
                own = batch.filter(pa.array(batch["y"].to_numpy() == y))
                for block in blocks(own["text"]):
                    _, starts, ends, _ = hash_words(block, ALNUM)
                    codes, n = np.unique(runs_of(LOWER[block.data], starts, ends, order)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n * y), pa.array(n * (1 - y))], ["run", "toxic", "ordinary"])

    counted = sample.where(F.col("share") >= CALIBRATION).select("text", "y").mapInArrow(count, "run long, toxic long, ordinary long")
    top = saved(counted.groupBy("run").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "class-runs")
    classes = top.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not (classes[0] and classes[1]):
        only = sample.agg(F.avg(F.col("y").cast("double"))).first()[0]
        return Toxicity(None, (0.0, 0.0, 0.0, 0.0 if only is None or 0 < only < 1 else (8.0 if only else -8.0)))
    # below the top, a run's count is the number of kinds of bytes before it
    tables, runs = [], top.select("run")
    for n in range(order - 1, 0, -1):
        longer = runs if n == order - 1 else tables[0].select("run")
        tables.insert(0, saved(longer.groupBy(_tail("run", n).alias("run")).agg(F.count("*").alias("kinds")), "continuations"))
    arrays = [t.toArrow() for t in tables]  # bounded by the runs of the bounded sample
    levels = [Level.of(t["run"].to_numpy().view(U64), [t["kinds"].to_numpy()]) for t in arrays]
    last = top.toArrow()
    toxic, ordinary = last["toxic"].to_numpy(), last["ordinary"].to_numpy()
    pooled, of_ordinary, of_toxic = toxic + ordinary, *(w / min(stands_for) for w in stands_for)
    scale = None if of_ordinary == of_toxic else (toxic * of_toxic + ordinary * of_ordinary) / pooled
    levels.append(Level.of(last["run"].to_numpy().view(U64), [toxic, ordinary, pooled], scale))
    models = ClassModels(levels)

    shared = spark.sparkContext.broadcast(models)
    seen = _evidence(sample.where(F.col("share") < CALIBRATION).select("id", "text", "y"), shared).select("y", "evidence", "words").toArrow()
    mean, words = seen["evidence"].to_numpy(), seen["words"].to_numpy()
    x = np.column_stack([mean, np.sign(mean) * np.log1p(np.abs(mean) * words), np.log1p(words), np.ones(seen.num_rows)])
    y = (seen["y"].to_numpy() == 1).astype(float)
    return Toxicity(models, logistic_curve(x, y, np.where(y == 1, stands_for[1], stands_for[0])))


def logistic_curve(x: np.ndarray, y: np.ndarray, times: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> tuple[float, ...]:
    """Newton steps for a logistic regression with a little ridge; x: a handful of columns; each row counts ``times``."""
    w = np.zeros(x.shape[1])
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9) if len(x) else np.ones(x.shape[1])
    z = x / scale
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = z.T @ (z * (times * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (times * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
    return tuple((w / scale).tolist())


def score(docs: DataFrame, model: Toxicity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted, evidence) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(model.models) if model.models is not None else None
    by_mean, by_total, by_length, constant = model.curve
    seen = _evidence(source, shared)
    total = F.signum("evidence") * F.log1p(F.abs("evidence") * F.col("words"))
    z = F.col("evidence") * by_mean + total * by_total + F.log1p("words") * by_length + constant
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return seen.select(F.col("id").alias(key), p.alias("score"), F.when(p >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")
