"""Quality scores by Bradley-Terry pairwise ranking (operator 9).

A linear score over text features is learnt from preference pairs: a document labelled good against one
labelled bad, by logistic loss on the difference of their features (no constant: only differences count).  A document is then
accepted if its score reaches a quantile of the training scores, the share of bad rows among them.

Features come from one pass over whole texts into a narrow table that fitting and scoring share.  The fit is
Spark ML's logistic regression over the pairs.  Every training row of the rarer class is paired with about
``PAIRS`` rows of the other: both are dealt to groups by a hash, with a number of groups that follows the counts, so no group holds more than a few rows.
Quantiles are exact up to the relative error ``ACCURACY`` of the rank.

Defined cases: NULL and empty texts have all features 0 and are scored like any other; without labelled rows of both
classes all scores are 0.5 or the only label; a row labelled more than once counts as good only if every label says so; NULL labels and NULL
ids are not learnt from; repeated rows are scored each; an empty table gives an empty result; other columns are not read, and
``keep_good`` hands them on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.llm.files import numbered, prepare, quoted, saved, scratch
from tabspark.llm.hashtable import row_sums
from tabspark.llm.words import LOWER, NOT_SPACE, U64, blocks, combine, hash_spans, mix, word_spans
from tabspark.llm.worker import lean

PAIRS = 8
ACCURACY = 1e-4
REGULARISATION = 1e-4

UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
STOP = np.zeros(256, dtype=bool)
STOP[[33, 46, 63]] = True
MARK = np.zeros(256, dtype=bool)
MARK[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = True
LINE = np.ones(256, dtype=bool)
LINE[10] = False
OTHER = ~(LETTER | DIGIT | MARK)
OTHER[[9, 10, 11, 12, 13, 32]] = False

FEATURES = [
    "words", "word_bytes", "lines", "line_words", "upper", "digits", "marks", "others", "stops", "upper_words", "other_words", "mark_words",
    "twice_words", "same_next", "same_words", "same_lines", "same_pairs", "worst_others", "worst_upper", "worst_same", "any_others", "any_upper", "any_same",
]


def repeats(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which hashes occurred before in the same row."""
    keys = mix(h + row.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    out = np.ones(len(h), dtype=bool)
    out[first] = False
    return out


def features(block) -> np.ndarray:
    """(rows, features) of a block: shares and logarithms of counts over the whole text, the worst line's shares, and
    logarithms of how much there is of each kind of noise."""
    data, offs = block.data, block.offsets
    starts, ends = word_spans(data, offs, NOT_SPACE)
    first = np.searchsorted(starts, offs)
    row = np.repeat(np.arange(block.rows), np.diff(first))
    n, size = np.maximum(np.diff(first), 1).astype(float), np.maximum(np.diff(offs), 1).astype(float)
    cum = lambda x: np.concatenate(([0], np.cumsum(x)))
    of_row, in_word = {}, {}
    for name, kind in (("upper", UPPER), ("digit", DIGIT), ("mark", MARK), ("other", OTHER), ("stop", STOP), ("letter", LETTER)):
        v = cum(kind[data])  # 8 bytes for each byte of the block: one kind at a time
        of_row[name], in_word[name] = (v[offs[1:]] - v[offs[:-1]]).astype(float), v[ends] - v[starts]
    del v
    length = (ends - starts).astype(float)
    upper_word = (in_word["upper"] >= 2) & (in_word["upper"] == in_word["letter"])
    other_word = in_word["other"] > 0
    mark_word = in_word["mark"] >= 2
    h = hash_spans(LOWER[data], starts, ends)
    next_same = np.zeros(len(h), dtype=bool)
    if len(h) > 1:
        next_same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    again = repeats(h, row)
    pairs = combine(h, 2)
    within = row[1:] == row[:-1]
    pair_again = np.zeros(len(h), dtype=bool)
    if within.any():
        pair_again[1:][within] = repeats(pairs[within], row[1:][within])
    by_row = lambda x: row_sums(x.astype(float), first)

    l_starts, l_ends = word_spans(data, offs, LINE)
    l_row = np.searchsorted(offs, l_starts, side="right") - 1
    l_first = np.searchsorted(l_starts, offs)
    lines = np.maximum(np.diff(l_first), 1).astype(float)
    line_again = repeats(hash_spans(data, l_starts, l_ends), l_row)
    l_words = np.searchsorted(starts, l_ends) - np.searchsorted(starts, l_starts)
    at = np.searchsorted(starts, l_starts)

    def worst(x: np.ndarray) -> np.ndarray:
        """The largest share among a row's lines, short lines counted as if they had five words."""
        c = cum(x)
        share = (c[at + l_words] - c[at]) / np.maximum(l_words, 5)
        out = np.zeros(block.rows)
        np.maximum.at(out, l_row, share)
        return out

    others, uppers, sames = by_row(other_word), by_row(upper_word), by_row(next_same)
    return np.column_stack([
        np.log1p(np.diff(first)), by_row(length) / n, np.log1p(np.diff(l_first)), np.log1p(np.diff(first) / lines), of_row["upper"] / size, of_row["digit"] / size,
        of_row["mark"] / size, of_row["other"] / size, of_row["stop"] / size, uppers / n, others / n, by_row(mark_word) / n,
        by_row(again) / n, sames / n, 1 - np.log1p(n - by_row(again)) / np.log1p(n), row_sums(line_again.astype(float), l_first) / lines, by_row(pair_again) / n,
        worst(other_word), worst(upper_word), worst(next_same), np.log1p(others), np.log1p(uppers), np.log1p(sames),
    ])


def feature_table(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, x) and the columns ``also``: the features of every row, written."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), *also)
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in ["id", *also])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [features(b).astype(np.float32) for b in blocks(batch["text"])]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ["id", *also]), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], ["id", *also, "x"])

    return saved(source.mapInArrow(lean(extract), f"{kinds}, x array<float>"), "quality-features")


@dataclass
class Quality:
    """A row's score is weights * x; it is accepted from ``threshold`` on, and ``scale`` makes the distance a probability."""

    weights: list[float]
    threshold: float
    scale: float

    def raw(self, x: str = "x") -> Column:
        return sum((F.get(F.col(x), k).cast("double") * w for k, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, x: str = "x") -> Column:
        z = (self.raw(x) - self.threshold) * self.scale
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def fit(table: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", pairs: int = PAIRS) -> Quality:
    """``table`` from ``feature_table``; ``labels`` holds the rows that may be learnt from."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    ys = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    rows = saved(table.join(ys, "id").select("id", "x", (F.col("y") == 1).alias("good")), "labelled-features")
    counts = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    good, bad = counts.get(True, 0), counts.get(False, 0)
    if not (good and bad):
        return Quality([0.0] * len(FEATURES), 0.0 if good == bad else (-1.0 if good else 1.0), 8.0)
    # with g groups there are good * bad / g pairs
    groups = max(1, math.ceil(max(good, bad) / pairs))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(groups)))
    better, worse = (dealt.where(c).select("group", F.col("x").alias(n)) for c, n in (("good", "better"), ("NOT good", "worse")))
    matched = better.join(worse, "group")
    ahead = matched.select(F.zip_with("better", "worse", lambda a, b: (a - b).cast("double")).alias("d"), F.lit(1.0).alias("label"))
    behind = matched.select(F.zip_with("worse", "better", lambda a, b: (a - b).cast("double")).alias("d"), F.lit(0.0).alias("label"))
    train = saved(ahead.unionAll(behind).select(array_to_vector("d").alias("features"), "label"), "preference-pairs")
    if train.isEmpty():
        return Quality([0.0] * len(FEATURES), 0.0, 8.0)
    model = LogisticRegression(fitIntercept=False, regParam=REGULARISATION, maxIter=50).fit(train)
    fitted = Quality(model.coefficients.toArray().tolist(), 0.0, 1.0)
    scored = rows.select(fitted.raw().alias("s"), "good")
    share = bad / (good + bad)
    low, high = scored.where("NOT good").approxQuantile("s", [0.5], ACCURACY)[0], scored.where("good").approxQuantile("s", [0.5], ACCURACY)[0]
    # between the last row below the quantile and the first above it
    below, above = scored.approxQuantile("s", [max(0.0, share - ACCURACY), min(1.0, share + 2 * ACCURACY)], ACCURACY)
    return Quality(fitted.weights, (below + above) / 2, 8.0 / max(high - low, 1e-9))


def score(table: DataFrame, model: Quality, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) of every row of the feature table."""
    scored = table.select(F.col("id").alias(key), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the fitted model accepts, with all their columns; each row is judged by itself, whatever its id."""
    from tabspark.llm import bloom

    prepare(docs.sparkSession)
    with scratch(docs.sparkSession):
        rows, number = numbered(docs)
        narrow = rows.select(*(c.alias(n) for c, n in zip(quoted([key, text, number]), ("id", "text", "number"))))
        table = feature_table(narrow, "id", "text", ("number",))
        found = table.where(~(fit(table, labels, key, label).score() >= 0.5))
        found = saved(found.select(F.col("number").alias(number)), "rejected", outlives=True)
    return bloom.anti_join(rows, found, number).select(*quoted(docs.columns))
