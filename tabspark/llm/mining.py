"""Hard-negative mining by segment summary filtering (operator 11).

Each vector is stored once with summaries at several ``levels``: cut into so many segments, each segment's mean and deviation
(both times the root of its length).  For two vectors, the inner product of a segment lies within the means' product plus
or minus the deviations' product, so sums over segments bound the score from both sides, the tighter the shorter the
segments.  Coarse bounds come first; only the rows and anchors of pairs that may still enter a list go on to the next level,
and what is left after the last is scored exactly, in integers.

Anchors are a stated query set, taken in blocks of at most ``BLOCK_BYTES``; a block is broadcast, every
task reads its part of all rows and keeps the first ``top`` of each list, and the lists of the tasks are merged per
anchor.  The pass over the rows runs twice a block: for the positives, then for the negatives within each positive's range.

Defined cases: a row takes no part if its id, label or vector is NULL, the vector is empty or has a NULL or non-finite entry or a
length other than the usual one (the most frequent of the table); rows with the same id are rows of their own: "other" rows are all but the
anchor's row itself, and each anchor row has lists of its own; ties go by the smaller id; an empty table, or one without anchors, gives no rows;
scaled entries beyond 2**26 are refused with a ValueError; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabspark.llm.files import prepare, saved, shared_folder
from tabspark.llm.vectors import finite_rows, floored, usual_length

SCALE, LIMIT = 256, 1 << 26
LEVELS = (1, 4, 16, 32)  # segments of a vector; the number of entries at most
BLOCK_BYTES = 16 << 20
CHUNK = 1024  # rows and anchors that are compared at a time
LOW, HIGH = -(1 << 62), 1 << 62


def summaries(x: np.ndarray, levels: tuple[int, ...]) -> np.ndarray:
    """Of each level, the means and then the deviations of the segments, times the root of the segment's length."""
    out = []
    for parts in levels:
        cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        pieces = [x[:, lo:hi].astype(float) for lo, hi in zip(cuts[:-1], cuts[1:])]
        out += [np.stack([p.mean(axis=1) * p.shape[1] ** 0.5 for p in pieces], axis=1), np.stack([p.std(axis=1) * p.shape[1] ** 0.5 for p in pieces], axis=1)]
    return np.hstack(out)


def level_columns(length: int, levels: tuple[int, ...]) -> list[tuple[slice, slice]]:
    """Where the means and the deviations of each level stand in a row of ``summaries``."""
    out, at = [], 0
    for parts in levels:
        n = min(parts, length)
        out.append((slice(at, at + n), slice(at + n, at + 2 * n)))
        at += 2 * n
    return out


def index(df: DataFrame, key: str, vector: str, label: Column, length: int, scale: int, levels: tuple[int, ...]) -> DataFrame:
    """(row, id, label, x, summary) of every row that takes part, written once; x and summary are little-endian long and double."""
    source = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = finite_rows(batch["v"], length)
            x = floored(found, scale, LIMIT)
            rows = [batch[c].take(pa.array(at)) for c in ("row", "id", "label")]
            binary = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x.astype("<i8"), summaries(x, levels).astype("<f8"))]
            yield pa.RecordBatch.from_arrays([*rows, *binary], ["row", "id", "label", "x", "summary"])

    return saved(source.where("id IS NOT NULL AND label IS NOT NULL").mapInArrow(store, "row long, id long, label long, x binary, summary binary"), "vectors")


class Vectors:
    """Rows of the index as matrices."""

    def __init__(self, table):
        self.row, self.id, self.label = (table[c].to_numpy() for c in ("row", "id", "label"))
        self.x, self.summary = (np.frombuffer(b"".join(table[c].to_pylist()), kind).reshape(len(self.id), -1) for c, kind in (("x", "<i8"), ("summary", "<f8")))
        self.x_float = self.x.astype(float)
        self.norm = float(np.sqrt((self.x_float**2).sum(axis=1).max())) if len(self.id) else 0.0


class Lists:
    """For each anchor, lists of the first ``top`` rows by (score, falling; id) with a score from ``lo`` to ``hi``: one column a list.

    ``same``: rows of the anchor's label (but not itself), or else of another label."""

    def __init__(self, anchors: Vectors, lo: np.ndarray, hi: np.ndarray, top: int, same: bool, levels: tuple[int, ...]):
        self.anchors, self.lo, self.hi, self.top, self.same = anchors, lo, hi, top, same
        self.levels = level_columns(anchors.x.shape[1], levels)
        self.scores = np.full((*lo.shape, top), LOW)
        self.ids = np.zeros((*lo.shape, top), np.int64)

    def least(self, some: slice) -> np.ndarray:
        """The score that a row needs to enter any list of each anchor."""
        return np.maximum(self.lo[some], self.scores[some, :, -1]).min(axis=1)

    def add(self, rows: Vectors) -> None:
        for lo in range(0, len(rows.id), CHUNK):
            for at in range(0, len(self.anchors.id), CHUNK):
                self.compare(rows, slice(lo, lo + CHUNK), slice(at, at + CHUNK))

    def compare(self, rows: Vectors, those: slice, some: slice) -> None:
        least, most = self.least(some), self.hi[some].max(axis=1)
        slack = 1 + 1e-12 * rows.norm * self.anchors.norm  # for the rounding of the bounds
        r, a = np.arange(len(rows.id))[those], np.arange(len(self.anchors.id))[some]
        open_ = (rows.label[r][:, None] == self.anchors.label[a]) == self.same
        if self.same:
            open_ &= rows.row[r][:, None] != self.anchors.row[a]
        for means, deviations in self.levels:
            i, j = open_.any(axis=1), open_.any(axis=0)
            r, a, open_, least, most = r[i], a[j], open_[i][:, j], least[j], most[j]
            if not len(r):
                return
            mine, theirs = rows.summary[r], self.anchors.summary[a]
            centre, spread = mine[:, means] @ theirs[:, means].T, mine[:, deviations] @ theirs[:, deviations].T + slack
            open_ &= (centre + spread >= least) & (centre - spread <= most)
        i, j = open_.any(axis=1), open_.any(axis=0)
        r, a, open_, least, most = r[i], a[j], open_[i][:, j], least[j], most[j]
        if not len(r):
            return
        if rows.norm * self.anchors.norm < 1 << 52:  # then sums of doubles are exact
            scores = (rows.x_float[r] @ self.anchors.x_float[a].T).astype(np.int64)
        else:
            scores = rows.x[r] @ self.anchors.x[a].T
        i, j = np.nonzero(open_ & (scores >= least) & (scores <= most))
        for k in range(self.lo.shape[1]):
            s = scores[i, j]
            fits = (s >= np.maximum(self.lo[a[j], k], self.scores[a[j], k, -1])) & (s <= self.hi[a[j], k])
            if fits.any():
                self.merge(k, a[j[fits]], s[fits], rows.id[r[i[fits]]])

    def merge(self, k: int, anchor: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        touched = np.unique(anchor)
        have = self.scores[touched, k] > LOW
        anchor = np.concatenate((anchor, np.repeat(touched, self.top)[have.ravel()]))
        score = np.concatenate((score, self.scores[touched, k][have]))
        id_ = np.concatenate((id_, self.ids[touched, k][have]))
        order = np.lexsort((id_, -score, anchor))
        anchor, score, id_ = anchor[order], score[order], id_[order]
        place = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
        first = place < self.top
        self.scores[anchor[first], k, place[first]] = score[first]
        self.ids[anchor[first], k, place[first]] = id_[first]

    def table(self) -> pa.RecordBatch:
        a, k, place = np.nonzero(self.scores > LOW)
        columns = {"anchor": a, "list": k, "score": self.scores[a, k, place], "id": self.ids[a, k, place]}
        return pa.RecordBatch.from_pydict({n: pa.array(c.astype(np.int64)) for n, c in columns.items()})


def searched(rows: DataFrame, block: dict, lo: np.ndarray, hi: np.ndarray, top: int, same: bool, levels: tuple[int, ...]) -> DataFrame:
    """(anchor, list, score, id, rank) of a block of anchors over all rows; each task hands on ``top`` rows a list at most."""
    sent = rows.sparkSession.sparkContext.broadcast((block, lo, hi))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, least, most = sent.value
        lists = Lists(Vectors(pa.table(anchors)), least, most, top, same, levels)
        for batch in batches:
            lists.add(Vectors(batch))
        yield lists.table()

    found = rows.mapInArrow(scan, "anchor long, list long, score long, id long")
    order = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "id")
    out = saved(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "lists")
    sent.unpersist()
    return out


def mine(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", every: int = 100, positives: int = 5, negatives: int = 5,
         low: int = 80, high: int = 100, scale: int = SCALE, levels: tuple[int, ...] = LEVELS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per anchor (rows whose id ``every`` divides), positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives score from ``low`` to ``high`` percent of their positive."""
    spark = df.sparkSession
    prepare(spark)
    length = usual_length(df, vector)
    label = F.col(label) if isinstance(label, str) else label
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not length:
        return spark.createDataFrame([], schema)
    rows = index(df, key, vector, label, length, scale, levels)
    anchors = rows.where(F.col("id") % every == 0)
    width = 8 * (length + 2 * sum(min(n, length) for n in levels))
    blocks = -(-anchors.count() * width // block_bytes)
    out = shared_folder(spark, "negatives")
    for number in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).orderBy("id", "row").toArrow()
        block = {c: own[c].combine_chunks() for c in own.column_names}
        n = own.num_rows
        near = searched(rows, block, np.full((n, 1), LOW), np.full((n, 1), HIGH), positives, True, levels).toPandas()  # n * positives rows at most
        lo, hi = np.full((n, positives), HIGH), np.full((n, positives), LOW)
        place = (near["anchor"].to_numpy(), near["rank"].to_numpy() - 1)
        score = near["score"].to_numpy()
        lo[place], hi[place] = -(-low * score // 100), high * score // 100
        ids, scores = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)
        ids[place], scores[place] = near["id"].to_numpy(), score
        far = searched(rows, block, lo, hi, negatives, False, levels)
        anchor_id = own["id"].to_numpy()
        a, k = np.nonzero(hi > LOW)
        named = spark.createDataFrame(pa.table({"anchor": a, "list": k, "anchor_id": anchor_id[a], "positive_id": ids[a, k], "positive_score": scores[a, k]}))
        told = far.join(named, ["anchor", "list"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        told.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out) if blocks else spark.createDataFrame([], schema)
