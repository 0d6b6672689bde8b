"""Arrow columns of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usual_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors, the longer of two as frequent; 0 if there are none."""
    sizes = df.select(F.size(F.col(vector)).alias("size")).where("size > 0").groupBy("size").count()
    top = sizes.orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return top[0]["size"] if top else 0


def finite_rows(column, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their vectors as doubles) of those that have ``length`` entries, all of them finite numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), length), False).to_numpy(zero_copy_only=False))
    entries = column.take(pa.array(at)).flatten().cast(pa.float64())
    found = entries.to_numpy(zero_copy_only=False).reshape(len(at), length)  # a NULL is NaN here
    good = np.isfinite(found).all(axis=1)
    return at[good], found[good]


def floored(vectors: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * entry) as integers; entries beyond ``limit`` would not stay exact and are refused."""
    out = np.floor(scale * vectors)
    if len(out) and np.abs(out).max() > limit:
        raise ValueError(f"an entry of {np.abs(vectors).max()} is too large for exact sums: at most {limit // scale}")
    return out.astype(np.int64)
