"""Reusable column expressions.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it stays
inside whole-stage codegen; no Python UDF is used anywhere in the library.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The multiplier and modulus of the Park-Miller "minimal standard"
# generator, used as a deterministic, overflow-free shuffle key for folds and samples.
LCG_MULTIPLIER = 48271
LCG_MODULUS = 2147483647


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_float(c: str | Column) -> Column:
    """float32 output contract of engineered features."""
    return col_(c).cast("float")


def safe_log1p(c: str | Column, clip_lower: float = 0.0) -> Column:
    """log1p(max(x, clip_lower)); NULL stays NULL (``greatest`` alone would turn NULL into the floor)."""
    x = col_(c).cast("double")
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(float(clip_lower)))))


def safe_ratio(num: str | Column, den: str | Column, eps: float = 1e-6) -> Column:
    """num / (den + eps), NULL instead of an ANSI division error when the denominator is exactly 0."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double") + F.lit(float(eps)))


def fold_order_key(row_id: str | Column, seed: int) -> Column:
    """Seeded pseudo-random order key: ((row_id mod M) * A + seed) mod M.

    Plain 64-bit integer arithmetic, so any SQL engine reproduces it exactly.
    """
    r = F.pmod(col_(row_id).cast("bigint"), F.lit(LCG_MODULUS))
    return F.pmod(r * F.lit(LCG_MULTIPLIER) + F.lit(int(seed)), F.lit(LCG_MODULUS))


def left_closed_bin(c: str | Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Bin into [e_i, e_{i+1}); values outside [e_0, e_last) (and NULL) give NULL."""
    x = col_(c)
    if labels is None:
        labels = [f"[{edges[i]}, {edges[i + 1]})" for i in range(len(edges) - 1)]
    if len(labels) != len(edges) - 1:
        raise ValueError("need exactly len(edges) - 1 labels")
    expr = None
    for i in range(len(edges) - 1):
        cond = (x >= F.lit(float(edges[i]))) & (x < F.lit(float(edges[i + 1])))
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    return expr


def renorm_array(p: str | Column) -> Column:
    """Row-wise L1 normalisation of an array<double>; a zero-sum row is returned unchanged."""
    arr = col_(p)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(total == 0, arr).otherwise(F.transform(arr, lambda x: x / total))


def argmax_index(p: str | Column) -> Column:
    """0-based index of the first maximum of an array."""
    arr = col_(p)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def bias_corrected_skewness(g1: Column, n: Column) -> Column:
    """Adjusted Fisher-Pearson skewness G1 = g1 * sqrt(n(n-1)) / (n-2); NULL if n < 3."""
    nd = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(nd * (nd - 1)) / (nd - 2))


def bias_corrected_kurtosis(g2: Column, n: Column) -> Column:
    """Unbiased excess kurtosis G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6); NULL if n < 4."""
    nd = n.cast("double")
    return F.when(n >= 4, (nd - 1) / ((nd - 2) * (nd - 3)) * ((nd + 1) * g2 + 6))
