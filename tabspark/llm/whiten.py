"""Embedding whitening by spectrum slicing (operator 13).

One pass sums the integer vectors and their products, exactly; only ``d * (d + 1) / 2`` totals reach the driver, whatever
the number of rows.  There the covariance is sliced: an LDLᵀ factorisation with symmetric pivoting of the covariance less
a shift has as many positive pivots as there are eigenvalues above the shift (Sylvester), so bisection by counts
isolates each leading eigenvalue; Rayleigh quotient iteration from inside its slice converges to the pair, and two more counts on
either side of the value certify its number.  Eigenvalues closer together than ``CLOSE`` of the norm are sliced within
their common subspace.  A second pass projects every row.

Defined cases: a row takes no part if its vector is NULL or empty, or has a NULL or non-finite entry, or a length other
than the usual one (the most frequent of the table); a NULL id and repeated ids are kept, row by row; equal rows get equal values; where the
covariance has fewer positive eigenvalues than ``components``, only those are returned (an empty table, one row or equal
rows: no rows); ``deviation`` is NULL where it exceeds a long; entries whose scaled value exceeds 2**52 are refused with a ValueError; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.files import prepare, saved
from tabspark.llm.vectors import finite_rows, floored, usual_length

SCALE, LIMIT = 1024, 1 << 52
CLOSE = 1e-8  # of the norm: slices no wider than this; closer eigenvalues share a subspace
EPS = np.finfo(float).eps
GROWTH = (1 + 17**0.5) / 8  # bound of element growth in pivoting


def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues greater than ``shift``: positive pivots of LDLᵀ = matrix - shift, with 1x1 and 2x2 pivots."""
    rest, positive = matrix - shift * np.eye(len(matrix)), 0
    while len(rest):
        size = np.abs(rest)
        diagonal = size.diagonal()
        r = int(diagonal.argmax())
        one = diagonal[r]
        np.fill_diagonal(size, 0)
        p, q = divmod(int(size.argmax()), len(rest))
        if one == size[p, q] == 0:
            break
        lead = [r] if one >= GROWTH * size[p, q] else [p, q]
        others = np.delete(np.arange(len(rest)), lead)
        pivot, side = rest[np.ix_(lead, lead)], rest[np.ix_(others, lead)]
        positive += int(pivot[0, 0] > 0) if len(lead) == 1 else 1  # a 2x2 pivot has one of either sign
        rest = rest[np.ix_(others, others)] - side @ np.linalg.solve(pivot, side.T)
    return positive


@dataclass
class Slice:
    """Eigenvalues number ``first`` to ``last`` (from 1, falling) lie in (lo, hi]."""

    first: int
    last: int
    lo: float
    hi: float


def slices(matrix: np.ndarray, wanted: int, width: float) -> list[Slice]:
    """Slices of the leading eigenvalues, ``wanted`` at least, apart by more than ``width``."""
    bound = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9) + np.finfo(float).tiny
    counts = {-bound: len(matrix), bound: 0}
    out: list[Slice] = []
    number = 1
    while number <= len(matrix):
        lo = max(s for s, n in counts.items() if n >= number)
        hi = min(s for s, n in counts.items() if n < number)
        while hi - lo > width and lo < (mid := (lo + hi) / 2) < hi:
            counts[mid] = above(matrix, mid)
            lo, hi = (mid, hi) if counts[mid] >= number else (lo, mid)
        if out and out[-1].lo - hi <= width:
            out[-1].last, out[-1].lo = number, lo
        elif number > wanted:
            break
        else:
            out.append(Slice(number, number, lo, hi))
        number += 1
    return out


def solved(matrix: np.ndarray, shift: float, right: np.ndarray, norm: float) -> np.ndarray:
    """(matrix - shift)⁻¹ right; a shift that hits an eigenvalue is moved by a rounding error."""
    eye = np.eye(len(matrix))
    try:
        out = np.linalg.solve(matrix - shift * eye, right)
    except np.linalg.LinAlgError:
        out = np.linalg.solve(matrix - (shift + 4 * EPS * norm) * eye, right)
    return out if np.isfinite(out).all() else np.linalg.solve(matrix - (shift + 64 * EPS * norm) * eye, right)


def rayleigh(matrix: np.ndarray, own: Slice, norm: float) -> tuple[float, np.ndarray]:
    """The pair of the one eigenvalue of a slice."""
    vector = np.random.Generator(np.random.PCG64(13)).standard_normal(len(matrix))
    for _ in range(2):  # inverse iteration inside the slice, then cubic convergence
        vector = solved(matrix, (own.lo + own.hi) / 2, vector / np.linalg.norm(vector), norm)
    vector /= np.linalg.norm(vector)
    value = float(vector @ matrix @ vector)
    for _ in range(8):
        if np.linalg.norm(matrix @ vector - value * vector) <= 4 * EPS * norm:
            break
        vector = solved(matrix, value, vector, norm)
        vector /= np.linalg.norm(vector)
        value = float(vector @ matrix @ vector)
    return value, vector


def leading(matrix: np.ndarray, wanted: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(values, falling; unit vectors as columns) of the ``wanted`` leading eigenvalues of a symmetric matrix.

    ``floor``: differences below it are rounding errors of the matrix, so any basis will do."""
    wanted = min(wanted, len(matrix))
    norm = float(np.abs(matrix).sum(axis=1).max()) if len(matrix) else 0.0
    rounding = max(floor, 64 * len(matrix) * EPS * norm)
    if norm <= floor or wanted == 0:
        return matrix.diagonal()[:wanted].copy(), np.eye(len(matrix))[:, :wanted]
    values, vectors = [], []
    for own in slices(matrix, wanted, max(CLOSE * norm, rounding / 8)):
        number = own.last - own.first + 1
        if number == 1:
            value, vector = rayleigh(matrix, own, norm)
            if not above(matrix, value - rounding) >= own.first > above(matrix, value + rounding):
                raise ArithmeticError(f"eigenvalue {value} is not number {own.first}")
            values.append(value)
            vectors.append(vector[:, None])
            continue
        basis = np.random.Generator(np.random.PCG64(13)).standard_normal((len(matrix), number))
        for _ in range(12):
            basis = np.linalg.qr(solved(matrix, (own.lo + own.hi) / 2, basis, norm))[0]
        centre = (own.lo + own.hi) / 2
        inner = basis.T @ (matrix @ basis - centre * basis)
        among, turn = leading((inner + inner.T) / 2, number, rounding)
        values += list(among + centre)
        vectors.append(basis @ turn)
    return np.array(values[:wanted]), np.hstack(vectors)[:, :wanted]


@dataclass
class Whitening:
    """The fit: n rows, sums of the floored entries, leading eigenvalues and unit vectors, their share of the trace."""

    length: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def moments(df: DataFrame, vector: str, length: int, scale: int) -> tuple[int, list[int], list[list[int]]]:
    """(rows, sums, sums of products) of the floored entries, exact."""
    rows, columns = np.triu_indices(length)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(length, object), np.zeros((length, length), object)
        for batch in batches:
            y = floored(finite_rows(batch["v"], length)[1], scale, LIMIT)
            big = int(np.abs(y).max()) if len(y) else 0
            step = (1 << 53) // max(big * big, 1)  # so many products stay exact as doubles
            for k in range(0, len(y), max(step, 1)):
                part = y[k : k + max(step, 1)]
                part = part.astype(float if step else object)
                products = products + (part.T @ part).astype(np.int64).astype(object) if step else products + part.T.dot(part)
                sums = sums + y[k : k + max(step, 1)].sum(axis=0).astype(object)
            n += len(y)
        if n:
            found = [n, *sums, *products[rows, columns]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array([Decimal(int(x)) for x in found], pa.decimal128(38, 0))], ["at", "total"])

    parts = df.select(F.col(vector).alias("v")).mapInArrow(totals, "at int, total decimal(38,0)")
    got = {r["at"]: int(r["total"]) for r in parts.groupBy("at").agg(F.sum("total").cast("string").alias("total")).collect()}
    gram = [[0] * length for _ in range(length)]
    for k, (i, j) in enumerate(zip(rows.tolist(), columns.tolist()), 1 + length):
        gram[i][j] = gram[j][i] = got.get(k, 0)
    return got.get(0, 0), [got.get(1 + i, 0) for i in range(length)], gram


def fit(df: DataFrame, vector: str = "embedding", components: int = 8, scale: int = SCALE) -> Whitening:
    """Exact moments of the whole table and the leading pairs of its covariance (divisor n)."""
    prepare(df.sparkSession)
    length = usual_length(df, vector)
    n, sums, gram = moments(df, vector, length, scale)
    none = Whitening(length, n, sums, np.zeros(0), np.zeros((length, 0)), np.zeros(0))
    if not n:
        return none
    covariance = np.array([[(n * gram[i][j] - sums[i] * sums[j]) / n**2 for j in range(length)] for i in range(length)])
    trace = sum(n * gram[i][i] - sums[i] ** 2 for i in range(length)) / n**2
    if not trace:
        return none
    values, vectors = leading(covariance, components)
    positive = values > 64 * length * EPS * trace
    return Whitening(length, n, sums, values[positive], vectors[:, positive], values[positive] / trace)


def transform(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Per row that takes part: ``key``, deviation, whitened (an array, one value a component)."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    n, sums, length = model.n, model.sums, model.length
    turn = model.vectors / np.sqrt(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(sums, object)
        for batch in batches:
            at, found = finite_rows(batch["v"], length)
            y = floored(found, scale, LIMIT)
            big = n * (int(np.abs(y).max()) if len(y) else 0) + max(map(abs, sums), default=0)
            wide = big * big * length >= 1 << 63  # beyond 64 bits: Python's integers
            apart = n * y.astype(object) - own if wide else n * y - own.astype(np.int64)
            squares = (apart * apart).sum(axis=1)
            deviation = [int(s) if s < 1 << 63 else None for s in squares]
            flat = ((apart / n).astype(float) @ turn).ravel()
            ends = pa.array(np.arange(len(at) + 1) * turn.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at)), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat, pa.float64()))], [key, "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(project, f"`{key}` {kind}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of the whitened columns less the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    w = F.col("whitened")
    sums = [F.avg(w[i]).alias(f"m{i}") for i in range(components)]
    row = white.agg(*sums, *(F.avg(w[i] * w[j]).alias(f"p{i}_{j}") for i, j in pairs)).first()
    return max(abs(row[f"p{i}_{j}"] - row[f"m{i}"] * row[f"m{j}"] - (i == j)) for i, j in pairs)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = SCALE) -> DataFrame:
    """Per row and component: ``key``, component, n, deviation, whitened, explained, identity_error."""
    model = fit(df, vector, components, scale)
    found = len(model.values)
    white = transform(df, model, key, vector, scale)
    error = 0.0
    if found:
        white = saved(white, "whitened")
        error = identity_error(white, found)
    share = F.array(*(F.lit(float(x)) for x in model.explained)) if found else F.array().cast("array<double>")
    each = white.select(F.col(f"`{key}`").alias(key), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        F.col(f"`{key}`").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
