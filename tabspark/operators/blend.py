"""Probability blending B1-B5 and the long-probability algebra.

A probability set is the long table ``(run, row_id, class, p)`` (class = 0-based code);
stored sets use ``(run, row_id, probs array<double>)`` and are exploded to this form.
A table that lies in buckets of ``row_id`` (``session.cut_by_key``) is blended where it is: the per-(row, class)
aggregate and the per-row renormalisation reuse that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.operators.joins import join_fitted
from tabspark.operators.ranking import average_rank
from tabspark.session import materialise_small, spread

EPS = 2.220446049250313e-16  # float64 machine epsilon (log-loss clipping)


def explode_probs(df: DataFrame, probs: str = "probs", keep: Sequence[str] = ("run", "row_id")) -> DataFrame:
    """``(…, probs array)`` -> ``(…, class, p)``."""
    return df.select(*keep, F.posexplode(probs).alias("class", "p"))


def collect_probs(long: DataFrame, keep: Sequence[str] = ("run", "row_id")) -> DataFrame:
    """``(…, class, p)`` -> ``(…, probs array)`` ordered by class (bounded by the class count)."""
    g = long.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("class", "p"))).alias("__s"))
    return g.select(*keep, F.col("__s.p").alias("probs"))


def renorm(long: DataFrame, key: Sequence[str] = ("row_id",)) -> DataFrame:
    """T8 in long form: p / sum over the row's classes (zero-sum row unchanged)."""
    total = F.sum("p").over(Window.partitionBy(*key))
    return long.withColumn("p", F.when(total == 0, F.col("p")).otherwise(F.col("p") / total))


def blend_equal(long: DataFrame) -> DataFrame:
    """B1: mean over runs per (row, class), then row renormalisation -> ``(row_id, class, p)``."""
    return renorm(long.groupBy("row_id", "class").agg(F.avg("p").alias("p")))


def blend_rank(long: DataFrame) -> DataFrame:
    """B2: per (run, class) average rank / n over rows, mean over runs, row renormalisation.

    Ranks come from the range-partitioned ``average_rank`` (no single-partition window).
    """
    n, n_runs = materialise_small(long.where(F.col("class") == 0).groupBy("run").agg(F.count("*").alias("__n")))
    r = join_fitted(average_rank(long, ["run", "class"], "p", out="__rank"), n, "run", n_runs)
    r = r.select("run", "row_id", "class", (F.col("__rank") / F.col("__n")).alias("p"))
    rows = n.agg(F.max("__n")).first()[0] or 0  # one number
    return blend_equal(r.repartition(spread(long.sparkSession, rows), "row_id"))


def blend_weighted(long: DataFrame, weights: dict[str, float]) -> DataFrame:
    """sum_m w_m p_m per (row, class), then row renormalisation."""
    w = None
    for run, wt in weights.items():
        cond = F.col("run") == F.lit(run)
        w = F.when(cond, F.lit(float(wt))) if w is None else w.when(cond, F.lit(float(wt)))
    m = long.where(F.col("run").isin(list(weights))).groupBy("row_id", "class").agg(F.sum(w * F.col("p")).alias("p"))
    return renorm(m)


@dataclass
class BlendWeights:
    runs: list[str]
    weights: list[float]
    iterations: int
    converged: bool
    logloss: float


def optimise_weights(oof: DataFrame, labels: DataFrame, tol: float = 1e-10, max_iter: int | None = None) -> BlendWeights:
    """Convex mixture weights minimising OOF log-loss, by projected Newton steps.

    ``-mean log(sum_m w_m p_m,y)`` on the simplex has the same optimum as that plus
    ``sum_m w_m`` over ``w >= 0``, which is convex and smooth.  Each step is one aggregate over the cached
    true-class probabilities (loss, gradient and Hessian: a few sums a pair of runs), so the driver holds
    runs x runs numbers and a handful of passes suffices; weights are literals and lineage stays flat.  The step solves
    the quadratic model under ``w >= 0`` and is halved while the loss rises.  Ends when the optimality conditions
    (gradient 0 where ``w > 0``, not negative elsewhere) hold to ``tol``, or when no step lowers the loss any more;
    ``converged`` is False only when ``max_iter``, if given, stopped it before.  Rows must already sum to 1
    (apply ``renorm``).  Identical true-class vectors are merged first (exact).
    """
    runs = sorted(r["run"] for r in oof.select("run").distinct().collect())
    m = len(runs)
    # joined and grouped by the row alone: a set that lies in buckets of rows stays where it is
    truth = oof.join(labels.select("row_id", F.col("y").alias("__y")), "row_id")
    true = F.col("class") == F.col("__y")
    per_row = truth.groupBy("row_id").agg(F.count(F.when(true, 1)).alias("__n"), *[F.first(F.when(true & (F.col("run") == r), F.col("p")), ignorenulls=True).alias(f"t{k}") for k, r in enumerate(runs)])
    t = per_row.where("__n > 0").select(F.array(*[F.coalesce(F.col(f"t{k}"), F.lit(0.0)) for k in range(m)]).alias("t"))
    t = t.groupBy("t").agg(F.count("*").cast("double").alias("c")).persist(StorageLevel.MEMORY_AND_DISK)

    def evaluate(w):
        """(objective, mean log-loss, gradient, Hessian) at the weights."""
        mix = F.greatest(sum((F.lit(float(w[k])) * F.col("t")[k] for k in range(m)), F.lit(0.0)), F.lit(EPS))
        d = t.select("c", mix.alias("mix"), *[(F.col("t")[k] / mix).alias(f"u{k}") for k in range(m)])
        row = d.agg(
            F.sum("c").alias("n"), F.sum(-F.col("c") * F.log("mix")).alias("f"),
            F.sum(-F.col("c") * F.log(F.least(F.col("mix"), F.lit(1 - EPS)))).alias("ll"),
            *[F.sum(F.col("c") * F.col(f"u{k}")).alias(f"g{k}") for k in range(m)],
            *[F.sum(F.col("c") * F.col(f"u{i}") * F.col(f"u{j}")).alias(f"h{i}_{j}") for i in range(m) for j in range(i, m)],
        ).first()
        n = row["n"]
        g = np.array([1 - row[f"g{k}"] / n for k in range(m)])
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] / n for j in range(m)] for i in range(m)])
        return row["f"] / n + float(sum(w)), row["ll"] / n, g, h

    w = np.full(m, 1.0 / m)
    value, loss, g, h = evaluate(w)
    it, converged, stuck = 1, False, False
    while not (converged or stuck) and (max_iter is None or it < max_iter):
        step, share = _bounded_step(w, g, h), 1.0
        while True:
            trial = np.maximum(w + share * step, 0.0)
            new = evaluate(trial)
            it += 1
            if new[0] <= value + 1e-15:
                break
            share /= 2
            if share < 1e-10:  # rounding hides any further descent
                stuck = True
                break
        if not stuck:
            w, (value, loss, g, h) = trial, new
        converged = stuck or bool(np.abs(np.minimum(w, g)).max() < tol)
    t.unpersist()
    return BlendWeights(runs, [float(x) for x in w / w.sum()], it, converged, loss)


def _bounded_step(w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step d that minimises g d + d h d / 2 with w + d >= 0, one coordinate after another."""
    d = np.zeros(len(w))
    h = h + np.eye(len(w)) * 1e-12 * max(1.0, np.trace(h))
    for _ in range(20_000):
        most = 0.0
        for k in range(len(w)):
            to = max(-w[k], d[k] - (g[k] + h[k] @ d) / h[k, k])
            most, d[k] = max(most, abs(to - d[k])), to
        if most < 1e-14:
            break
    return d


def blend(long: DataFrame, strategy: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Strategy dispatch ('equal' | 'rank' | 'optimised' with fitted weights)."""
    if strategy == "equal":
        return blend_equal(long)
    if strategy == "rank":
        return blend_rank(long)
    if strategy in ("optimised", "opt_weights", "weighted"):
        if not weights:
            raise ValueError("optimised blend needs weights from optimise_weights()")
        return blend_weighted(long, weights)
    raise ValueError(f"unknown blend strategy {strategy!r}")

