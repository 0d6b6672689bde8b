"""Stacking M12-M16: meta-features from run probabilities, nested CV of a meta learner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.operators.cv import CVResult, fit_oof, stratified_folds
from tabspark.operators.encode import balanced_class_weights


def meta_features(long: DataFrame, runs: Sequence[str], n_classes: int) -> tuple[DataFrame, list[str]]:
    """One row per ``row_id`` with a column per (run, class) probability.

    A ``groupBy(row_id)`` with the known (run, class) grid as pivot values: one shuffle on
    ``row_id`` for all runs (each row holds runs x classes values, a bounded group).
    """
    names = [f"{r}__p{c}" for r in runs for c in range(n_classes)]
    keyed = long.withColumn("__k", F.concat(F.col("run"), F.lit("__p"), F.col("class").cast("string")))
    wide = keyed.groupBy("row_id").pivot("__k", names).agg(F.first("p"))
    return wide, names


def logreg_params(c: float, total_weight: float) -> dict:
    """Scikit-learn's ``C`` on a weighted sum of losses equals Spark's mean-loss objective
    with ``regParam = 1 / (C * sum(weights))`` (no standardisation)."""
    return {"regParam": 1.0 / (c * total_weight), "standardization": False, "maxIter": 200}


def fit_meta_learner(
    meta_train: DataFrame,
    meta_test: DataFrame,
    features: list[str],
    kind: str = "logreg",
    n_folds: int = 5,
    seed: int = 42,
    c: float = 1.0,
    balanced: bool = True,
    run: str = "stack",
    params: dict | None = None,
) -> CVResult:
    """Nested stratified CV of a meta learner on the meta table (own folds,
    seed 42); OOF meta predictions, test = mean of the fold models."""
    folded = stratified_folds(meta_train, "label", k=n_folds, seed=seed)
    weights = balanced_class_weights(folded, "label", "fold") if balanced else None
    if kind == "logreg" and params is None:
        # per-fold sum of balanced weights = number of training rows
        n = folded.count()
        params = logreg_params(c, n * (n_folds - 1) / n_folds)
    return fit_oof(folded, meta_test, features, "label", kind, params, weights=weights, run=run, early_stopping=False)
