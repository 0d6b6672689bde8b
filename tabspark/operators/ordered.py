"""Ordered target statistics: the categorical slot of boosting (M6).

A category is replaced, for each class, by the smoothed share of that class among the rows *before* it in a seeded random
order, so a row's own label, and those after it, never enter its features; new rows take the statistics of all training rows.

Folds are a column here too.  One pass gives, for every row, the running counts of each fold in its category; the statistics that
fold f's model needs are those of all folds but f, by subtraction: a row that the model trains on takes what lies before it, a
held-out row takes all of it.  So one exchange a column serves all K models, and none of them sees a label of its held-out fold.
The running counts come from ``running_totals``: a category that holds a third of the rows is spread over the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.functions.exprs import fold_order_key
from tabspark.operators.ranking import running_totals
from tabspark.session import BROADCAST_MAX_ROWS, materialise_small

MISSING = "∅"  # a NULL category is a category like any other


def category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def apart(c: Column, by: str) -> Column:
    """``c``, in a projection that stays out of whole-stage code because of its lambda function (over column ``by``, which does not matter).
    Spark then divides the code into small methods; in one with its neighbours', so many values pass the 8000 bytes up to which
    the JVM compiles a method, and each row took fifty times as long."""
    return F.when(F.size(F.transform(F.array(by), lambda x: x)) > 0, c)


@dataclass
class OrderedTargetModel:
    """Counts per category and fold of the training rows; ``folds`` in order, ``priors[f]`` the class shares outside fold f."""

    cols: list[str]
    classes: list
    folds: list[int]
    priors: dict[int, list[float]]
    strength: float
    seed: int
    fold_col: str
    row_id: str
    y: str
    counts: dict[str, tuple[DataFrame, int]]

    def feature(self, col: str, k: int, fold: int | str) -> str:
        """Feature of class number ``k`` for the model of ``fold``; with ``"{fold}"``, the pattern that ``fit_oof`` fills in."""
        return f"{col}_ots{k}_f{fold}"

    def features(self) -> list[str]:
        return [self.feature(c, k, "{fold}") for c in self.cols for k in range(len(self.classes))]

    def _weights(self) -> dict[str, Column]:
        """Indicator columns: rows of each fold, and of each fold and class."""
        out = {}
        for j, f in enumerate(self.folds):
            mine = F.col(self.fold_col) == f
            out[f"__n{j}"] = mine.cast("int")
            out |= {f"__s{j}_{k}": (mine & F.col(self.y).eqNullSafe(F.lit(c))).cast("int") for k, c in enumerate(self.classes)}
        return out

    def _statistics(self, n, s) -> dict[int, list[Column]]:
        """For each fold f and class k: (s + strength * prior) / (n + strength) over all folds but f; ``n(j)``, ``s(j, k)`` are counts."""
        out, every = {}, range(len(self.folds))
        rows, hits = sum((n(j) for j in every), F.lit(0)), [sum((s(j, k) for j in every), F.lit(0)) for k in range(len(self.classes))]
        for j, f in enumerate(self.folds):
            out[f] = [(hits[k] - s(j, k) + F.lit(self.strength * self.priors[f][k])) / (rows - n(j) + F.lit(self.strength)) for k in range(len(self.classes))]
        return out

    def _list(self, statistics: dict[int, list[Column]], held: str | None = None) -> Column:
        """All statistics as one array; with ``held``, an array of the same, a row of fold f takes its values for f from there."""
        at = [(f, k) for f in self.folds for k in range(len(self.classes))]
        return F.array(*(F.when(F.col(self.fold_col) == f, F.get(F.col(held), F.lit(i))).otherwise(statistics[f][k]) if held else statistics[f][k] for i, (f, k) in enumerate(at)))

    def _joined(self, df: DataFrame, col: str) -> DataFrame:
        """``df`` with the statistics of all training rows of its category, an array ``__whole``; NULL for a category that they lack."""
        counts, n = self.counts[col]
        counts = counts.select("__cat", self._list(self._statistics(lambda j: F.col(f"__t_n{j}"), lambda j, k: F.col(f"__t_s{j}_{k}"))).alias("__whole"))
        counts = F.broadcast(counts) if n <= BROADCAST_MAX_ROWS else counts
        return df.withColumn("__cat", category(col)).join(counts, "__cat", "left").drop("__cat")

    def _columns(self, df: DataFrame) -> DataFrame:
        """The arrays ``__of<number of the column>`` as a column each."""
        names = [(i, [self.feature(col, k, f) for f in self.folds for k in range(len(self.classes))]) for i, col in enumerate(self.cols)]
        arrays = [f"__of{i}" for i, _ in names]
        return df.select(*(c for c in df.columns if c not in arrays), *(F.get(F.col(f"__of{i}"), F.lit(x)).alias(name) for i, own in names for x, name in enumerate(own)))

    def transform_train(self, df: DataFrame) -> DataFrame:
        """Training rows with the features of every fold's model."""
        for i, col in enumerate(self.cols):
            weights = self._weights()
            d = df.withColumns({"__cat": category(col), "__ok": fold_order_key(self.row_id, self.seed)})
            d = running_totals(d, ["__cat"], ["__ok", self.row_id], weights).drop("__ok", "__cat")
            before = self._statistics(lambda j: F.col(f"__before___n{j}"), lambda j, k: F.col(f"__before___s{j}_{k}"))
            df = self._joined(d, col).withColumn(f"__of{i}", apart(self._list(before, "__whole"), self.row_id)).drop("__whole", *[f"__before_{w}" for w in weights])
        return self._columns(df)

    def transform(self, df: DataFrame) -> DataFrame:
        """New rows with the features of every fold's model; a category that training rows lack takes the prior."""
        none = self._list(self._statistics(lambda j: F.lit(0), lambda j, k: F.lit(0)))
        for i, col in enumerate(self.cols):
            df = self._joined(df, col).withColumn(f"__of{i}", F.coalesce("__whole", none)).drop("__whole")
        return self._columns(df)


class OrderedTargetEncoder:
    """M6: ``(s + strength * prior) / (n + strength)`` over the rows before, per class, for every fold's model."""

    def __init__(self, cols: Sequence[str], y: str, classes: Sequence, fold_col: str = "fold", row_id: str = "row_id", strength: float = 1.0, seed: int = 1337):
        self.cols, self.y, self.classes, self.fold_col, self.row_id, self.strength, self.seed = list(cols), y, list(classes), fold_col, row_id, strength, seed

    def fit(self, df: DataFrame) -> OrderedTargetModel:
        """One aggregate over (column, category, fold, class), combined before the shuffle."""
        per = df.groupBy(F.col(self.fold_col).alias("f"), F.col(self.y).alias("y")).agg(F.count("*").alias("n")).collect()  # folds x classes rows
        folds = sorted({r["f"] for r in per})
        priors = {}
        for f in folds:
            others = [r for r in per if r["f"] != f]
            total = sum(r["n"] for r in others)
            priors[f] = [sum(r["n"] for r in others if r["y"] == c) / total if total else 0.0 for c in self.classes]
        model = OrderedTargetModel(self.cols, self.classes, folds, priors, float(self.strength), self.seed, self.fold_col, self.row_id, self.y, {})
        weights = model._weights()
        for col in self.cols:
            counts = df.withColumns({"__cat": category(col), **weights}).groupBy("__cat").agg(*(F.sum(w).alias(w.replace("__", "__t_", 1)) for w in weights))
            model.counts[col] = materialise_small(counts)
        return model
