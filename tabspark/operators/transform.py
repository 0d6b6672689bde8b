"""Numeric transforms T1-T8.  Each builds one ``select`` (no withColumn chains)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tabspark.functions.exprs import as_float, renorm_array, safe_log1p, safe_ratio
from tabspark.operators.base import Estimator, Model, Stateless, log, present, present_pairs
from tabspark.operators.quantile import group_quantiles

# Suffixes of polynomial terms (other degrees become "pow{n}").
DEGREE_NAMES = {2: "sq", 3: "cube"}


def with_columns(df: DataFrame, new: dict[str, Column], replace: dict[str, Column] | None = None,
                 drop: Sequence[str] = ()) -> DataFrame:
    """One projection: keep column order, replace in place, append new columns."""
    replace = replace or {}
    keep = [replace[c].alias(c) if c in replace else F.col(c) for c in df.columns if c not in drop and c not in new]
    return df.select(*keep, *[e.alias(n) for n, e in new.items()])


class Log1p(Stateless):
    """``{c}_log1p = log1p(max(c, clip_lower))`` as float32."""

    def __init__(self, cols: Sequence[str], clip_lower: float = 0.0, drop_original: bool = False, on_missing="skip"):
        self.cols, self.clip_lower, self.drop_original, self.on_missing = list(cols), clip_lower, drop_original, on_missing

    def transform(self, df):
        cols = present(df, self.cols, "log1p_transform", self.on_missing)
        new = {f"{c}_log1p": as_float(safe_log1p(c, self.clip_lower)) for c in cols}
        return with_columns(df, new, drop=cols if self.drop_original else ())


class Ratio(Stateless):
    """``{a}_per_{b} = a / (b + eps)``; an exact zero denominator gives NULL instead of an error."""

    def __init__(self, pairs, eps: float = 1e-6, on_missing="skip"):
        self.pairs, self.eps, self.on_missing = list(pairs), eps, on_missing

    def transform(self, df):
        pairs = present_pairs(df, self.pairs, "ratio_features", self.on_missing)
        return with_columns(df, {f"{a}_per_{b}": as_float(safe_ratio(a, b, self.eps)) for a, b in pairs})


class Subtract(Stateless):
    """``{a}_minus_{b} = a - b``."""

    def __init__(self, pairs, on_missing="skip"):
        self.pairs, self.on_missing = list(pairs), on_missing

    def transform(self, df):
        pairs = present_pairs(df, self.pairs, "subtraction_features", self.on_missing)
        return with_columns(
            df, {f"{a}_minus_{b}": as_float(F.col(a).cast("double") - F.col(b).cast("double")) for a, b in pairs}
        )


class Polynomial(Stateless):
    """T5: ``{c}_sq``, ``{c}_cube``, ``{c}_pow{n}``."""

    def __init__(self, cols, degrees: Sequence[int] = (2,), on_missing="skip"):
        self.cols, self.degrees, self.on_missing = list(cols), list(degrees), on_missing

    def transform(self, df):
        cols = present(df, self.cols, "polynomial_terms", self.on_missing)
        new = {}
        for c in cols:
            for d in self.degrees:
                new[f"{c}_{DEGREE_NAMES.get(d, f'pow{d}')}"] = as_float(F.pow(F.col(c).cast("double"), float(d)))
        return with_columns(df, new)


class AngleToUnitVector(Stateless):
    """Right ascension / declination in degrees -> unit vector ``{prefix}x,y,z``.

    Unlike the original, an output name that already exists is an error (the original
    silently overwrote an input band called ``z``).
    """

    def __init__(self, alpha: str, delta: str, prefix: str = ""):
        self.alpha, self.delta, self.prefix = alpha, delta, prefix

    def transform(self, df):
        names = [f"{self.prefix}{n}" for n in ("x", "y", "z")]
        clash = [n for n in names if n in df.columns]
        if clash:
            raise ValueError(f"angle_converter: output columns {clash} already exist; pass a prefix")
        a = F.radians(F.col(self.alpha).cast("double"))
        d = F.radians(F.col(self.delta).cast("double"))
        return with_columns(
            df,
            {names[0]: as_float(F.cos(d) * F.cos(a)), names[1]: as_float(F.cos(d) * F.sin(a)), names[2]: as_float(F.sin(d))},
        )


def stack_columns(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), name="column", value="value") -> DataFrame:
    """Unpivot numeric columns into ``(*keep, column, value double)`` (one pass for many columns)."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keep) if keep else [], list(cols), name, value
    )


@dataclass
class ClipIQRModel(Model):
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def transform(self, df):
        rep = {}
        for c, (lo, hi) in self.bounds.items():
            if c in df.columns:
                x = F.col(c)
                # strict fences; NULL stays NULL; the column keeps its type, so whole numbers are clipped to the whole numbers inside
                if isinstance(df.schema[c].dataType, IntegralType):
                    lo, hi = math.ceil(lo), max(math.ceil(lo), math.floor(hi))
                clipped = F.when(x < F.lit(lo), F.lit(lo)).when(x > F.lit(hi), F.lit(hi)).otherwise(x.cast("double"))
                rep[c] = clipped.cast(df.schema[c].dataType)
        return with_columns(df, {}, replace=rep)

    def clipped_counts(self, df: DataFrame) -> dict[str, int]:
        """Rows outside the fences per column (one aggregate)."""
        cols = [c for c in self.bounds if c in df.columns]
        if not cols:
            return {}
        row = df.agg(*[
            F.sum(((F.col(c) < self.bounds[c][0]) | (F.col(c) > self.bounds[c][1])).cast("long")).alias(c) for c in cols
        ]).first()
        return {c: int(row[c] or 0) for c in cols}


class ClipIQR(Estimator):
    """T4: winsorise to train ``[Q1 - k_lo IQR, Q3 + k_hi IQR]``; quantiles by linear interpolation."""

    def __init__(self, cols, lower_factor: float = 3.0, upper_factor: float = 3.0, exact: bool = True, on_missing="skip"):
        self.cols, self.lower_factor, self.upper_factor, self.exact, self.on_missing = (
            list(cols), lower_factor, upper_factor, exact, on_missing)

    def fit(self, df):
        cols = present(df, self.cols, "clip_iqr", self.on_missing)
        if not cols:
            return ClipIQRModel({})
        # all columns in one distributed quantile job, one group per column
        q = group_quantiles(stack_columns(df, cols), "value", [0.25, 0.75], ["column"], exact=self.exact).collect()
        got = {(r["column"], r["q"]): r["value"] for r in q}
        bounds = {}
        for c in cols:
            q1, q3 = got.get((c, 0.25)), got.get((c, 0.75))
            if q1 is None or q3 is None:
                log.warning("clip_iqr: %r has no values, skipped", c)
                continue
            iqr = q3 - q1
            bounds[c] = (q1 - self.lower_factor * iqr, q3 + self.upper_factor * iqr)
        return ClipIQRModel(bounds)


@dataclass
class FoldStandardizerModel(Model):
    """T7 result: for every fold f, mean and sample std of each column over all *other* folds."""

    cols: list[str]
    fold_col: str
    stats: dict[int, dict[str, tuple[float | None, float | None]]]  # fold -> col -> (mean, std)

    def _scaled(self, c: str, mu: Column, sd: Column) -> Column:
        return as_float(F.try_divide(F.col(c).cast("double") - mu, sd))

    def transform_oof(self, df: DataFrame) -> DataFrame:
        """Each row standardised with the statistics of its training folds (every fold but its own)."""
        rep = {}
        for c in self.cols:
            mu = sd = None
            for f, st in self.stats.items():
                m, s = st[c]
                cond = F.col(self.fold_col) == f
                mu = F.when(cond, F.lit(m)) if mu is None else mu.when(cond, F.lit(m))
                sd = F.when(cond, F.lit(s)) if sd is None else sd.when(cond, F.lit(s))
            rep[c] = self._scaled(c, mu, sd)
        return with_columns(df, {}, replace=rep)

    def transform_for_fold(self, df: DataFrame, fold: int) -> DataFrame:
        """Rows of another frame (e.g. test) standardised with fold ``fold``'s training statistics."""
        st = self.stats[fold]
        rep = {c: self._scaled(c, F.lit(st[c][0]), F.lit(st[c][1])) for c in self.cols}
        return with_columns(df, {}, replace=rep)

    transform = transform_oof


class FoldStandardizer(Estimator):
    """Per-fold standardisation with training-fold mean and sample std.

    One grouped aggregate over the fold column gives ``(n, mean, population variance)`` per fold
    (K small rows); the training statistics of fold f merge those of the other folds (parallel
    variance: within plus between folds), so the data is scanned once, not K times, and a
    large mean does not swallow the spread.
    """

    def __init__(self, cols, fold_col: str = "fold"):
        self.cols, self.fold_col = list(cols), fold_col

    def fit(self, df):
        aggs = []
        for c in self.cols:
            x = F.col(c).cast("double")
            aggs += [F.count(x).alias(f"n_{c}"), F.avg(x).alias(f"m_{c}"), F.var_pop(x).alias(f"v_{c}")]
        rows = {r[self.fold_col]: r for r in df.groupBy(self.fold_col).agg(*aggs).collect()}
        stats = {}
        for f in rows:
            stats[f] = {}
            for c in self.cols:
                others = [(r[f"n_{c}"], r[f"m_{c}"], r[f"v_{c}"]) for g, r in rows.items() if g != f and r[f"n_{c}"]]
                n = sum(k for k, _, _ in others)
                mean = sum(k * m for k, m, _ in others) / n if n else None
                spread = sum(k * (v + (m - mean) ** 2) for k, m, v in others)
                stats[f][c] = (mean, math.sqrt(spread / (n - 1)) if n > 1 else None)
        return FoldStandardizerModel(self.cols, self.fold_col, stats)


class Renorm(Stateless):
    """L1-normalise a probability array column (zero-sum rows unchanged)."""

    def __init__(self, col: str = "probs"):
        self.col = col

    def transform(self, df):
        return with_columns(df, {}, replace={self.col: renorm_array(self.col)})


def renorm_long(df: DataFrame, key: Sequence[str] = ("row_id",), p: str = "p") -> DataFrame:
    """T8 on the long form ``(key..., class, p)``: window over the row's classes (bounded by class count)."""
    total = F.sum(p).over(Window.partitionBy(*key))
    return df.withColumn(p, F.when(total == 0, F.col(p)).otherwise(F.col(p) / total))


def log1p_transform(df_train, df_test, cols, clip_lower=0.0, drop_original=False):
    return Log1p(cols, clip_lower, drop_original).fit_transform_pair(df_train, df_test)


def ratio_features(df_train, df_test, pairs, eps=1e-6):
    return Ratio(pairs, eps).fit_transform_pair(df_train, df_test)


def subtraction_features(df_train, df_test, pairs):
    return Subtract(pairs).fit_transform_pair(df_train, df_test)


def clip_iqr(df_train, df_test, cols, lower_factor=3.0, upper_factor=3.0, exact=True):
    model = ClipIQR(cols, lower_factor, upper_factor, exact).fit(df_train)
    for c, n in model.clipped_counts(df_train).items():
        log.info("clip_iqr: %r bounds=%s clipped train=%d", c, model.bounds[c], n)
    return model.transform(df_train), model.transform(df_test)


def polynomial_terms(df_train, df_test, cols, degrees=None):
    return Polynomial(cols, degrees or [2]).fit_transform_pair(df_train, df_test)


def angle_converter(df_train, df_test, cols, prefix=""):
    return AngleToUnitVector(cols[0], cols[1], prefix).fit_transform_pair(df_train, df_test)

