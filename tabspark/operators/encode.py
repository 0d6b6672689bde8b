"""Encoders, imputers and weights E1-E14.

Dictionaries and category statistics are small fitted DataFrames (bounded by the
number of categories x folds x classes).  They are materialised at fit time so their
row count is known, and joined back with ``join_fitted`` (broadcast under the bound).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabspark.functions.exprs import argmax_index
from tabspark.operators.base import Estimator, Model, present
from tabspark.operators.joins import join_fitted
from tabspark.operators.ranking import dense_index
from tabspark.operators.transform import with_columns
from tabspark.session import materialise_small

# Reserved label of the unknown / null slot (code 0) and the string a
# null categorical becomes.
UNKNOWN = "__UNKNOWN__"
MISSING = "missing"


def _materialise(df: DataFrame) -> tuple[DataFrame, int]:
    """Cache a fitted table and return it with its exact row count."""
    return materialise_small(df)


def as_nullable_double(c: str) -> Column:
    """NaN -> NULL (pandas treats NaN as missing; Spark keeps NaN as a value)."""
    x = F.col(c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


# --------------------------------------------------------------------------- E1 / E2
@dataclass
class TargetDictionaryModel(Model):
    target: str
    dictionary: DataFrame  # code int, label string, n bigint
    size: int

    def transform(self, df):
        d = self.dictionary.select(F.col("label").alias("__lbl"), F.col("code").alias("__code"))
        j = join_fitted(df.withColumn("__lbl", F.col(self.target).cast("string")), d, "__lbl", self.size, "left")
        return with_columns(j, {}, replace={self.target: F.col("__code")}).drop("__lbl", "__code")


class TargetDictionary(Estimator):
    """Drop rows with a NULL target, then codes by descending frequency (ties alphabetical)."""

    def __init__(self, target: str):
        self.target = target

    def fit(self, df):
        counts = df.where(F.col(self.target).isNotNull()).groupBy(F.col(self.target).cast("string").alias("label")).count()
        w = Window.orderBy(F.desc("count"), F.asc("label"))  # one row per class: tiny
        d = counts.select((F.row_number().over(w) - 1).cast("int").alias("code"), "label", F.col("count").alias("n"))
        d, n = _materialise(d)
        return TargetDictionaryModel(self.target, d, n)


def drop_null_target(df: DataFrame, target: str) -> tuple[DataFrame, int]:
    """V1: rows with a NULL target removed; returns the dropped count (one aggregate)."""
    n_null = df.agg(F.sum(F.col(target).isNull().cast("long"))).first()[0] or 0
    return df.where(F.col(target).isNotNull()), int(n_null)


def cast_target(df: DataFrame, target: str, dtype: str) -> DataFrame:
    """Target cast only."""
    return with_columns(df, {}, replace={target: F.col(target).cast(dtype)})


# --------------------------------------------------------------------------- E3 / E4
@dataclass
class MissingEncoderModel(Model):
    cats: list[str]
    nums: list[str]
    means: dict[str, float]  # only columns that get a flag

    def transform(self, df):
        rep = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in self.cats if c in df.columns}
        new = {}
        for c in self.nums:
            if c not in df.columns:
                continue
            x = as_nullable_double(c)
            if c in self.means:
                new[f"{c}_has_missing"] = F.when(x.isNull(), F.lit("1")).otherwise(F.lit("0"))
                x = F.coalesce(x, F.lit(self.means[c]))
            rep[c] = x.cast("float")
        return with_columns(df, new, replace=rep)


class MissingEncoder(Estimator):
    """E3 + E4: categorical NULL -> 'missing'; numeric NULL/NaN -> train mean plus a
    ``{c}_has_missing`` string flag, created when *either* frame has nulls; float32 output."""

    def __init__(self, cats: Sequence[str], nums: Sequence[str]):
        self.cats, self.nums = list(cats), list(nums)

    def _null_counts(self, df: DataFrame) -> dict[str, int]:
        nums = [c for c in self.nums if c in df.columns]
        if not nums:
            return {}
        row = df.agg(*[F.sum(as_nullable_double(c).isNull().cast("long")).alias(c) for c in nums]).first()
        return {c: int(row[c] or 0) for c in nums}

    def fit_pair(self, train: DataFrame, test: DataFrame | None = None) -> MissingEncoderModel:
        nums = [c for c in self.nums if c in train.columns]
        aggs = [F.avg(as_nullable_double(c)).alias(f"m_{c}") for c in nums]
        aggs += [F.sum(as_nullable_double(c).isNull().cast("long")).alias(f"n_{c}") for c in nums]
        row = train.agg(*aggs).first() if nums else None
        test_nulls = self._null_counts(test) if test is not None else {}
        means = {}
        for c in nums:
            if (row[f"n_{c}"] or 0) > 0 or test_nulls.get(c, 0) > 0:
                means[c] = row[f"m_{c}"]
        return MissingEncoderModel(self.cats, self.nums, means)

    def fit(self, df):
        return self.fit_pair(df, None)

    def fit_transform_pair(self, train, test):
        m = self.fit_pair(train, test)
        return m.transform(train), m.transform(test)


def assert_no_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> None:
    """V2: one aggregate counting NULL (and NaN) per column; raises if any."""
    cols = list(cols or df.columns)
    checks = []
    for c in cols:
        dt = df.schema[c].dataType.simpleString()
        isnull = F.col(c).isNull()
        if dt in ("float", "double"):
            isnull = isnull | F.isnan(c)
        checks.append(F.sum(isnull.cast("long")).alias(c))
    row = df.agg(*checks).first()
    bad = {c: row[c] for c in cols if row[c]}
    if bad:
        raise AssertionError(f"null values remain: {bad}")


# --------------------------------------------------------------------------- E5 / E6 / E8
@dataclass
class OrdinalEncoderModel(Model):
    cols: list[str]
    dictionary: DataFrame  # column, label, code (1-based)
    size: int
    unknown_code: int | None = 0  # None -> unseen stays NULL (E8)
    offset: int = 0

    def transform(self, df):
        out = df
        for c in self.cols:
            d = self.dictionary.where(F.col("column") == c).select(
                F.col("label").alias(f"__l_{c}"), (F.col("code") - self.offset).alias(f"__c_{c}")
            )
            out = join_fitted(out.withColumn(f"__l_{c}", F.col(c).cast("string")), d, f"__l_{c}", self.size, "left")
            code = F.col(f"__c_{c}")
            if self.unknown_code is not None:
                code = F.coalesce(code, F.lit(self.unknown_code))
            out = with_columns(out, {}, replace={c: code.cast("int")}).drop(f"__l_{c}", f"__c_{c}")
        return out

    def labels(self) -> DataFrame:
        """Dictionary including the reserved unknown slot at code 0."""
        unk = self.dictionary.select("column").distinct().select(
            "column", F.lit(UNKNOWN).alias("label"), F.lit(0).cast("long").alias("code")
        )
        return unk.unionByName(self.dictionary)


class OrdinalEncoder(Estimator):
    """E5: codes from the sorted train categories starting at 1; 0 = unknown or NULL.

    Categories sort in their natural order (numbers numerically, strings by code point).
    One pass for all columns: stack ``(column, value)``, distinct, then a distributed
    dense index per column (no single-partition window).
    """

    string_order = False

    def __init__(self, cols: Sequence[str] | None = None, target: str | None = None, on_missing="error"):
        self.cols, self.target, self.on_missing = cols, target, on_missing

    def _columns(self, df):
        if self.cols is None:
            return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name != self.target]
        return present(df, self.cols, "cat_encode", self.on_missing)

    def fit(self, df):
        cols = self._columns(df)
        numeric = {f.name for f in df.schema.fields
                   if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double")}
        def key(c):
            if c in numeric and not self.string_order:
                return F.col(c).cast("double")
            return F.lit(None).cast("double")
        stacked = df.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label"), key(c).alias("num"))
                                for c in cols])).alias("s")
        ).select("s.column", "s.label", "s.num").where(F.col("label").isNotNull()).distinct()
        bad = stacked.where(F.col("label") == UNKNOWN).limit(1).collect()
        if bad:
            raise ValueError(f"cat_encode: reserved label {UNKNOWN!r} found in column {bad[0]['column']!r}")
        d = dense_index(stacked, ["column"], ["num", "label"], out="idx").select(
            "column", "label", (F.col("idx") + 1).alias("code")
        )
        d, n = _materialise(d)
        return OrdinalEncoderModel(cols, d, n)


class LabelEncoder(OrdinalEncoder):
    """Labels of the stringified categories, sorted as strings, coded from 0; no unknown
    slot (unseen -> NULL)."""

    string_order = True

    def fit(self, df):
        m = super().fit(df)
        return OrdinalEncoderModel(m.cols, m.dictionary, m.size, unknown_code=None, offset=1)


def cat_encode(df_train, df_test, target, cols_to_encode=None):
    return OrdinalEncoder(cols_to_encode, target).fit_transform_pair(df_train, df_test)


# --------------------------------------------------------------------------- E7
def joint_factorize(train: DataFrame, test: DataFrame, cols: Sequence[str], order_key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Codes over train UNION test in first-appearance order (train rows first, then
    test, each by ``order_key``); NULL -> -1."""
    both = train.select(F.lit(0).alias("__part"), order_key, *cols).unionByName(
        test.select(F.lit(1).alias("__part"), order_key, *cols)
    )
    stacked = both.select(
        "__part", order_key,
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label")) for c in cols])).alias("s"),
    ).select("s.column", "s.label", F.struct("__part", order_key).alias("__first"))
    first = stacked.where(F.col("label").isNotNull()).groupBy("column", "label").agg(F.min("__first").alias("__first"))
    d = dense_index(first, ["column"], ["__first"], out="code").select("column", "label", "code")
    d, n = _materialise(d)
    model = OrdinalEncoderModel(list(cols), d, n, unknown_code=-1, offset=0)
    return model.transform(train), model.transform(test)


# --------------------------------------------------------------------------- E9 / E10 / E11
def _class_indicators(y: str, classes: Sequence[str]) -> list[Column]:
    return [(F.col(y).cast("string") == F.lit(str(k))).cast("double").alias(f"__y{i}") for i, k in enumerate(classes)]


@dataclass
class FoldCategoryStats:
    """Per (category, fold) counts and per-class sums of a categorical column: one grouped aggregate."""

    col: str
    classes: list[str]
    by_fold: DataFrame  # col, fold, n, s0..s{K-1}
    size: int
    folds: list[int]
    prior_by_fold: dict[int, list[float]]  # fold -> per-class prior over the *other* folds
    prior_all: list[float]

    @staticmethod
    def fit(df: DataFrame, col: str, y: str, classes: Sequence[str], fold_col: str = "fold") -> "FoldCategoryStats":
        return FoldCategoryStats.fit_many(df, [col], y, classes, fold_col)[col]

    @staticmethod
    def fit_many(df: DataFrame, cols: Sequence[str], y: str, classes: Sequence[str],
                 fold_col: str = "fold") -> dict[str, "FoldCategoryStats"]:
        """Statistics of several categorical columns from one scan: rows are stacked as
        ``(column, value)`` pairs and aggregated by ``(column, value, fold)`` (map-side partial
        aggregation, so a hot category never reaches one task as raw rows)."""
        ind = _class_indicators(y, classes)
        k = len(classes)
        stacked = df.select(
            F.col(fold_col).alias("fold"), *ind,
            F.explode(F.array(*[F.struct(F.lit(c).alias("__col"), F.col(c).cast("string").alias("__val")) for c in cols])).alias("__s"),
        ).select("__s.__col", "__s.__val", "fold", *[f"__y{i}" for i in range(k)])
        agg = stacked.groupBy("__col", "__val", "fold").agg(
            F.count("*").alias("n"), *[F.sum(f"__y{i}").alias(f"s{i}") for i in range(k)])
        agg, _ = _materialise(agg)
        # fold totals are the same for every column: read them from the first one (folds x classes values)
        first = cols[0]
        tot = {r["fold"]: r for r in agg.where(F.col("__col") == first).groupBy("fold").agg(
            F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]).collect()}
        folds = sorted(tot)
        n_all = sum(r["n"] for r in tot.values())
        prior_all = [sum(r[f"s{i}"] for r in tot.values()) / n_all for i in range(k)]
        prior_by_fold = {}
        for f in folds:
            n_f = n_all - tot[f]["n"]
            prior_by_fold[f] = [
                (sum(r[f"s{i}"] for g, r in tot.items() if g != f) / n_f) if n_f else None for i in range(k)
            ]
        sizes = {r["__col"]: r["cnt"] for r in agg.groupBy("__col").agg(F.count("*").alias("cnt")).collect()}
        out = {}
        for c in cols:
            by_fold = agg.where(F.col("__col") == c).select(F.col("__val").alias(c), "fold", "n", *[f"s{i}" for i in range(k)])
            out[c] = FoldCategoryStats(c, list(classes), by_fold, int(sizes.get(c, 0)), folds, prior_by_fold, prior_all)
        return out

    def oof_stats(self) -> DataFrame:
        """Per (category, fold f): statistics of the category over every fold except f."""
        k = len(self.classes)
        tot = self.by_fold.groupBy(self.col).agg(F.sum("n").alias("tn"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(k)])
        folds = F.array(*[F.lit(f) for f in self.folds])
        grid = tot.withColumn("fold", F.explode(folds))  # categories x folds: bounded
        j = grid.join(self.by_fold, [self.col, "fold"], "left")
        return j.select(
            self.col, "fold",
            (F.col("tn") - F.coalesce(F.col("n"), F.lit(0))).alias("n"),
            *[(F.col(f"t{i}") - F.coalesce(F.col(f"s{i}"), F.lit(0.0))).alias(f"s{i}") for i in range(k)],
        )

    def full_stats(self) -> DataFrame:
        k = len(self.classes)
        return self.by_fold.groupBy(self.col).agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])


def _prior_col(priors: dict[int, list[float]], fold_col: str, i: int) -> Column:
    expr = None
    for f, p in priors.items():
        cond = F.col(fold_col) == f
        expr = F.when(cond, F.lit(p[i])) if expr is None else expr.when(cond, F.lit(p[i]))
    return expr


@dataclass
class CategoryEncoderModel(Model):
    """Shared apply step of E9/E10: per-class encodings ``{col}_te_{class}`` from category stats."""

    stats: FoldCategoryStats
    formula: str  # 'smooth' | 'mestimate'
    m: float
    min_samples_leaf: int
    smoothing: float
    fold_col: str
    names: list[str]

    def _value(self, n: Column, s: Column, prior: Column) -> Column:
        if self.formula == "mestimate":
            return (s + F.lit(self.m) * prior) / (n + F.lit(self.m))
        mean = s / n
        smoove = 1.0 / (1.0 + F.exp(-(n - F.lit(float(self.min_samples_leaf))) / F.lit(float(self.smoothing))))
        return F.when(n == 1, prior).otherwise(prior * (1 - smoove) + mean * smoove)

    def _apply(self, df: DataFrame, st: DataFrame, keys: list[str], prior_of) -> DataFrame:
        c = self.stats.col
        k = len(self.stats.classes)
        # the values are worked out in the small table; a row takes its category's, or the prior
        n = F.col("n")
        vals = [F.when(n.isNull() | (n == 0), prior_of(i)).otherwise(self._value(n, F.col(f"s{i}"), prior_of(i))).cast("double").alias(f"__v{i}") for i in range(k)]
        st = st.select(*[F.col(x).alias(f"__k_{x}") if x == c else F.col(x) for x in keys], *vals)
        left = df.withColumn(f"__k_{c}", F.col(c).cast("string"))
        jk = [f"__k_{c}" if x == c else x for x in keys]
        # per-(category, fold) table has at most categories x folds rows
        bound = self.stats.size * max(len(self.stats.folds), 1) if len(keys) > 1 else self.stats.size
        j = join_fitted(left, st, jk, bound, "left")
        new = {self.names[i]: F.coalesce(F.col(f"__v{i}"), prior_of(i).cast("double")) for i in range(k)}
        return with_columns(j, new).drop(f"__k_{c}", *[f"__v{i}" for i in range(k)])

    def transform_oof(self, df: DataFrame) -> DataFrame:
        """Train rows: each row encoded from the other folds only (leakage-free)."""
        st = self.stats.oof_stats().withColumnRenamed("fold", self.fold_col)
        pri = self.stats.prior_by_fold
        return self._apply(df, st, [self.stats.col, self.fold_col], lambda i: _prior_col(pri, self.fold_col, i))

    def transform(self, df: DataFrame) -> DataFrame:
        """New rows (test): the full-train map; unseen or NULL category -> prior."""
        pa = self.stats.prior_all
        return self._apply(df, self.stats.full_stats(), [self.stats.col], lambda i: F.lit(pa[i]))


class FoldTargetEncoder(Estimator):
    """Smoothed target encoding, fold-aware; one feature per class (mean of the indicator).

    value = prior (1 - w) + mean w,  w = 1 / (1 + exp(-(n - min_samples_leaf) / smoothing)),
    a category seen once takes the prior.  Train statistics for fold f = totals - fold f,
    from a single ``groupBy(category, fold)``.
    """

    def __init__(self, col: str, y: str, classes: Sequence[str], fold_col: str = "fold",
                 min_samples_leaf: int = 20, smoothing: float = 10.0, suffix: str = "te"):
        self.col, self.y, self.classes, self.fold_col = col, y, list(classes), fold_col
        self.min_samples_leaf, self.smoothing, self.suffix = min_samples_leaf, smoothing, suffix

    def fit(self, df):
        st = FoldCategoryStats.fit(df, self.col, self.y, self.classes, self.fold_col)
        names = [f"{self.col}_{self.suffix}_{k}" for k in self.classes]
        return CategoryEncoderModel(st, "smooth", 0.0, self.min_samples_leaf, self.smoothing, self.fold_col, names)


class MEstimateEncoder(Estimator):
    """Cross-fit m-estimate ``(sum_y + m prior) / (n + m)``; unseen -> prior."""

    def __init__(self, col: str, y: str, classes: Sequence[str], fold_col: str = "fold", m: float = 5.0, suffix: str = "me"):
        self.col, self.y, self.classes, self.fold_col, self.m, self.suffix = col, y, list(classes), fold_col, m, suffix

    def fit(self, df):
        st = FoldCategoryStats.fit(df, self.col, self.y, self.classes, self.fold_col)
        names = [f"{self.col}_{self.suffix}_{k}" for k in self.classes]
        return CategoryEncoderModel(st, "mestimate", self.m, 0, 1.0, self.fold_col, names)

    @staticmethod
    def fit_many(df, cols, y, classes, fold_col="fold", m=5.0, suffix="me") -> dict[str, CategoryEncoderModel]:
        """Encoders for several columns fitted from one scan."""
        stats = FoldCategoryStats.fit_many(df, cols, y, classes, fold_col)
        return {c: CategoryEncoderModel(stats[c], "mestimate", m, 0, 1.0, fold_col, [f"{c}_{suffix}_{k}" for k in classes])
                for c in cols}


# --------------------------------------------------------------------------- E12
def balanced_class_weights(df: DataFrame, y: str, fold_col: str = "fold") -> DataFrame:
    """``n / (k n_c)`` over the training rows of each fold (every fold but f).

    Returns ``(fold, y, weight)``; fold -1 holds the weights of the whole table.  One
    ``groupBy(fold, y).count`` (folds x classes rows); the rest is arithmetic on it.
    """
    counts = {(r["fold"], r["y"]): r["n"] for r in df.groupBy(
        F.col(fold_col).alias("fold"), F.col(y).cast("string").alias("y")).agg(F.count("*").alias("n")).collect()}
    folds = sorted({f for f, _ in counts})
    classes = sorted({c for _, c in counts})
    rows = []
    for f in [-1, *folds]:
        per_class = {c: sum(n for (g, k), n in counts.items() if k == c and g != f) for c in classes}
        present_c = {c: n for c, n in per_class.items() if n > 0}
        total = sum(present_c.values())
        for c, n in present_c.items():
            rows.append((f, c, total / (len(present_c) * n)))
    return df.sparkSession.createDataFrame(rows, "fold int, y string, weight double")


# --------------------------------------------------------------------------- E13 / E14
def decode_argmax(preds: DataFrame, dictionary: DataFrame, probs: str = "probs", as_label: bool = True) -> DataFrame:
    """First-max class code of a probability array, optionally mapped to its label."""
    out = preds.withColumn("pred_code", argmax_index(probs))
    if not as_label:
        return out
    d = dictionary.select(F.col("code").alias("pred_code"), F.col("label").alias("pred_label"))
    return join_fitted(out, d, "pred_code", dictionary.count(), "left")


def embedding_sizes(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """``(column, n_unique, emb_dim = min(50, (n_unique + 1) div 2))``; NULL counts as a value."""
    from tabspark.operators.cross import cardinalities  # one job over stacked (column, value) pairs

    card = cardinalities(df, cats, count_null=True)
    spark = df.sparkSession
    return spark.createDataFrame(
        [(c, int(card[c]), min(50, (int(card[c]) + 1) // 2)) for c in cats], "column string, n_unique long, emb_dim int"
    )
