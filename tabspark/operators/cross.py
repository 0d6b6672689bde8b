"""Feature crosses C1-C9."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.functions.exprs import as_float
from tabspark.operators.base import Estimator, Model, log, present_pairs
from tabspark.operators.joins import join_fitted
from tabspark.operators.quantile import group_quantiles
from tabspark.operators.transform import with_columns
from tabspark.session import materialise_small

NUMERIC_TYPES = {"float", "double", "tinyint", "smallint", "int", "bigint"}
STRING_TYPES = {"string"}
VALID_STATS = ("mean", "std", "median", "min", "max")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() in NUMERIC_TYPES and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() in STRING_TYPES and f.name not in exclude]


# --------------------------------------------------------------------------- C1-C3
@dataclass
class NumNumModel(Model):
    pairs: list[tuple[str, str]]

    def transform(self, df):
        pairs = present_pairs(df, self.pairs, "num_num_interact")
        return with_columns(
            df, {f"{a}_x_{b}": as_float(F.col(a).cast("double") * F.col(b).cast("double")) for a, b in pairs}
        )


def top_variance_columns(df: DataFrame, cols: Sequence[str], n: int) -> list[str]:
    """Top-n columns by sample variance (one aggregate); ties keep schema order."""
    row = {}
    for i in range(0, len(cols), 50):
        row.update(df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in cols[i:i + 50]]).first().asDict())
    order = sorted(range(len(cols)), key=lambda i: (-(row[cols[i]] if row[cols[i]] is not None else -math.inf), i))
    return [cols[i] for i in order[:n]]


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Pearson r over pairwise-complete rows for many pairs (one aggregate per 50 pairs).

    Built from ``covar_samp`` and ``stddev_samp`` on the rows where both are present
    (``F.corr`` raises under ANSI on a constant column); a constant column gives NaN.
    """
    if len(pairs) > 50:
        out = {}
        for i in range(0, len(pairs), 50):
            out.update(pair_correlations(df, pairs[i:i + 50]))
        return out
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        aggs += [
            F.covar_samp(x, y).alias(f"c{i}"),
            F.stddev_samp(F.when(both, x)).alias(f"sa{i}"),
            F.stddev_samp(F.when(both, y)).alias(f"sb{i}"),
        ]
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    out = {}
    for i, p in enumerate(pairs):
        c, sa, sb = row[f"c{i}"], row[f"sa{i}"], row[f"sb{i}"]
        out[p] = c / (sa * sb) if c is not None and sa and sb else float("nan")
    return out


class NumNumInteract(Estimator):
    """Products of numeric pairs; auto mode crosses the top-N variance columns;
    a pair with ``|r| > corr_threshold`` on train is skipped (NaN r never exceeds it)."""

    def __init__(self, pairs=None, auto_top_n: int | None = None, corr_threshold: float = 0.0, exclude=()):
        self.pairs, self.auto_top_n, self.corr_threshold, self.exclude = pairs, auto_top_n, corr_threshold, list(exclude)

    def fit(self, df):
        pairs = self.pairs
        if pairs is None and self.auto_top_n is not None:
            top = top_variance_columns(df, numeric_columns(df, self.exclude), self.auto_top_n)
            pairs = list(itertools.combinations(top, 2))
        pairs = present_pairs(df, pairs or [], "num_num_interact")
        if self.corr_threshold > 0.0 and pairs:
            r = pair_correlations(df, pairs)
            kept = []
            for p in pairs:
                if not math.isnan(r[p]) and abs(r[p]) > self.corr_threshold:
                    log.info("num_num_interact: %s x %s skipped (r=%.3f)", p[0], p[1], r[p])
                else:
                    kept.append(p)
            pairs = kept
        return NumNumModel(pairs)


# --------------------------------------------------------------------------- C4-C6
def cardinalities(df: DataFrame, cols: Sequence[str], count_null: bool = True, approx: bool = False) -> dict[str, int]:
    """Distinct values per column in one job: stack ``(column, value)`` pairs and count distinct pairs.

    Avoids the Expand of one ``count(DISTINCT)`` per column (row blow-up x columns).
    NULL counts as one value when ``count_null`` (pandas ``nunique(dropna=False)``).
    """
    cols = list(cols)
    if not cols:
        return {}
    if approx:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
        nulls = df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first() if count_null else None
        return {c: int(row[c]) + (int(nulls[c] or 0) if nulls else 0) for c in cols}
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"), F.col(c).isNull().alias("z"))
                            for c in cols])).alias("s")
    ).select("s.k", "s.v", "s.z")
    if not count_null:
        stacked = stacked.where(~F.col("z"))
    got = {r["k"]: r["n"] for r in stacked.distinct().groupBy("k").agg(F.count("*").alias("n")).collect()}
    return {c: int(got.get(c, 0)) for c in cols}


@dataclass
class CatCatModel(Model):
    pairs: list[tuple[str, str]]
    sep: str
    low_card_cols: list[str]
    high_card_cols: list[str]

    def transform(self, df):
        new = {}
        for a, b in self.pairs:
            # concat_ws would silently skip NULL; pandas renders a missing value as 'nan'
            new[f"{a}{self.sep}{b}"] = F.concat(
                F.coalesce(F.col(a).cast("string"), F.lit("nan")), F.lit(self.sep), F.coalesce(F.col(b).cast("string"), F.lit("nan"))
            )
        return with_columns(df, new)


class CatCatInteract(Estimator):
    """Compound labels ``{a}{sep}{b}``; a pair is skipped when ``nunique(a) * nunique(b)``
    (NULL counted) exceeds ``max_combined_cardinality``; created columns are split by their
    observed train cardinality into low / high lists (threshold defaults to the cap)."""

    def __init__(self, pairs=None, auto_all=False, max_combined_cardinality=200, low_card_threshold=None, sep="__", exclude=()):
        self.pairs, self.auto_all, self.cap = pairs, auto_all, max_combined_cardinality
        self.low = max_combined_cardinality if low_card_threshold is None else low_card_threshold
        self.sep, self.exclude = sep, list(exclude)

    def fit(self, df):
        pairs = self.pairs
        if pairs is None:
            pairs = list(itertools.combinations(string_columns(df, self.exclude), 2)) if self.auto_all else []
        pairs = present_pairs(df, pairs, "cat_cat_interact")
        card = cardinalities(df, sorted({c for p in pairs for c in p}))
        kept = [(a, b) for a, b in pairs if card[a] * card[b] <= self.cap]
        model = CatCatModel(kept, self.sep, [], [])
        names = [f"{a}{self.sep}{b}" for a, b in kept]
        observed = cardinalities(model.transform(df.select(*sorted({c for p in kept for c in p}))), names)
        model.low_card_cols = [n for n in names if observed[n] <= self.low]
        model.high_card_cols = [n for n in names if observed[n] > self.low]
        return model


# --------------------------------------------------------------------------- C7 / C8
@dataclass
class NumCatModel(Model):
    pairs: list[tuple[str, str]]
    stats: list[str]
    tables: dict[tuple[str, str], tuple[DataFrame, int]]  # per pair: (cat key, stat columns), rows
    globals_: dict[tuple[str, str], dict[str, float]]

    def transform(self, df):
        out = df
        new_names = []
        for (num, cat) in self.pairs:
            if num not in df.columns or cat not in df.columns:
                continue
            table, rows = self.tables[(num, cat)]
            key = f"__k_{num}_{cat}"
            t = table.select(F.col("key").alias(key), *[F.col(s).alias(f"__{s}_{num}_{cat}") for s in self.stats])
            out = join_fitted(out.withColumn(key, F.col(cat).cast("string")), t, key, rows, "left").drop(key)
            rep = {}
            for s in self.stats:
                name = f"{num}_by_{cat}_{s}"
                g = self.globals_[(num, cat)][s]
                rep[name] = as_float(F.coalesce(F.col(f"__{s}_{num}_{cat}"), F.lit(g)))
                new_names.append(name)
            out = with_columns(out, rep).drop(*[f"__{s}_{num}_{cat}" for s in self.stats])
        return out


class NumCatInteract(Estimator):
    """C7 + C8: per-category statistic of a numeric column fitted on train and mapped to any
    frame; a group with fewer than ``min_samples_leaf`` non-null values, an unseen or a NULL
    category (or a NULL group statistic) takes the global train statistic."""

    def __init__(self, pairs, stats: Sequence[str] = ("mean", "std"), min_samples_leaf: int = 10):
        bad = set(stats) - set(VALID_STATS)
        if bad:
            raise ValueError(f"no such group statistic: {bad} (known: {', '.join(VALID_STATS)})")
        self.pairs, self.stats, self.min_samples_leaf = list(pairs), list(stats), min_samples_leaf

    def fit(self, df):
        """One aggregate over all pairs stacked, and one quantile search each for the groups' and the global medians; the
        other global values are merged from the groups, so no pair scans the table by itself."""
        pairs = present_pairs(df, self.pairs, "num_cat_interact")
        if not pairs:
            return NumCatModel([], self.stats, {}, {})
        stacked = df.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("pair"), F.col(cat).cast("string").alias("key"), F.col(num).cast("double").alias("v")) for i, (num, cat) in enumerate(pairs)
        ])).alias("s")).select("s.*")
        groups = stacked.groupBy("pair", "key").agg(
            F.count("v").alias("__n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
        if "median" in self.stats:
            groups = groups.join(group_quantiles(stacked, "v", [0.5], ["pair", "key"]).select(
                F.col("pair").alias("__pair"), F.col("key").alias("__key"), F.col("value").alias("median")),
                (F.col("pair") == F.col("__pair")) & F.col("key").eqNullSafe(F.col("__key")), "left").drop("__pair", "__key")
        groups, _ = materialise_small(groups)  # a row a pair and category

        whole = Window.partitionBy("pair")
        n = F.col("__n").cast("double")
        centre = F.sum(n * F.col("mean")).over(whole) / F.sum(n).over(whole)
        spread = (n - 1) * F.coalesce(F.col("std"), F.lit(0.0)) ** 2 + n * (F.col("mean") - centre) ** 2
        merged = groups.withColumns({"__centre": centre, "__spread": F.when(F.col("__n") > 0, spread)}).groupBy("pair").agg(
            F.first("__centre").alias("mean"), F.sqrt(F.try_divide(F.sum("__spread"), F.when(F.sum("__n") > 1, F.sum(n) - 1))).alias("std"),
            F.min("min").alias("min"), F.max("max").alias("max"), F.count("key").alias("__rows"))
        globals_ = {r["pair"]: r.asDict() for r in merged.collect()}  # a row a pair
        if "median" in self.stats:
            for r in group_quantiles(stacked, "v", [0.5], ["pair"]).collect():
                globals_[r["pair"]]["median"] = r["value"]
        keep = F.col("__n") >= self.min_samples_leaf
        fitted = groups.where(F.col("key").isNotNull()).select("pair", "key", *[F.when(keep, F.col(s)).alias(s) for s in self.stats])
        empty = dict.fromkeys(self.stats)
        return NumCatModel(
            pairs, self.stats, {pair: (fitted.where(F.col("pair") == i).drop("pair"), globals_.get(i, {}).get("__rows", 0)) for i, pair in enumerate(pairs)},
            {pair: {s: globals_.get(i, empty).get(s) for s in self.stats} for i, pair in enumerate(pairs)})


def num_num_interact(df_train, df_test, pairs=None, auto_top_n=None, corr_threshold=0.0):
    return NumNumInteract(pairs, auto_top_n, corr_threshold).fit_transform_pair(df_train, df_test)


def cat_cat_interact(df_train, df_test, pairs=None, auto_all=False, max_combined_cardinality=200,
                     low_card_threshold=None, sep="__"):
    m = CatCatInteract(pairs, auto_all, max_combined_cardinality, low_card_threshold, sep).fit(df_train)
    return m.transform(df_train), m.transform(df_test), m.low_card_cols, m.high_card_cols


def num_cat_interact(df_train, df_test, pairs, stats=None, min_samples_leaf=10):
    return NumCatInteract(pairs, stats or ["mean", "std"], min_samples_leaf).fit_transform_pair(df_train, df_test)
