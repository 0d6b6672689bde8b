"""Profiling and association statistics G1-G32.

Every function returns a small DataFrame (statistics, not rows).  Per-column loops
of the original become one aggregate over all columns, or one job over the
``(column, value)`` stacked form; hot groups are handled by partial aggregation, the
distributed quantile search, and ``row_number() <= k`` filters that Spark plans as a
per-partition group limit before the shuffle.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabspark.functions.exprs import (
    bias_corrected_kurtosis,
    bias_corrected_skewness,
    fold_order_key,
    left_closed_bin,
)
from tabspark.operators.joins import join_fitted
from tabspark.operators.quantile import group_quantiles
from tabspark.operators.transform import stack_columns
from tabspark.operators.ranking import running_totals
from tabspark.session import cached, materialise_small


def _nn(c: str) -> Column:
    """numeric value with NaN as NULL"""
    x = F.col(c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


AGG_CHUNK = 50  # columns per aggregate: keeps generated code under the JVM method-size limits


def chunked(cols: Sequence, fn) -> DataFrame:
    """Union of ``fn(chunk)`` over column chunks (one aggregate job per chunk)."""
    cols = list(cols)
    out = None
    for i in range(0, max(len(cols), 1), AGG_CHUNK):
        part = fn(cols[i:i + AGG_CHUNK])
        out = part if out is None else out.unionByName(part)
    return out


def _rows_from_one(row_df: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn a one-row aggregate into a long table (one struct per output row)."""
    return row_df.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def stack_strings(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(*keep, column, value string)`` for categorical columns (NULL values kept)."""
    return df.select(
        *keep,
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("__s"),
    ).select(*keep, "__s.column", "__s.value")


# --------------------------------------------------------------------------- G1-G3, G30
def numeric_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """G1: mean, sample std, min, max, n_null per numeric column (one aggregate per 50 columns)."""
    if len(cols) > AGG_CHUNK:
        return chunked(cols, lambda c: numeric_stats(df, c))
    aggs = []
    for c in cols:
        x = _nn(c)
        aggs += [F.avg(x).alias(f"a_{c}"), F.stddev_samp(x).alias(f"s_{c}"), F.min(x).alias(f"lo_{c}"),
                 F.max(x).alias(f"hi_{c}"), F.sum(x.isNull().cast("long")).alias(f"n_{c}")]
    one = df.agg(*aggs)
    return _rows_from_one(one, [
        F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("mean"), F.col(f"s_{c}").alias("std"),
                 F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"), F.col(f"n_{c}").alias("n_null"))
        for c in cols])


def categorical_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n_unique (NULL excluded) and n_null per categorical column, one job over (column, value)."""
    st = stack_strings(df, cols)
    nulls = st.groupBy("column").agg(F.sum(F.col("value").isNull().cast("long")).alias("n_null"))
    uniq = st.where(F.col("value").isNotNull()).distinct().groupBy("column").agg(F.count("*").alias("n_unique"))
    return nulls.join(uniq, "column", "left").select("column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "n_null")


def integer_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n_unique, min, max, n_null per integer (code) column."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("long").alias(f"lo_{c}"), F.max(c).cast("long").alias(f"hi_{c}"),
                 F.sum(F.col(c).isNull().cast("long")).alias(f"n_{c}")]
    mm = _rows_from_one(df.agg(*aggs), [
        F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"),
                 F.col(f"n_{c}").alias("n_null")) for c in cols])
    uniq = categorical_stats(df, cols).select("column", "n_unique")
    return mm.join(uniq, "column").select("column", "n_unique", "min", "max", "n_null")


def drift_stats(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """G1 of two dataset versions joined on column, with differences."""
    sa = numeric_stats(a, cols).select("column", *[F.col(x).alias(f"{x}_a") for x in ("mean", "std", "min", "max", "n_null")])
    sb = numeric_stats(b, cols).select("column", *[F.col(x).alias(f"{x}_b") for x in ("mean", "std", "min", "max", "n_null")])
    j = sa.join(sb, "column", "full")
    return j.withColumn("mean_delta", F.col("mean_b") - F.col("mean_a")).withColumn(
        "std_ratio", F.try_divide(F.col("std_b"), F.col("std_a")))


# --------------------------------------------------------------------------- G4, G5, G6, G31
def class_balance(df: DataFrame, y: str) -> DataFrame:
    """Count, proportion % and ratio to the smallest class (window over the class table)."""
    c = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("class")).agg(F.count("*").alias("count"))
    w = Window.partitionBy()  # one row per class: tiny
    return c.select(
        "class", "count",
        (F.col("count") * 100.0 / F.sum("count").over(w)).alias("proportion_pct"),
        (F.col("count") / F.min("count").over(w)).alias("ratio_to_smallest"),
    )


def missing_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing count and % per column, non-zero only (NaN counts as missing)."""
    cols = list(cols or df.columns)
    if len(cols) > AGG_CHUNK:
        return chunked(cols, lambda c: missing_summary(df, c))
    aggs = [F.count("*").alias("__n")]
    for c in cols:
        t = df.schema[c].dataType.simpleString()
        miss = F.col(c).isNull() | (F.isnan(c) if t in ("float", "double") else F.lit(False))
        aggs.append(F.sum(miss.cast("long")).alias(f"m_{c}"))
    one = df.agg(*aggs)
    long = _rows_from_one(one, [F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("missing_count"),
                                         (F.col(f"m_{c}") * 100.0 / F.col("__n")).alias("missing_pct")) for c in cols])
    return long.where(F.col("missing_count") > 0)


def numeric_as_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n_unique, all-integer check, min, max per numeric column."""
    if len(cols) > AGG_CHUNK:
        return chunked(cols, lambda c: numeric_as_categorical(df, c))
    aggs = []
    for c in cols:
        x = _nn(c)
        aggs += [F.coalesce(F.bool_and(F.when(x.isNotNull(), x % 1 == 0)), F.lit(True)).alias(f"i_{c}"),
                 F.min(x).alias(f"lo_{c}"), F.max(x).alias(f"hi_{c}")]
    one = _rows_from_one(df.agg(*aggs), [
        F.struct(F.lit(c).alias("feature"), F.col(f"i_{c}").alias("is_integer"), F.col(f"lo_{c}").alias("min"),
                 F.col(f"hi_{c}").alias("max")) for c in cols])
    st = stack_columns(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    uniq = st.distinct().groupBy(F.col("column").alias("feature")).agg(F.count("*").alias("n_unique"))
    return one.join(uniq, "feature", "left").select(
        "feature", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "is_integer", "min", "max")


def dataset_overview(frames: dict[str, DataFrame], y: str | None = None) -> DataFrame:
    """Rows, columns and column kinds per frame, combined row count, target label set."""
    out = None
    for name, df in frames.items():
        kinds = [f.dataType.simpleString() for f in df.schema.fields if f.name != y]
        n_num = sum(k in ("float", "double") for k in kinds)
        n_int = sum(k in ("tinyint", "smallint", "int", "bigint") for k in kinds)
        n_str = sum(k == "string" for k in kinds)
        aggs = [F.count("*").alias("rows")]
        aggs.append(F.array_sort(F.collect_set(F.col(y).cast("string"))).alias("classes") if y and y in df.columns
                    else F.lit(None).cast("array<string>").alias("classes"))
        part = df.agg(*aggs).select(
            F.lit(name).alias("frame"), "rows", F.lit(len(df.columns)).alias("columns"),
            F.lit(n_num).alias("n_float"), F.lit(n_int).alias("n_int"), F.lit(n_str).alias("n_string"), "classes")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("combined_rows", F.sum("rows").over(Window.partitionBy()))


# --------------------------------------------------------------------------- G7 / G8
def univariate_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, median, std, bias-corrected skew and kurtosis, min, max, % zeros (NULL skipped)."""
    if len(cols) > AGG_CHUNK:
        return chunked(cols, lambda c: univariate_summary(df, c))
    aggs = []
    for c in cols:
        x = _nn(c)
        aggs += [F.count(x).alias(f"n_{c}"), F.avg(x).alias(f"a_{c}"), F.stddev_samp(x).alias(f"s_{c}"),
                 F.skewness(x).alias(f"g1_{c}"), F.kurtosis(x).alias(f"g2_{c}"), F.min(x).alias(f"lo_{c}"),
                 F.max(x).alias(f"hi_{c}"), F.sum((x == 0).cast("long")).alias(f"z_{c}")]
    one = _rows_from_one(df.agg(*aggs), [
        F.struct(
            F.lit(c).alias("column"), F.col(f"a_{c}").alias("mean"), F.col(f"s_{c}").alias("std"),
            bias_corrected_skewness(F.col(f"g1_{c}"), F.col(f"n_{c}")).alias("skew"),
            bias_corrected_kurtosis(F.col(f"g2_{c}"), F.col(f"n_{c}")).alias("kurtosis"),
            F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"),
            F.try_divide(F.col(f"z_{c}") * 100.0, F.col(f"n_{c}")).alias("pct_zeros"),
        ) for c in cols])
    med = group_quantiles(stack_columns(df, cols), "value", [0.5], ["column"]).select("column", F.col("value").alias("median"))
    return one.join(med, "column", "left").select("column", "mean", "median", "std", "skew", "kurtosis", "min", "max", "pct_zeros")


# --------------------------------------------------------------------------- G9-G11
def histogram(df: DataFrame, cols: Sequence[str], bins: int = 40, group_col: str | None = None) -> DataFrame:
    """Equal-width histogram between the (group's) min and max, top edge closed,
    every bin emitted (zero counts too); ``density = count / (n * width)``."""
    keep = [group_col] if group_col else []
    st = stack_columns(df, cols, keep).where(F.col("value").isNotNull() & ~F.isnan("value"))
    if group_col:
        st = st.where(F.col(group_col).isNotNull())
    keys = ["column", *keep]
    rng = st.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    idx = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo"))).cast("int"), F.lit(bins - 1)))
    rng, n_rng = materialise_small(rng)  # one row per column and group
    counts = join_fitted(st, rng, keys, n_rng).select(*keys, idx.alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("count"))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.try_divide(F.coalesce("count", F.lit(0)).cast("double"), F.col("n") * width).alias("density"),
    )
    return out


KDE_TERMS = 15  # powers of at most 1/4 of a bandwidth: what is left out is below 1e-14 of a kernel's height


def _hermite(n: int) -> list[list[int]]:
    """Coefficients by power of the polynomials He_0 .. He_{n-1}: He_{k+1}(t) = t He_k(t) - k He_{k-1}(t)."""
    out = [[1], [0, 1]]
    for k in range(1, n - 1):
        up, down = [0, *out[k]], out[k - 1] + [0, 0]
        out.append([a - k * b for a, b in zip(up, down)])
    return out[:n]


def kde(df: DataFrame, cols: Sequence[str], grid_points: int = 300, group_col: str | None = None) -> DataFrame:
    """Gaussian KDE (Scott bandwidth ``std * n^(-1/5)``, sample std) on an even grid
    between the (group's) min and max.  Groups with zero spread are skipped, as in the original.

    Rows are summed up by cells of half a bandwidth, each by the powers of its distance d to the cell's middle: the kernel of a
    row seen from t bandwidths away is exp(-t^2 / 2) times the sum of He_k(t) d^k / k!, so a cell's sums give its rows' kernels at every
    grid point, to rounding.  One scan, no exponential a row; map-side aggregation leaves a row a cell and task.
    """
    keep = [group_col] if group_col else []
    st = stack_columns(df, cols, keep).where(F.col("value").isNotNull() & ~F.isnan("value"))
    if group_col:
        st = st.where(F.col(group_col).isNotNull())
    keys = ["column", *keep]
    m = st.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"),
                              F.stddev_samp("value").alias("sd"))
    m = m.where(F.col("sd") > 0).select(
        *keys, "lo", "n", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
        ((F.col("hi") - F.col("lo")) / F.lit(float(grid_points - 1))).alias("step"))
    m, n_m = materialise_small(m)  # one row per column and group
    j = join_fitted(st, m, keys, n_m).withColumn("cell", F.floor((F.col("value") - F.col("lo")) / F.col("h") * 2))
    j = j.withColumn("d", (F.col("value") - F.col("lo")) / F.col("h") - (F.col("cell") + 0.5) / 2)
    power, powers = F.lit(1.0), []
    for _ in range(KDE_TERMS):
        powers.append(power)
        power = power * F.col("d")
    sums = j.groupBy(*keys, "cell").agg(*[F.sum(p).alias(f"s{k}") for k, p in enumerate(powers)])
    # the sum of He_k(t) s_k / k! as one polynomial in t
    table, by_power = _hermite(KDE_TERMS), []
    for power in range(KDE_TERMS):
        by_power.append(sum((F.col(f"s{k}") * F.lit(table[k][power] / math.factorial(k)) for k in range(KDE_TERMS) if power < len(table[k]) and table[k][power]), F.lit(0.0)))
    cells = join_fitted(sums, m, keys, n_m).select(*keys, "lo", "step", "h", "n", "cell", *[c.alias(f"c{p}") for p, c in enumerate(by_power)])
    at = cells.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))))
    at = at.withColumn("t", F.col("g") * F.col("step") / F.col("h") - (F.col("cell") + 0.5) / 2)
    poly = F.col(f"c{KDE_TERMS - 1}")
    for power in range(KDE_TERMS - 2, -1, -1):
        poly = poly * F.col("t") + F.col(f"c{power}")
    kernel = F.exp(-F.col("t") * F.col("t") / 2)
    out = at.groupBy(*keys, "lo", "step", "h", "n", "g").agg(F.sum(F.when(kernel > 0, kernel * poly).otherwise(0.0)).alias("ks"))
    return out.select(
        *keys, F.col("g").alias("point"), (F.col("lo") + F.col("g") * F.col("step")).alias("x"),
        (F.greatest("ks", F.lit(0.0)) / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


# --------------------------------------------------------------------------- G12, G13
def top_values(df: DataFrame, cols: Sequence[str], top_n: int = 15) -> DataFrame:
    """Top-N value counts per column (count desc, value asc); NULL excluded."""
    st = stack_strings(df, cols).where(F.col("value").isNotNull())
    c = st.groupBy("column", "value").agg(F.count("*").alias("count"))
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def cardinality_overview(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n_unique, most frequent value (ties: smallest value) and its % of non-null rows."""
    st = stack_strings(df, cols).where(F.col("value").isNotNull())
    c = st.groupBy("column", "value").agg(F.count("*").alias("count"))
    return c.groupBy("column").agg(
        F.count("*").alias("n_unique"),
        F.min_by("value", F.struct(-F.col("count"), "value")).alias("top_value"),
        (F.max("count") * 100.0 / F.sum("count")).alias("top_pct"),
    )


# --------------------------------------------------------------------------- G14, G15
def pearson_matrix(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Pearson r for every ordered column pair over pairwise-complete rows (one aggregate per
    50 pairs)."""
    if pairs is None:
        all_pairs = list(itertools.combinations(cols, 2))
        # a column is fully correlated with itself unless it is constant (NULL, as for any pair with it)
        diag = chunked(list(cols), lambda cs: _rows_from_one(
            df.agg(*[F.stddev_samp(_nn(c)).alias(f"s{i}") for i, c in enumerate(cs)]),
            [F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.when(F.col(f"s{i}") > 0, F.lit(1.0)).alias("r")) for i, c in enumerate(cs)]))
        if not all_pairs:
            return diag
        return chunked(all_pairs, lambda ps: pearson_matrix(df, cols, ps)).unionByName(diag)
    pairs = list(pairs)
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = _nn(a), _nn(b)
        both = x.isNotNull() & y.isNotNull()
        aggs += [F.covar_samp(x, y).alias(f"c{i}"), F.stddev_samp(F.when(both, x)).alias(f"sa{i}"),
                 F.stddev_samp(F.when(both, y)).alias(f"sb{i}")]
    one = df.agg(*aggs)
    structs = []
    for i, (a, b) in enumerate(pairs):
        r = F.try_divide(F.col(f"c{i}"), F.col(f"sa{i}") * F.col(f"sb{i}"))
        structs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("r")))
        structs.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), r.alias("r")))
    return _rows_from_one(one, structs)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b): the power series
    ``x^a (1-x)^b / (a B(a, b)) * sum_n prod_{k<n} (a + b + k) / (a + 1 + k) * x^n`` on the side
    of the mean where its terms fall, the complement on the other."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x * (a + b + 2) > a + 1:
        return 1.0 - betainc(b, a, 1.0 - x)
    log_front = a * math.log(x) + b * math.log1p(-x) - math.log(a) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    total = term = 1.0
    k = 0
    while term > total * 1e-17:
        term *= x * (a + b + k) / (a + 1 + k)
        total += term
        k += 1
    return math.exp(log_front + math.log(total))


def f_survival(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F(d1, d2) distribution."""
    if f is None or math.isnan(f):
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def anova_table(df: DataFrame, cols: Sequence[str], y: str, with_p: bool = True) -> DataFrame:
    """One-way ANOVA per numeric column vs class: F, eta^2 (and p on the driver from
    the tiny per-class table).  Columns where a class has < 2 values are skipped."""
    st = stack_columns(df.where(F.col(y).isNotNull()), cols, [y]).where(F.col("value").isNotNull() & ~F.isnan("value"))
    g = st.groupBy("column", y).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    w = Window.partitionBy("column")  # classes per column: tiny
    g = g.withColumn("ntot", F.sum("n").over(w)).withColumn("k", F.count("*").over(w)).withColumn(
        "gm", F.sum(F.col("n") * F.col("m")).over(w) / F.col("ntot")).withColumn("min_n", F.min("n").over(w))
    t = g.groupBy("column").agg(
        F.first("ntot").alias("ntot"), F.first("k").alias("k"), F.first("min_n").alias("min_n"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ssb"),
        F.sum(F.coalesce(F.col("v"), F.lit(0.0)) * (F.col("n") - 1)).alias("ssw"),
    ).where(F.col("min_n") >= 2)
    out = t.select(
        F.col("column").alias("feature"),
        F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("ntot") - F.col("k"))).alias("f_stat"),
        F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta_sq"),
        (F.col("k") - 1).alias("df_between"), (F.col("ntot") - F.col("k")).alias("df_within"),
    )
    if not with_p:
        return out
    rows = out.collect()  # one row per column
    spark = df.sparkSession
    return spark.createDataFrame(
        [(r["feature"], r["f_stat"], f_survival(r["f_stat"], r["df_between"], r["df_within"]), r["eta_sq"],
          int(r["df_between"]), int(r["df_within"])) for r in rows],
        "feature string, f_stat double, p_value double, eta_sq double, df_between long, df_within long")


# --------------------------------------------------------------------------- G16, G17, G20
def _dbl(c: str):
    """A count as a double: products of counts pass the range of a bigint."""
    return F.col(c).cast("double")


def _pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Contingency counts for many column pairs in one job: ``(a, b, va, vb, n)``; NULL rows dropped."""
    st = df.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("va"), F.col(b).cast("string").alias("vb"))
        for a, b in pairs])).alias("s")).select("s.*").where(F.col("va").isNotNull() & F.col("vb").isNotNull())
    return st.groupBy("a", "b", "va", "vb").agg(F.count("*").alias("n"))


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Cramer's V per pair, no continuity or bias correction.

    chi2 over the full r x k grid equals ``sum_observed(o^2 / e) - n`` (empty cells add
    their expected count to both sums), so only observed cells are needed.
    """
    c = _pair_counts(df, pairs)
    ra = c.groupBy("a", "b", "va").agg(F.sum("n").alias("na"))
    rb = c.groupBy("a", "b", "vb").agg(F.sum("n").alias("nb"))
    tot = c.groupBy("a", "b").agg(F.sum("n").alias("tot_n"))
    j = c.join(ra, ["a", "b", "va"]).join(rb, ["a", "b", "vb"]).join(tot, ["a", "b"])
    chi = j.groupBy("a", "b").agg(
        F.sum(_dbl("n") * _dbl("n") / _dbl("na") * _dbl("tot_n") / _dbl("nb")).alias("s"), F.first("tot_n").alias("tot_n"))
    dims = c.groupBy("a", "b").agg(F.countDistinct("va").alias("r"), F.countDistinct("vb").alias("k"))
    out = chi.join(dims, ["a", "b"])
    denom = F.least(F.col("r"), F.col("k")) - 1
    v = F.when((F.col("r") < 2) | (F.col("k") < 2), F.lit(0.0)).otherwise(
        F.sqrt(F.greatest((F.col("s") - F.col("tot_n")) / F.col("tot_n"), F.lit(0.0)) / denom))
    return out.select(F.col("a").alias("col_a"), F.col("b").alias("col_b"), v.alias("cramers_v"))


def cramers_ranking(df: DataFrame, cats: Sequence[str], y: str) -> DataFrame:
    """The columns ranked by Cramer's V with the target: ``(feature, cramers_v, rank)``."""
    v = cramers_v(df, [(c, y) for c in cats]).select(F.col("col_a").alias("feature"), "cramers_v")
    return v.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cramers_v"), "feature")))  # a row a column


def mutual_information(df: DataFrame, y: str, cats: Sequence[str], nums: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) with the target.

    Categorical features: exact plug-in estimate from the contingency table.  Numeric
    features take the same plug-in estimate on ``bins`` equal-width bins (``knn_mutual_information`` is the
    nearest-neighbour estimate).
    Rows with a NULL in any used column are dropped, as in the original.
    """
    used = [y, *cats, *nums]
    d = df.select(*used).dropna()
    sel = [F.col(y).cast("string").alias(y)] + [F.col(c).cast("string").alias(c) for c in cats]
    if nums:
        rng = d.agg(*[F.min(c).alias(f"lo_{c}") for c in nums], *[F.max(c).alias(f"hi_{c}") for c in nums]).first()
        for c in nums:
            lo, hi = rng[f"lo_{c}"], rng[f"hi_{c}"]
            b = F.lit(0) if hi == lo else F.least(
                F.floor((F.col(c) - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)).cast("int"), F.lit(bins - 1))
            sel.append(b.cast("string").alias(c))
    feats = [*cats, *nums]
    c = _pair_counts(d.select(*sel), [(f, y) for f in feats])
    ra = c.groupBy("a", "va").agg(F.sum("n").alias("na"))
    rb = c.groupBy("a", "vb").agg(F.sum("n").alias("nb"))
    tot = c.groupBy("a").agg(F.sum("n").alias("tot_n"))
    j = c.join(ra, ["a", "va"]).join(rb, ["a", "vb"]).join(tot, "a")
    term = (F.col("n") / F.col("tot_n")) * F.log(_dbl("n") / _dbl("na") * _dbl("tot_n") / _dbl("nb"))
    kinds = F.when(F.col("a").isin(list(cats)), F.lit("discrete")).otherwise(F.lit("binned"))
    return j.groupBy("a").agg(F.sum(term).alias("mi")).select(F.col("a").alias("feature"), kinds.alias("kind"), "mi")


EULER_GAMMA = 0.5772156649015329  # fixed value


def digamma(n: Column) -> Column:
    """The digamma function of a positive integer: harmonic numbers below 20, the asymptotic series from there (to rounding)."""
    small, total = [], 0.0
    for k in range(1, 20):
        small.append(total - EULER_GAMMA)
        total += 1.0 / k
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n < 20, F.get(F.array(*[F.lit(v) for v in small]), (n - 1).cast("int"))).otherwise(series)


def knn_mutual_information(df: DataFrame, y: str, nums: Sequence[str], k: int = 3) -> DataFrame:
    """Nearest-neighbour mutual information (nats) of numeric features with a discrete target: columns feature, n_rows, mi.

    For a row, d is the distance to its ``k``-th nearest neighbour of the same class (fewer in a class of at most k rows) and m the
    number of rows of any class nearer than d, itself included; mi = psi(N) + mean psi(k) - mean psi(N_class) - mean psi(m), at
    least 0.  Rows of classes with a single row, and rows with a NULL (or NaN) value or class, are left out, feature by feature.

    In one dimension the k nearest are among the k rows on either side in the order of the class.  Rows are dealt to codes
    (``with_codes``), and every code also gets the k rows before and behind it, so a window inside the code sees them.  The number
    nearer than d is a difference of positions: both ends of the interval are put among the rows of all classes and counted up to."""
    st = stack_columns(df.where(F.col(y).isNotNull()), nums, [y, "row_id"]).where(F.col("value").isNotNull() & ~F.isnan("value"))
    st = st.select("column", F.col(y).cast("string").alias("y"), "row_id", "value")
    sizes, n_sizes = materialise_small(st.groupBy("column", "y").agg(F.count("*").alias("n_class")).where("n_class > 1")
                                       .withColumn("n_all", F.sum("n_class").over(Window.partitionBy("column"))))  # a row a feature and class
    rows = join_fitted(st, sizes, ["column", "y"], n_sizes)
    placed = running_totals(rows.withColumn("one", F.lit(1)), ["column", "y"], ["value", "row_id"], ["one"], keep_code=True)
    placed = cached(placed.withColumnRenamed("__before_one", "at"))

    # the k rows before and behind each code, by their places in the class
    bounds = placed.groupBy("column", "y", "__code").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    near = F.concat(*[F.array(F.col("first") - i, F.col("last") + i) for i in range(1, k + 1)])
    asked, n_asked = materialise_small(bounds.select("column", "y", F.col("__code").alias("__to"), F.explode(near).alias("at")))  # 2 k rows a code
    halo = join_fitted(placed, asked, ["column", "y", "at"], n_asked).select("column", "y", F.col("__to").alias("__code"), "value", "at", F.lit(None).cast("long").alias("row_id"), "n_class", "n_all")
    both = placed.select("column", "y", "__code", "value", "at", F.col("row_id").cast("long").alias("row_id"), "n_class", "n_all").unionByName(halo)
    order = Window.partitionBy("column", "y", "__code").orderBy("at")
    own_k = F.least(F.lit(k).cast("long"), F.col("n_class") - 1)
    sides = both.withColumns({f"l{i}": F.lag("value", i).over(order) for i in range(1, k + 1)} | {f"r{i}": F.lead("value", i).over(order) for i in range(1, k + 1)})
    sides = sides.where("row_id IS NOT NULL").withColumn("k", own_k)
    # i neighbours on the left and k - i on the right: the least reach of all choices; where it ends is a neighbour's own value
    choices = []
    for n in range(1, k + 1):
        for i in range(n + 1):
            left = F.col("value") - F.col(f"l{i}") if i else F.lit(0.0)
            right = F.col(f"r{n - i}") - F.col("value") if n - i else F.lit(0.0)
            there = F.lit(True) if not i else F.col(f"l{i}").isNotNull()
            there = there if not n - i else there & F.col(f"r{n - i}").isNotNull()
            end = F.struct(F.greatest(left, right).alias("d"), F.when(left >= right, F.col(f"l{i}") if i else F.col("value")).alias("low"), F.when(right >= left, F.col(f"r{n - i}") if n - i else F.col("value")).alias("high"))
            choices.append(F.when(there & (F.col("k") == n), end))
    best = F.array_min(F.array_compact(F.array(*choices)))
    reach = sides.withColumn("b", best).select(
        "column", "row_id", "y", "value", "k", "n_class", "n_all", F.coalesce("b.low", F.col("value") - F.col("b.d")).alias("low"), F.coalesce("b.high", F.col("value") + F.col("b.d")).alias("high"), (F.col("b.d") == 0).alias("zero"))

    # rows of any class strictly between the two ends: rows before the upper end less rows up to the lower one
    # (a row at distance 0 from its k-th neighbour has no one nearer but itself)
    null = F.lit(None).cast("long")
    points = rows.select("column", F.col("value").alias("v"), F.lit(1).alias("kind"), F.col("row_id").cast("long").alias("id"), "y", F.lit(1).alias("w"))
    ends = reach.where("NOT zero").select("column", F.explode(F.array(F.struct(F.col("low").alias("v"), F.lit(2).alias("kind")), F.struct(F.col("high").alias("v"), F.lit(0).alias("kind")))).alias("s"), F.col("row_id").alias("id"), "y")
    ends = ends.select("column", "s.v", "s.kind", "id", "y", F.lit(0).alias("w"))
    counted = running_totals(points.unionByName(ends), ["column"], ["v", "kind", "id"], ["w"]).where("w = 0")
    inside = counted.groupBy("column", "id").agg(F.sum(F.when(F.col("kind") == 0, F.col("__before_w")).otherwise(-F.col("__before_w"))).alias("m"))
    whole = reach.select("column", F.col("row_id").alias("id"), "k", "n_class", "n_all", "zero").join(inside, ["column", "id"], "left")
    m = F.when(F.col("zero"), F.lit(1).cast("long")).otherwise(F.greatest(F.col("m"), F.lit(1).cast("long")))
    mean = whole.groupBy("column").agg(F.count("*").alias("n_rows"), F.avg(digamma(F.col("k"))).alias("k"), F.avg(digamma(F.col("n_class"))).alias("c"), F.avg(digamma(m)).alias("m"))
    mi = digamma(F.col("n_rows")) + F.col("k") - F.col("c") - F.col("m")
    return mean.select(F.col("column").alias("feature"), "n_rows", F.greatest(mi, F.lit(0.0)).alias("mi"))


# --------------------------------------------------------------------------- G18, G21-G23
def class_rate_by_category(df: DataFrame, feature: str, y: str, target_class, top_n: int | None = None) -> DataFrame:
    """P(y == class | category) and row count per category (NULL category dropped),
    optional top-N categories by count; also the overall rate."""
    is_c = F.coalesce((F.col(y).cast("string") == F.lit(str(target_class))).cast("double"), F.lit(0.0))
    g = df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).cast("string").alias("category")).agg(
        F.avg(is_c).alias("rate"), F.count("*").alias("count"))
    if top_n is not None:
        g = g.orderBy(F.desc("count"), "category").limit(top_n)  # distributed top-k
    overall = df.agg(F.avg(is_c).alias("overall_rate"))
    rate = overall.first()["overall_rate"]  # one number
    return g.withColumn("overall_rate", F.lit(rate))


def class_rate_grid(df: DataFrame, f1: Column | str, f2: Column | str, y: str, classes: Sequence[str],
                    names: tuple[str, str] = ("f1", "f2")) -> DataFrame:
    """P(y == class | f1, f2) for every class, long form ``(class, f1, f2, rate, count)``.

    ``f1``/``f2`` may be binned expressions (``left_closed_bin``); rows whose bin is NULL
    (outside the edges) are dropped, as ``groupby`` drops NaN keys.
    """
    a = F.col(f1) if isinstance(f1, str) else f1
    b = F.col(f2) if isinstance(f2, str) else f2
    base = df.select(a.cast("string").alias(names[0]), b.cast("string").alias(names[1]), F.col(y).cast("string").alias("__y"))
    base = base.where(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull())
    g = base.groupBy(*names).agg(F.count("*").alias("count"), *[
        F.avg((F.col("__y") == F.lit(c)).cast("double")).alias(f"r_{i}") for i, c in enumerate(classes)])
    return g.select(*names, "count", F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(f"r_{i}").alias("rate")) for i, c in enumerate(classes)])).alias("s")).select(
        F.col("s.class").alias("class"), *names, F.col("s.rate").alias("rate"), "count")


def binned(c: str, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Left-closed ``[lo, hi)`` bins; outside the edges -> NULL."""
    return left_closed_bin(c, edges, labels)


# --------------------------------------------------------------------------- G19, G25-G29
def quartile_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5, group_col: str | None = None) -> DataFrame:
    """Q1, Q3 and the ``k * IQR`` fences per column (and group): exact distributed quantiles."""
    keep = [group_col] if group_col else []
    st = stack_columns(df, cols, keep)
    if group_col:
        st = st.where(F.col(group_col).isNotNull())
    q = group_quantiles(st, "value", [0.25, 0.75], ["column", *keep])
    p = q.groupBy("column", *keep).agg(F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q1"),
                                       F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q3"))
    return p.withColumn("lo", F.col("q1") - k * (F.col("q3") - F.col("q1"))).withColumn(
        "hi", F.col("q3") + k * (F.col("q3") - F.col("q1")))


def box_stats(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Per class n, min, Q1, median, Q3, max of each numeric column."""
    st = stack_columns(df.where(F.col(y).isNotNull()), cols, [y]).where(F.col("value").isNotNull() & ~F.isnan("value"))
    q = group_quantiles(st, "value", [0.25, 0.5, 0.75], ["column", y])
    p = q.groupBy("column", y).agg(*[F.max(F.when(F.col("q") == qq, F.col("value"))).alias(n)
                                     for qq, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    mm = st.groupBy("column", y).agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))
    return mm.join(p, ["column", y]).select("column", F.col(y).alias("class"), "n", "min", "q1", "median", "q3", "max")


def class_sample(df: DataFrame, y: str, cols: Sequence[str], max_rows: int = 500, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """G19 jitter sample: at most ``max_rows`` seeded rows per class (a sampling operator;
    ``row_number() <= k`` is planned as a per-partition group limit before the shuffle)."""
    w = Window.partitionBy(y).orderBy(fold_order_key(row_id, seed), row_id)
    return df.select(row_id, y, *cols).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max_rows).drop("__r")


def outlier_flags(df: DataFrame, cols: Sequence[str], k: float = 1.5, z: float = 3.0, within: str | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Per row and column, IQR flag (strict fences, global or within class) and
    z-score flag (population std, NULL -> False, zero spread -> False).  Long form, with the columns ``also``."""
    keep = ["row_id", *([within] if within else []), *also]
    st = stack_columns(df, cols, keep)
    fences, n_f = materialise_small(quartile_fences(df, cols, k, within))
    mom, n_m = materialise_small(st.groupBy("column").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd")))
    j = join_fitted(st, fences, ["column", *([within] if within else [])], n_f, "left")
    j = join_fitted(j, mom, ["column"], n_m)
    iqr = F.coalesce((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")), F.lit(False))
    zf = F.coalesce(F.abs(F.try_divide(F.col("value") - F.col("mu"), F.col("sd"))) > z, F.lit(False))
    return j.select(*keep, "column", "value", iqr.alias("iqr_outlier"), zf.alias("z_outlier"))


def outlier_summary(df: DataFrame, cols: Sequence[str], y: str, classes: Sequence[str], k: float = 1.5, z: float = 3.0) -> DataFrame:
    """Per column the IQR, z and overlap counts, and the class composition (%)
    of outlier vs non-outlier rows, zero-filled over both groups and the class list."""
    fl = outlier_flags(df.select("row_id", y, *cols), cols, k, z, None, [y])
    counts = fl.groupBy("column").agg(
        F.sum(F.col("iqr_outlier").cast("long")).alias("iqr_outliers"),
        F.sum(F.col("z_outlier").cast("long")).alias("z_outliers"),
        F.sum((F.col("iqr_outlier") & F.col("z_outlier")).cast("long")).alias("both"))
    grp = F.when(F.col("iqr_outlier"), F.lit("outlier")).otherwise(F.lit("non_outlier"))
    comp = fl.groupBy("column", grp.alias("group")).agg(F.count("*").alias("__n"), *[
        F.sum((F.col(y).cast("string") == F.lit(c)).cast("long")).alias(f"c_{i}") for i, c in enumerate(classes)])
    comp = comp.select("column", "group", F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), (F.col(f"c_{i}") * 100.0 / F.col("__n")).alias("pct")) for i, c in enumerate(classes)])).alias("s")
    ).select("column", "group", "s.class", "s.pct")
    names = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    grid = counts.withColumn("group", names(["outlier", "non_outlier"])).withColumn("class", names(classes))  # a few rows a column
    return grid.join(comp, ["column", "group", "class"], "left").withColumn("pct", F.coalesce("pct", F.lit(0.0)))


def within_class_outliers(df: DataFrame, cols: Sequence[str], y: str, k: float = 1.5) -> DataFrame:
    """IQR outliers computed inside each class: count and share per column."""
    d = df.where(F.col(y).isNotNull())
    fl = outlier_flags(d.select("row_id", y, *cols), cols, k, 3.0, within=y).where(F.col("value").isNotNull())
    return fl.groupBy("column").agg(F.sum(F.col("iqr_outlier").cast("long")).alias("n_outliers"),
                                    F.avg(F.col("iqr_outlier").cast("double")).alias("share"))


# --------------------------------------------------------------------------- G32
def seeded_sample(df: DataFrame, n: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Repeatable fixed-size sample, min(n, rows): top-n by a seeded key (TakeOrderedAndProject)."""
    return df.orderBy(fold_order_key(row_id, seed), row_id).limit(n)
