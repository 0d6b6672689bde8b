"""Registered queries: profiling and association statistics (G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabspark.operators import profile as P
from tabspark.plans.common import rounded, sql_round
from tabspark.plans.fixtures import (
    BINARY_SQL,
    PART_LIKE_SQL,
    SKEWED_SQL,
    TRAIN_LIKE_CATS,
    TRAIN_LIKE_NUMS,
    TRAIN_LIKE_SQL,
    binary,
    part_like,
    skewed,
    train_like,
)
from tabspark.session import read_table

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


T = f"t AS ({TRAIN_LIKE_SQL}), tr AS (SELECT * FROM t WHERE split = 'train'), te AS (SELECT * FROM t WHERE split = 'test')"
EV = f"ev AS ({SKEWED_SQL})"
EV_COLS = ["value", "user_id"]
EV_CLASSES = ["click", "error", "purchase", "signup", "view"]
R = sql_round


def _train(spark, sf_dir):
    df = train_like(spark, sf_dir)
    return df.where(F.col("split") == "train").drop("split")


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# --------------------------------------------------------------------------- G1 / G30
@register("prof_numeric_stats", f"""
WITH {T}
{_union([f"SELECT '{c}' AS \"column\", {R(f'AVG({c})')} AS mean, {R(f'STDDEV_SAMP({c})')} AS std, {R(f'MIN({c})')} AS min, {R(f'MAX({c})')} AS max, COUNT(*) - COUNT({c}) AS n_null FROM tr" for c in TRAIN_LIKE_NUMS])}""")
def prof_numeric_stats(spark, sf_dir):
    """G1: mean / std / min / max / n_null of every numeric column in one aggregate."""
    return rounded(P.numeric_stats(_train(spark, sf_dir), TRAIN_LIKE_NUMS))


@register("prof_drift", f"""
WITH {T}
{_union([f'''SELECT '{c}' AS "column",
  {R(f'(SELECT AVG({c}) FROM tr)')} AS mean_a, {R(f'(SELECT STDDEV_SAMP({c}) FROM tr)')} AS std_a,
  {R(f'(SELECT MIN({c}) FROM tr)')} AS min_a, {R(f'(SELECT MAX({c}) FROM tr)')} AS max_a, (SELECT COUNT(*) - COUNT({c}) FROM tr) AS n_null_a,
  {R(f'(SELECT AVG({c}) FROM te)')} AS mean_b, {R(f'(SELECT STDDEV_SAMP({c}) FROM te)')} AS std_b,
  {R(f'(SELECT MIN({c}) FROM te)')} AS min_b, {R(f'(SELECT MAX({c}) FROM te)')} AS max_b, (SELECT COUNT(*) - COUNT({c}) FROM te) AS n_null_b,
  {R(f'(SELECT AVG({c}) FROM te) - (SELECT AVG({c}) FROM tr)')} AS mean_delta,
  {R(f'(SELECT STDDEV_SAMP({c}) FROM te) / (SELECT STDDEV_SAMP({c}) FROM tr)')} AS std_ratio''' for c in TRAIN_LIKE_NUMS])}""")
def prof_drift(spark, sf_dir):
    """Numeric statistics of the train and test splits side by side (drift check)."""
    df = train_like(spark, sf_dir)
    return rounded(P.drift_stats(df.where(F.col("split") == "train"), df.where(F.col("split") == "test"), TRAIN_LIKE_NUMS))


# --------------------------------------------------------------------------- G2 / G3
@register("prof_categorical_stats", f"""
WITH {T}
{_union([f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_unique, COUNT(*) - COUNT({c}) AS n_null FROM tr" for c in TRAIN_LIKE_CATS + ["y"]])}""")
def prof_categorical_stats(spark, sf_dir):
    """Distinct count (NULL excluded) and NULL count of the categorical columns."""
    return P.categorical_stats(_train(spark, sf_dir), TRAIN_LIKE_CATS + ["y"])


INT_COLS = ["l_linenumber", "l_suppkey", "l_partkey"]


@register("prof_integer_stats", _union([
    f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_unique, CAST(MIN({c}) AS BIGINT) AS min, CAST(MAX({c}) AS BIGINT) AS max, COUNT(*) - COUNT({c}) AS n_null FROM lineitem"
    for c in INT_COLS]))
def prof_integer_stats(spark, sf_dir):
    """Distinct count, min, max, NULL count of integer columns of lineitem."""
    return P.integer_stats(read_table(spark, sf_dir, "lineitem"), INT_COLS)


# --------------------------------------------------------------------------- G4 / G5 / G6 / G31
@register("prof_class_balance", f"""
WITH {T}, c AS (SELECT y AS class, COUNT(*) AS count FROM tr WHERE y IS NOT NULL GROUP BY y)
SELECT class, count, {R('count * 100.0 / SUM(count) OVER ()')} AS proportion_pct,
       {R('count * 1.0 / MIN(count) OVER ()')} AS ratio_to_smallest FROM c""")
def prof_class_balance(spark, sf_dir):
    """Class counts, proportion % and ratio to the smallest class."""
    return rounded(P.class_balance(_train(spark, sf_dir), "y"))


@register("prof_missing", f"""
WITH {T}
SELECT * FROM ({_union([f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing_count, {R(f'(COUNT(*) - COUNT({c})) * 100.0 / COUNT(*)')} AS missing_pct FROM t" for c in ["row_id", "split", "y", *TRAIN_LIKE_CATS, *TRAIN_LIKE_NUMS]])})
WHERE missing_count > 0""")
def prof_missing(spark, sf_dir):
    """Missing count and % per column (non-zero only) over all of train_like."""
    return rounded(P.missing_summary(train_like(spark, sf_dir)))


@register("prof_numeric_as_categorical", f"""
WITH p AS ({PART_LIKE_SQL})
{_union([f"SELECT '{c}' AS feature, COUNT(DISTINCT {c}) AS n_unique, COALESCE(BOOL_AND({c} % 1 = 0), TRUE) AS is_integer, {R(f'MIN({c})')} AS min, {R(f'MAX({c})')} AS max FROM p" for c in ["p_size", "p_retailprice"]])}""")
def prof_numeric_as_categorical(spark, sf_dir):
    """Is a numeric column really categorical? distinct count, all-integer, range."""
    return rounded(P.numeric_as_categorical(part_like(spark, sf_dir), ["p_size", "p_retailprice"]))


@register("prof_overview", f"""
WITH {T}
SELECT frame, rows, columns, n_float, n_int, n_string, classes, CAST(SUM(rows) OVER () AS BIGINT) AS combined_rows FROM (
  SELECT 'train' AS frame, COUNT(*) AS rows, 11 AS columns, 7 AS n_float, 1 AS n_int, 2 AS n_string,
         array_to_string(list_sort(list_distinct(list(y))), ',') AS classes FROM tr
  UNION ALL
  SELECT 'test', COUNT(*), 11, 7, 1, 2, array_to_string(list_sort(list_distinct(list(y))), ',') FROM te)""")
def prof_overview(spark, sf_dir):
    """Rows / columns / column kinds per frame, combined rows, target label set."""
    df = train_like(spark, sf_dir)
    frames = {"train": df.where(F.col("split") == "train").drop("split"), "test": df.where(F.col("split") == "test").drop("split")}
    out = P.dataset_overview(frames, "y")
    return out.withColumn("classes", F.array_join("classes", ",")).withColumn("columns", F.col("columns").cast("int"))


# --------------------------------------------------------------------------- G7 / G8
@register("prof_univariate", f"""
WITH {EV}
{_union([f'''SELECT '{c}' AS "column", {R(f'AVG({c})')} AS mean, {R(f'quantile_cont({c}, 0.5)')} AS median,
  {R(f'STDDEV_SAMP({c})')} AS std, {R(f'skewness({c})')} AS skew, {R(f'kurtosis({c})')} AS kurtosis,
  {R(f'MIN({c})')} AS min, {R(f'MAX({c})')} AS max, {R(f'SUM(CASE WHEN {c} = 0 THEN 1 ELSE 0 END) * 100.0 / COUNT({c})')} AS pct_zeros
  FROM ev''' for c in EV_COLS])}""")
def prof_univariate(spark, sf_dir):
    """Mean, median, std, bias-corrected skew / kurtosis, range, % zeros of events columns."""
    return rounded(P.univariate_summary(skewed(spark, sf_dir), EV_COLS))


# --------------------------------------------------------------------------- G9 / G10 / G11
def _hist_sql(group: str | None) -> str:
    g = f", {group}" if group else ""
    gsel = f"{group}, " if group else ""
    parts = []
    for c in EV_COLS:
        parts.append(f"""
SELECT '{c}' AS "column"{g}, {c} AS value FROM ev WHERE {c} IS NOT NULL{f' AND {group} IS NOT NULL' if group else ''}""")
    return f"""
WITH {EV}, st AS ({_union(parts)}),
rng AS (SELECT "column"{g}, MIN(value) AS lo, MAX(value) AS hi, COUNT(*) AS n FROM st GROUP BY ALL),
b AS (SELECT st."column"{', st.' + group if group else ''},
             CASE WHEN hi = lo THEN 0 ELSE LEAST(CAST(FLOOR((value - lo) * 40.0 / (hi - lo)) AS INTEGER), 39) END AS bin
      FROM st JOIN rng USING ("column"{g})),
c AS (SELECT "column"{g}, bin, COUNT(*) AS count FROM b GROUP BY ALL),
grid AS (SELECT "column"{g}, lo, hi, n, CAST(UNNEST(range(0, 40)) AS INTEGER) AS bin FROM rng)
SELECT grid."column"{', grid.' + group if group else ''}, grid.bin,
       {R('lo + bin * ((hi - lo) / 40.0)')} AS bin_lo, {R('lo + (bin + 1) * ((hi - lo) / 40.0)')} AS bin_hi,
       COALESCE(c.count, 0) AS count, {R('COALESCE(c.count, 0) / (n * ((hi - lo) / 40.0))')} AS density
FROM grid LEFT JOIN c USING ("column"{g}, bin)"""


@register("prof_histogram", _hist_sql(None))
def prof_histogram(spark, sf_dir):
    """40-bin density histogram of events columns over the whole table."""
    return rounded(P.histogram(skewed(spark, sf_dir), EV_COLS, bins=40))


@register("prof_histogram_by_class", _hist_sql("event_type"))
def prof_histogram_by_class(spark, sf_dir):
    """40-bin density histogram per event type, each class on its own range."""
    return rounded(P.histogram(skewed(spark, sf_dir), EV_COLS, bins=40, group_col="event_type"))


@register("prof_kde", f"""
WITH {EV}, st AS (SELECT 'value' AS "column", event_type, value FROM ev WHERE value IS NOT NULL AND event_type IS NOT NULL),
m AS (SELECT "column", event_type, MIN(value) AS lo, MAX(value) AS hi, COUNT(*) AS n, STDDEV_SAMP(value) AS sd FROM st GROUP BY ALL HAVING STDDEV_SAMP(value) > 0),
m2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS h, (hi - lo) / 299.0 AS step FROM m),
grid AS (SELECT "column", event_type, h, n, g, lo + g * step AS x FROM m2, (SELECT CAST(UNNEST(range(0, 300)) AS INTEGER) AS g))
SELECT grid."column", grid.event_type, grid.g AS point, {R('grid.x')} AS x,
       {R('SUM(exp(-pow(grid.x - st.value, 2) / (2 * grid.h * grid.h))) / (grid.n * grid.h * sqrt(2 * pi()))')} AS density
FROM grid JOIN st ON st."column" = grid."column" AND st.event_type = grid.event_type
GROUP BY grid."column", grid.event_type, grid.g, grid.x, grid.n, grid.h""")
def prof_kde(spark, sf_dir):
    """Exact Gaussian KDE (Scott bandwidth) of event value per event type on a 300-point grid."""
    return rounded(P.kde(skewed(spark, sf_dir), ["value"], 300, group_col="event_type"))


# --------------------------------------------------------------------------- G12 / G13
PART_CATS = ["p_brand", "p_type"]


@register("prof_top_values", f"""
WITH p AS ({PART_LIKE_SQL}),
c AS ({_union([f"SELECT '{c}' AS \"column\", {c} AS value, COUNT(*) AS count FROM p WHERE {c} IS NOT NULL GROUP BY {c}" for c in PART_CATS])})
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank FROM c) WHERE rank <= 15""")
def prof_top_values(spark, sf_dir):
    """Top-15 value counts of part brand and type."""
    return P.top_values(part_like(spark, sf_dir), PART_CATS, 15)


@register("prof_cardinality", f"""
WITH p AS ({PART_LIKE_SQL}),
c AS ({_union([f"SELECT '{c}' AS \"column\", {c} AS value, COUNT(*) AS count FROM p WHERE {c} IS NOT NULL GROUP BY {c}" for c in PART_CATS])})
SELECT "column", COUNT(*) AS n_unique, arg_min(value, (-count, value)) AS top_value, {R('MAX(count) * 100.0 / SUM(count)')} AS top_pct
FROM c GROUP BY "column" """)
def prof_cardinality(spark, sf_dir):
    """Cardinality, most frequent value and its share per categorical column."""
    return rounded(P.cardinality_overview(part_like(spark, sf_dir), PART_CATS))


# --------------------------------------------------------------------------- G14 / G15
def _pearson_sql():
    parts = []
    cols = TRAIN_LIKE_NUMS
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, 1.0 AS r")
            else:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'corr({a}, {b})')} AS r FROM tr")
    return f"WITH {T} {_union(parts)}"


@register("prof_pearson", _pearson_sql())
def prof_pearson(spark, sf_dir):
    """Pearson matrix of the numeric columns (pairwise-complete rows)."""
    return rounded(P.pearson_matrix(_train(spark, sf_dir), TRAIN_LIKE_NUMS))


@register("prof_anova", f"""
WITH {T},
st AS ({_union([f"SELECT '{c}' AS col, y, {c} AS v FROM tr WHERE y IS NOT NULL AND {c} IS NOT NULL" for c in TRAIN_LIKE_NUMS])}),
g AS (SELECT col, y, COUNT(*) AS n, AVG(v) AS m, VAR_SAMP(v) AS var FROM st GROUP BY col, y),
gm AS (SELECT col, SUM(n) AS ntot, COUNT(*) AS k, SUM(n * m) / SUM(n) AS gm, MIN(n) AS min_n FROM g GROUP BY col),
ss AS (SELECT g.col, SUM(g.n * pow(m - gm, 2)) AS ssb, SUM(COALESCE(var, 0) * (g.n - 1)) AS ssw, ANY_VALUE(ntot) AS ntot, ANY_VALUE(k) AS k
       FROM g JOIN gm USING (col) WHERE min_n >= 2 GROUP BY g.col)
SELECT col AS feature, {R('(ssb / (k - 1)) / (ssw / (ntot - k))')} AS f_stat, {R('ssb / (ssb + ssw)')} AS eta_sq,
       {R('CASE WHEN k = 3 THEN pow(1 + 2 * ((ssb / (k - 1)) / (ssw / (ntot - k))) / (ntot - k), -(ntot - k) / 2.0) END')} AS p_value,
       CAST(k - 1 AS BIGINT) AS df_between, CAST(ntot - k AS BIGINT) AS df_within FROM ss""")
def prof_anova(spark, sf_dir):
    """One-way ANOVA F, eta^2 and p-value of every numeric column against the class (of the F distribution with 2 degrees of
    freedom above, that of three classes, the survival function has a closed form)."""
    return rounded(P.anova_table(_train(spark, sf_dir), TRAIN_LIKE_NUMS, "y"))


# --------------------------------------------------------------------------- G16 / G17 / G20
BIN_CATS = ["lang", "source", "quality", "toxic"]
BIN_PAIRS = [(a, b) for i, a in enumerate(BIN_CATS) for b in BIN_CATS[i + 1:]]


def _cramer_sql():
    parts = []
    for a, b in BIN_PAIRS:
        parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({a} AS VARCHAR) AS va, CAST({b} AS VARCHAR) AS vb
                        FROM bn WHERE {a} IS NOT NULL AND {b} IS NOT NULL""")
    return f"""
WITH bn AS ({BINARY_SQL}), st AS ({_union(parts)}),
c AS (SELECT col_a, col_b, va, vb, COUNT(*) AS n FROM st GROUP BY ALL),
ra AS (SELECT col_a, col_b, va, SUM(n) AS na FROM c GROUP BY ALL),
rb AS (SELECT col_a, col_b, vb, SUM(n) AS nb FROM c GROUP BY ALL),
tot AS (SELECT col_a, col_b, SUM(n) AS ntot, COUNT(DISTINCT va) AS r, COUNT(DISTINCT vb) AS k FROM c GROUP BY ALL),
chi AS (SELECT c.col_a, c.col_b, SUM(CAST(c.n AS DOUBLE) * c.n * tot.ntot / (na * nb)) - ANY_VALUE(tot.ntot) AS chi2
        FROM c JOIN ra USING (col_a, col_b, va) JOIN rb USING (col_a, col_b, vb) JOIN tot USING (col_a, col_b) GROUP BY ALL)
SELECT col_a, col_b, {R('CASE WHEN r < 2 OR k < 2 THEN 0.0 ELSE sqrt(GREATEST(chi2 / ntot, 0.0) / (LEAST(r, k) - 1)) END')} AS cramers_v
FROM chi JOIN tot USING (col_a, col_b)"""


@register("prof_cramers_v", _cramer_sql())
def prof_cramers_v(spark, sf_dir):
    """Cramer's V for every pair of document language, source, quality and toxicity."""
    return rounded(P.cramers_v(binary(spark, sf_dir), BIN_PAIRS))


RANKED_CATS = ["lang", "source", "toxic"]


def _cramer_ranking_sql():
    v = _cramer_sql()
    pairs = " OR ".join(f"(col_a = '{a}' AND col_b = '{b}')" for a, b in BIN_PAIRS if "quality" in (a, b))
    return f"""SELECT feature, cramers_v, CAST(row_number() OVER (ORDER BY cramers_v DESC, feature) AS INTEGER) AS rank
FROM (SELECT CASE WHEN col_a = 'quality' THEN col_b ELSE col_a END AS feature, cramers_v FROM ({v}) WHERE {pairs})"""


@register("prof_cramers_ranking", _cramer_ranking_sql())
def prof_cramers_ranking(spark, sf_dir):
    """Document columns ranked by Cramer's V with the quality label."""
    return rounded(P.cramers_ranking(binary(spark, sf_dir), RANKED_CATS, "quality"))


KNN_NUMS = ["p_size", "cents"]


@register("prof_knn_mutual_info", f"""
WITH pt AS (SELECT p_partkey AS row_id, substr(p_brand, 1, 7) AS y, CAST(p_size AS DOUBLE) AS p_size, ROUND(p_retailprice * 100) AS cents FROM part),
s AS ({_union([f"SELECT '{c}' AS feature, row_id, y, {c} AS v FROM pt WHERE y IS NOT NULL AND {c} IS NOT NULL" for c in KNN_NUMS])}),
z AS (SELECT feature, y, COUNT(*) AS n_class FROM s GROUP BY feature, y HAVING COUNT(*) > 1),
r AS (SELECT s.*, n_class, COUNT(*) OVER (PARTITION BY feature) AS n_all FROM s JOIN z USING (feature, y)),
d AS (SELECT a.feature, a.row_id, a.v, ANY_VALUE(a.n_class) AS n_class, ANY_VALUE(a.n_all) AS n_all, LEAST(3, ANY_VALUE(a.n_class) - 1) AS k, list_sort(list(abs(a.v - b.v))) AS ds
      FROM r a JOIN r b ON a.feature = b.feature AND a.y = b.y AND a.row_id <> b.row_id GROUP BY a.feature, a.row_id, a.v),
m AS (SELECT d.feature, d.row_id, ANY_VALUE(d.n_class) AS n_class, ANY_VALUE(d.n_all) AS n_all, ANY_VALUE(d.k) AS k, GREATEST(1, COUNT(*) FILTER (abs(b.v - d.v) < d.ds[d.k])) AS m
      FROM d JOIN r b ON b.feature = d.feature GROUP BY d.feature, d.row_id),
h AS (SELECT n, SUM(CASE WHEN n > 1 THEN 1.0 / (n - 1) ELSE 0.0 END) OVER (ORDER BY n) - 0.5772156649015329 AS psi FROM (SELECT unnest(range(1, (SELECT MAX(n_all) + 1 FROM r))) AS n))
SELECT feature, ANY_VALUE(m.n_all) AS n_rows, {R("GREATEST(0.0, ANY_VALUE(pn.psi) + AVG(pk.psi) - AVG(pc.psi) - AVG(pm.psi))")} AS mi
FROM m JOIN h pn ON pn.n = m.n_all JOIN h pk ON pk.n = m.k JOIN h pc ON pc.n = m.n_class JOIN h pm ON pm.n = m.m GROUP BY feature""")
def prof_knn_mutual_info(spark, sf_dir):
    """Nearest-neighbour mutual information of part size and price with the brand's first figure."""
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.substring("p_brand", 1, 7).alias("y"), F.col("p_size").cast("double").alias("p_size"), F.round(F.col("p_retailprice") * 100).alias("cents"))
    return rounded(P.knn_mutual_information(part, "y", KNN_NUMS, 3))


MI_NUMS = ["o_totalprice", "c_acctbal"]


def _mi_sql():
    used = ["y", *TRAIN_LIKE_CATS, *MI_NUMS]
    parts = [f"SELECT '{c}' AS a, CAST({c} AS VARCHAR) AS va, y AS vb FROM d" for c in TRAIN_LIKE_CATS]
    parts += [f"""SELECT '{c}' AS a, CAST(CASE WHEN (SELECT MAX({c}) - MIN({c}) FROM d) = 0 THEN 0 ELSE
                   LEAST(CAST(FLOOR(({c} - (SELECT MIN({c}) FROM d)) * 10.0 / ((SELECT MAX({c}) FROM d) - (SELECT MIN({c}) FROM d))) AS INTEGER), 9) END AS VARCHAR) AS va,
                   y AS vb FROM d""" for c in MI_NUMS]
    return f"""
WITH {T}, d AS (SELECT {", ".join(used)} FROM tr WHERE {" AND ".join(f"{c} IS NOT NULL" for c in used)}),
st AS ({_union(parts)}),
c AS (SELECT a, va, vb, COUNT(*) AS n FROM st GROUP BY ALL),
ra AS (SELECT a, va, SUM(n) AS na FROM c GROUP BY ALL), rb AS (SELECT a, vb, SUM(n) AS nb FROM c GROUP BY ALL),
tot AS (SELECT a, SUM(n) AS ntot FROM c GROUP BY a)
SELECT a AS feature, CASE WHEN a IN ({", ".join(f"'{c}'" for c in TRAIN_LIKE_CATS)}) THEN 'discrete' ELSE 'binned' END AS kind,
       {R('SUM((CAST(c.n AS DOUBLE) / ntot) * ln(CAST(c.n AS DOUBLE) * ntot / (na * nb)))')} AS mi
FROM c JOIN ra USING (a, va) JOIN rb USING (a, vb) JOIN tot USING (a) GROUP BY a"""


@register("prof_mutual_info", _mi_sql())
def prof_mutual_info(spark, sf_dir):
    """Plug-in mutual information with the class: exact for categoricals, 10 equal-width
    bins for numerics."""
    return rounded(P.mutual_information(_train(spark, sf_dir), "y", TRAIN_LIKE_CATS, MI_NUMS, bins=10))


# --------------------------------------------------------------------------- G18 / G21-G24
@register("prof_class_rate", f"""
WITH bn AS ({BINARY_SQL}),
g AS (SELECT CAST(source AS VARCHAR) AS category, AVG(CASE WHEN CAST(quality AS VARCHAR) = '1' THEN 1.0 ELSE 0.0 END) AS rate, COUNT(*) AS count
      FROM bn WHERE source IS NOT NULL GROUP BY 1),
top AS (SELECT * FROM g ORDER BY count DESC, category LIMIT 10)
SELECT category, {R('rate')} AS rate, count,
       {R('(SELECT AVG(CASE WHEN CAST(quality AS VARCHAR) = ' + "'1'" + ' THEN 1.0 ELSE 0.0 END) FROM bn)')} AS overall_rate FROM top""")
def prof_class_rate(spark, sf_dir):
    """P(quality = 1 | source) for the 10 most frequent sources, with the overall rate."""
    return rounded(P.class_rate_by_category(binary(spark, sf_dir), "source", "quality", 1, top_n=10))


CLASSES = ["F", "O", "P"]
PRICE_EDGES = [0, 100000, 200000, 300000, 400000, 500000]
PRICE_LABELS = ["<100k", "100-200k", "200-300k", "300-400k", "400-500k"]
BAL_EDGES = [-1000, 0, 2500, 5000, 7500, 10000]
BAL_LABELS = ["neg", "0-2.5k", "2.5-5k", "5-7.5k", "7.5-10k"]


def _bin_sql(c, edges, labels):
    whens = " ".join(f"WHEN {c} >= {edges[i]} AND {c} < {edges[i + 1]} THEN '{labels[i]}'" for i in range(len(labels)))
    return f"CASE {whens} END"


def _grid_sql(e1: str, e2: str) -> str:
    return f"""
WITH {T}, b AS (SELECT CAST({e1} AS VARCHAR) AS f1, CAST({e2} AS VARCHAR) AS f2, y FROM tr),
g AS (SELECT f1, f2, COUNT(*) AS count, {", ".join(f"AVG(CASE WHEN y = '{c}' THEN 1.0 ELSE 0.0 END) AS r{i}" for i, c in enumerate(CLASSES))}
      FROM b WHERE f1 IS NOT NULL AND f2 IS NOT NULL GROUP BY f1, f2)
{_union([f"SELECT '{c}' AS class, f1, f2, {R(f'r{i}')} AS rate, count FROM g" for i, c in enumerate(CLASSES)])}"""


@register("prof_cat_cat_rates", _grid_sql("o_orderpriority", "c_mktsegment"))
def prof_cat_cat_rates(spark, sf_dir):
    """Class rate per (order priority, market segment) cell for every class."""
    return rounded(P.class_rate_grid(_train(spark, sf_dir), "o_orderpriority", "c_mktsegment", "y", CLASSES))


@register("prof_num_cat_rates", _grid_sql(_bin_sql("o_totalprice", PRICE_EDGES, PRICE_LABELS), "c_mktsegment"))
def prof_num_cat_rates(spark, sf_dir):
    """Class rate per (left-closed price bin, market segment) cell."""
    b = P.binned("o_totalprice", PRICE_EDGES, PRICE_LABELS)
    return rounded(P.class_rate_grid(_train(spark, sf_dir), b, "c_mktsegment", "y", CLASSES))


@register("prof_num_num_rates", _grid_sql(_bin_sql("o_totalprice", PRICE_EDGES, PRICE_LABELS), _bin_sql("c_acctbal", BAL_EDGES, BAL_LABELS)))
def prof_num_num_rates(spark, sf_dir):
    """Class rate per (price bin, account-balance bin) cell; out-of-range -> dropped."""
    return rounded(P.class_rate_grid(_train(spark, sf_dir), P.binned("o_totalprice", PRICE_EDGES, PRICE_LABELS),
                                     P.binned("c_acctbal", BAL_EDGES, BAL_LABELS), "y", CLASSES))


# --------------------------------------------------------------------------- G19 / G25-G29 / G32
@register("prof_box_stats", f"""
WITH {EV}, st AS ({_union([f"SELECT '{c}' AS \"column\", event_type AS class, {c} AS v FROM ev WHERE event_type IS NOT NULL AND {c} IS NOT NULL" for c in EV_COLS])})
SELECT "column", class, COUNT(*) AS n, {R('MIN(v)')} AS min, {R('quantile_cont(v, 0.25)')} AS q1, {R('quantile_cont(v, 0.5)')} AS median,
       {R('quantile_cont(v, 0.75)')} AS q3, {R('MAX(v)')} AS max FROM st GROUP BY ALL""")
def prof_box_stats(spark, sf_dir):
    """Per event type n / min / quartiles / max of the events columns."""
    return rounded(P.box_stats(skewed(spark, sf_dir), EV_COLS, "event_type"))


@register("prof_class_sample", f"""
WITH {EV}
SELECT row_id, event_type, {R('value')} AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type
     ORDER BY (((row_id % 2147483647 + 2147483647) % 2147483647) * 48271 + 42) % 2147483647, row_id) AS r FROM ev) WHERE r <= 500""")
def prof_class_sample(spark, sf_dir):
    """G19 sample: at most 500 seeded rows per event type (the jitter overlay sample)."""
    return rounded(P.class_sample(skewed(spark, sf_dir), "event_type", ["value"], 500, 42))


def _outlier_sql():
    st = _union([f"SELECT row_id, event_type, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM ev" for c in EV_COLS])
    return f"""
WITH {EV}, st AS ({st}),
q AS (SELECT col, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, AVG(v) AS mu, STDDEV_POP(v) AS sd FROM st GROUP BY col),
f AS (SELECT st.*, COALESCE(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1), FALSE) AS iqr,
             COALESCE(CASE WHEN sd = 0 THEN NULL ELSE abs((v - mu) / sd) > 3.0 END, FALSE) AS z FROM st JOIN q USING (col)),
cnt AS (SELECT col, CAST(SUM(CAST(iqr AS BIGINT)) AS BIGINT) AS iqr_outliers, CAST(SUM(CAST(z AS BIGINT)) AS BIGINT) AS z_outliers, CAST(SUM(CAST(iqr AND z AS BIGINT)) AS BIGINT) AS "both" FROM f GROUP BY col),
grp AS (SELECT col, CASE WHEN iqr THEN 'outlier' ELSE 'non_outlier' END AS "group", event_type FROM f),
comp AS (SELECT g.col, g."group", c.class, {R("SUM(CASE WHEN g.event_type = c.class THEN 1 ELSE 0 END) * 100.0 / COUNT(*)")} AS pct
         FROM grp g, (VALUES {", ".join(f"('{c}')" for c in EV_CLASSES)}) c(class) GROUP BY ALL)
SELECT cnt.col AS "column", iqr_outliers, z_outliers, "both", gg."group", cc.class, COALESCE(pct, 0.0) AS pct
FROM cnt CROSS JOIN (VALUES ('outlier'), ('non_outlier')) gg("group") CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in EV_CLASSES)}) cc(class)
     LEFT JOIN comp ON comp.col = cnt.col AND comp."group" = gg."group" AND comp.class = cc.class"""


@register("prof_outlier_summary", _outlier_sql())
def prof_outlier_summary(spark, sf_dir):
    """IQR (1.5) and z (> 3, population std) outlier counts, overlap, and the class
    composition of outlier vs non-outlier rows, zero-filled."""
    return rounded(P.outlier_summary(skewed(spark, sf_dir), EV_COLS, "event_type", EV_CLASSES))


@register("prof_within_class_outliers", f"""
WITH {EV}, st AS ({_union([f"SELECT event_type, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM ev WHERE event_type IS NOT NULL AND {c} IS NOT NULL" for c in EV_COLS])}),
q AS (SELECT col, event_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM st GROUP BY ALL),
f AS (SELECT st.col, (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS o FROM st JOIN q USING (col, event_type))
SELECT col AS "column", CAST(SUM(CAST(o AS BIGINT)) AS BIGINT) AS n_outliers, {R('AVG(CAST(o AS DOUBLE))')} AS share FROM f GROUP BY col""")
def prof_within_class_outliers(spark, sf_dir):
    """IQR outliers computed within each event type: count and share per column."""
    return rounded(P.within_class_outliers(skewed(spark, sf_dir), EV_COLS, "event_type"))


@register("prof_seeded_sample", f"""
WITH {T}
SELECT row_id, y, {R('o_totalprice')} AS o_totalprice FROM tr
ORDER BY (((row_id % 2147483647 + 2147483647) % 2147483647) * 48271 + 42) % 2147483647, row_id LIMIT 1000""")
def prof_seeded_sample(spark, sf_dir):
    """Repeatable 1,000-row sample of the train split (min with the table size)."""
    return rounded(P.seeded_sample(_train(spark, sf_dir), 1000, 42).select("row_id", "y", "o_totalprice"))
