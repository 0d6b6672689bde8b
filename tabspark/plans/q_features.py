"""Registered queries: feature engineering and encoders (T*, C*, E*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.operators.cross import CatCatInteract, NumCatInteract, NumNumInteract
from tabspark.operators.cv import folds_sql, stratified_folds
from tabspark.operators.encode import (
    cast_target,
    FoldTargetEncoder,
    LabelEncoder,
    MEstimateEncoder,
    MissingEncoder,
    OrdinalEncoder,
    TargetDictionary,
    balanced_class_weights,
    embedding_sizes,
    joint_factorize,
)
from tabspark.operators.transform import (
    AngleToUnitVector,
    ClipIQR,
    FoldStandardizer,
    Log1p,
    Polynomial,
    Ratio,
    Subtract,
)
from tabspark.plans.common import rounded, sql_round
from tabspark.plans.fixtures import (
    BINARY_SQL,
    binary,
    PART_LIKE_SQL,
    TRAIN_LIKE_CATS,
    TRAIN_LIKE_NUMS,
    TRAIN_LIKE_SQL,
    part_like,
    train_like,
)

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _split(df: DataFrame):
    return df.where(F.col("split") == "train"), df.where(F.col("split") == "test")


# --------------------------------------------------------------------------- flagship
FLAGSHIP_SQL = f"""
WITH t AS ({TRAIN_LIKE_SQL}),
tr AS (SELECT * FROM t WHERE split = 'train'),
ydict AS (
  SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label ASC) - 1 AS INTEGER) AS code
  FROM (SELECT CAST(y AS VARCHAR) AS label, COUNT(*) AS n FROM tr WHERE y IS NOT NULL GROUP BY 1)),
mu AS (SELECT AVG(sum_qty) AS m_sum_qty FROM tr),
g AS (
  SELECT o_orderpriority AS key,
         CASE WHEN COUNT(o_totalprice) >= 10 THEN AVG(o_totalprice) END AS mean
  FROM tr WHERE o_orderpriority IS NOT NULL GROUP BY 1),
gl AS (SELECT AVG(o_totalprice) AS gmean FROM tr)
SELECT t.row_id, t.split, d.code AS y,
       ROUND(CAST(CAST(ln(1 + greatest(t.o_totalprice, 0.0)) AS FLOAT) AS DOUBLE), 6) AS o_totalprice_log1p,
       ROUND(CAST(CAST(ln(1 + greatest(t.c_acctbal, 0.0)) AS FLOAT) AS DOUBLE), 6) AS c_acctbal_log1p,
       ROUND(CAST(CAST(COALESCE(t.sum_qty, mu.m_sum_qty) AS FLOAT) AS DOUBLE), 6) AS sum_qty,
       CASE WHEN t.sum_qty IS NULL THEN '1' ELSE '0' END AS sum_qty_has_missing,
       ROUND(CAST(CAST(t.o_totalprice - t.c_acctbal AS FLOAT) AS DOUBLE), 6) AS o_totalprice_minus_c_acctbal,
       ROUND(CAST(CAST(COALESCE(g.mean, gl.gmean) AS FLOAT) AS DOUBLE), 6) AS o_totalprice_by_o_orderpriority_mean
FROM t
LEFT JOIN ydict d ON CAST(t.y AS VARCHAR) = d.label
LEFT JOIN g ON t.o_orderpriority = g.key
CROSS JOIN mu CROSS JOIN gl
"""


@register("flagship_feature_slice", FLAGSHIP_SQL)
def flagship_feature_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 target dictionary, E4 imputer+flag, T1 log1p, T3 difference, C7/C8 group mean with
    fallback: fitted on the train split, applied to every row of train_like."""
    df = train_like(spark, sf_dir)
    train, _ = _split(df)
    ydict = TargetDictionary("y").fit(train)
    miss = MissingEncoder([], ["sum_qty"]).fit_pair(train, df.where(F.col("split") == "test"))
    numcat = NumCatInteract([("o_totalprice", "o_orderpriority")], ["mean"], 10).fit(train)
    out = ydict.transform(df)
    out = Log1p(["o_totalprice", "c_acctbal"]).transform(out)
    out = miss.transform(out)
    out = Subtract([("o_totalprice", "c_acctbal")]).transform(out)
    out = numcat.transform(out)
    return rounded(out.select(
        "row_id", "split", "y", "o_totalprice_log1p", "c_acctbal_log1p", "sum_qty", "sum_qty_has_missing",
        "o_totalprice_minus_c_acctbal", "o_totalprice_by_o_orderpriority_mean",
    ))



# --------------------------------------------------------------------------- shared SQL pieces
T = f"t AS ({TRAIN_LIKE_SQL}), tr AS (SELECT * FROM t WHERE split = 'train')"
TRF = "trf AS (" + folds_sql("SELECT * FROM tr") + ")"


def _f(expr: str) -> str:
    """float32 output contract, then the presentation rounding."""
    return sql_round(f"CAST({expr} AS FLOAT)")


def _long(spark_df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    return spark_df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keep, cols, "feature", "value")


# --------------------------------------------------------------------------- T1
@register("fe_log1p", f"""
WITH {T}
SELECT row_id, {", ".join(f"{_f(f'CASE WHEN {c} IS NULL THEN NULL ELSE ln(1 + greatest({c}, 0.0)) END')} AS {c}_log1p" for c in TRAIN_LIKE_NUMS)}
FROM t""")
def fe_log1p(spark, sf_dir):
    """T1 over every numeric column of train_like (floor 0, NULL preserved)."""
    out = Log1p(TRAIN_LIKE_NUMS, clip_lower=0.0, drop_original=True).transform(train_like(spark, sf_dir))
    return rounded(out.select("row_id", *[f"{c}_log1p" for c in TRAIN_LIKE_NUMS]))


# --------------------------------------------------------------------------- T2 / T3
RATIO_PAIRS = [("o_totalprice", "c_acctbal"), ("sum_qty", "n_items"), ("c_acctbal", "delta")]


@register("fe_ratio_subtract", f"""
WITH {T}
SELECT row_id,
  {", ".join(f"{_f(f'{a} / ({b} + 1e-6)')} AS {a}_per_{b}" for a, b in RATIO_PAIRS)},
  {", ".join(f"{_f(f'{a} - {b}')} AS {a}_minus_{b}" for a, b in RATIO_PAIRS)}
FROM t""")
def fe_ratio_subtract(spark, sf_dir):
    """T2 ratios and T3 differences of ordered column pairs."""
    df = train_like(spark, sf_dir)
    out = Subtract(RATIO_PAIRS).transform(Ratio(RATIO_PAIRS, eps=1e-6).transform(df))
    cols = [f"{a}_per_{b}" for a, b in RATIO_PAIRS] + [f"{a}_minus_{b}" for a, b in RATIO_PAIRS]
    return rounded(out.select("row_id", *cols))


# --------------------------------------------------------------------------- T4
CLIP_COLS = ["o_totalprice", "c_acctbal", "sum_qty", "avg_disc"]
CLIP_K = 0.5


@register("fe_clip_iqr", f"""
WITH {T},
q AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in CLIP_COLS)} FROM tr),
b AS (SELECT {", ".join(f"q1_{c} - {CLIP_K} * (q3_{c} - q1_{c}) AS lo_{c}, q3_{c} + {CLIP_K} * (q3_{c} - q1_{c}) AS hi_{c}" for c in CLIP_COLS)} FROM q)
SELECT row_id, split,
  {", ".join(f"{sql_round(f'CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END')} AS {c}" for c in CLIP_COLS)}
FROM t CROSS JOIN b""")
def fe_clip_iqr(spark, sf_dir):
    """T4: train quantile fences (exact, linear interpolation) applied to train and test rows."""
    df = train_like(spark, sf_dir)
    train, _ = _split(df)
    model = ClipIQR(CLIP_COLS, CLIP_K, CLIP_K).fit(train)
    return rounded(model.transform(df).select("row_id", "split", *CLIP_COLS))


# --------------------------------------------------------------------------- T5 / T6
POLY_COLS, POLY_DEG = ["o_totalprice", "avg_disc", "delta"], [2, 3, 4]
_SFX = {2: "sq", 3: "cube"}


@register("fe_poly_angle", f"""
WITH {T}
SELECT row_id,
  {", ".join(f"{_f(f'pow({c}, {d}.0)')} AS {c}_{_SFX.get(d, f'pow{d}')}" for c in POLY_COLS for d in POLY_DEG)},
  {_f("cos(radians(delta)) * cos(radians(alpha))")} AS unit_x,
  {_f("cos(radians(delta)) * sin(radians(alpha))")} AS unit_y,
  {_f("sin(radians(delta))")} AS unit_z
FROM t""")
def fe_poly_angle(spark, sf_dir):
    """T5 powers (sq, cube, pow4) and T6 degrees -> unit vector with an explicit prefix."""
    df = train_like(spark, sf_dir)
    out = AngleToUnitVector("alpha", "delta", prefix="unit_").transform(Polynomial(POLY_COLS, POLY_DEG).transform(df))
    cols = [f"{c}_{_SFX.get(d, f'pow{d}')}" for c in POLY_COLS for d in POLY_DEG] + ["unit_x", "unit_y", "unit_z"]
    return rounded(out.select("row_id", *cols))


# --------------------------------------------------------------------------- M1 / T7
STD_COLS = ["o_totalprice", "c_acctbal", "sum_qty"]


@register("cv_stratified_folds", f"""
WITH {T}, {TRF}
SELECT row_id, y, fold FROM trf""")
def cv_stratified_folds(spark, sf_dir):
    """M1: seeded stratified 5-fold assignment of the train split (row_id, y, fold)."""
    train, _ = _split(train_like(spark, sf_dir))
    return stratified_folds(train, "y", k=5, seed=1337).select("row_id", "y", "fold")


@register("fe_fold_standardize", f"""
WITH {T}, {TRF},
st AS (
  SELECT f.fold, {", ".join(f"AVG(o.{c}) AS mu_{c}, STDDEV_SAMP(o.{c}) AS sd_{c}" for c in STD_COLS)}
  FROM (SELECT DISTINCT fold FROM trf) f JOIN trf o ON o.fold <> f.fold GROUP BY f.fold)
SELECT row_id, trf.fold, {", ".join(f"{_f(f'({c} - mu_{c}) / sd_{c}')} AS {c}" for c in STD_COLS)}
FROM trf JOIN st ON trf.fold = st.fold""")
def fe_fold_standardize(spark, sf_dir):
    """Each train row standardised with the mean / sample std of the other folds."""
    train, _ = _split(train_like(spark, sf_dir))
    folded = stratified_folds(train, "y", k=5, seed=1337)
    model = FoldStandardizer(STD_COLS, "fold").fit(folded)
    return rounded(model.transform_oof(folded).select("row_id", "fold", *STD_COLS))


# --------------------------------------------------------------------------- C1-C3
NUMNUM_TOP, NUMNUM_CORR = 5, 0.85


@register("cross_num_num", f"""
WITH {T},
v AS (SELECT col, var_samp(val) AS var, ord FROM (
        UNPIVOT (SELECT {", ".join(TRAIN_LIKE_NUMS)} FROM tr) ON {", ".join(TRAIN_LIKE_NUMS)} INTO NAME col VALUE val)
      JOIN (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(TRAIN_LIKE_NUMS))}) o(c2, ord) ON col = c2
      GROUP BY col, ord),
top AS (SELECT col, row_number() OVER (ORDER BY var DESC, ord) AS rn FROM v ORDER BY var DESC, ord LIMIT {NUMNUM_TOP}),
pairs AS (SELECT a.col AS a, b.col AS b FROM top a JOIN top b ON a.rn < b.rn),
rows AS (UNPIVOT (SELECT row_id, {", ".join(TRAIN_LIKE_NUMS)} FROM t) ON {", ".join(TRAIN_LIKE_NUMS)} INTO NAME col VALUE val),
trrows AS (UNPIVOT (SELECT row_id, {", ".join(TRAIN_LIKE_NUMS)} FROM tr) ON {", ".join(TRAIN_LIKE_NUMS)} INTO NAME col VALUE val),
r AS (SELECT p.a, p.b, corr(x.val, y.val) AS r FROM pairs p
      JOIN trrows x ON x.col = p.a JOIN trrows y ON y.col = p.b AND y.row_id = x.row_id GROUP BY p.a, p.b),
kept AS (SELECT a, b FROM r WHERE NOT (abs(r) > {NUMNUM_CORR}) OR r IS NULL OR isnan(r))
SELECT t.row_id, k.a || '_x_' || k.b AS feature,
       {_f("x.val * y.val")} AS value
FROM t CROSS JOIN kept k
LEFT JOIN rows x ON x.row_id = t.row_id AND x.col = k.a
LEFT JOIN rows y ON y.row_id = t.row_id AND y.col = k.b""")
def cross_num_num(spark, sf_dir):
    """Auto mode over the top-5 variance columns of train, pairs with |r| > 0.85 skipped;
    products emitted for every row in long form (row_id, feature, value)."""
    df = train_like(spark, sf_dir)
    train, _ = _split(df)
    model = NumNumInteract(auto_top_n=NUMNUM_TOP, corr_threshold=NUMNUM_CORR, exclude=["row_id"]).fit(train)
    names = [f"{a}_x_{b}" for a, b in model.pairs]
    return rounded(_long(model.transform(df), ["row_id"], names))


# --------------------------------------------------------------------------- C4-C6
@register("cross_cat_cat", f"""
WITH p AS ({PART_LIKE_SQL}),
card AS (SELECT COUNT(DISTINCT p_brand || '__' || p_type) AS n FROM p)
SELECT row_id, 'p_brand__p_type' AS feature, p_brand || '__' || p_type AS value,
       CASE WHEN n <= 100 THEN 'low' ELSE 'high' END AS card_group
FROM p CROSS JOIN card""")
def cross_cat_cat(spark, sf_dir):
    """C4-C6 on part: auto pairs of string columns, cap 200 on nunique(a) * nunique(b), observed
    cardinality split at 100 into low / high lists."""
    df = part_like(spark, sf_dir)
    model = CatCatInteract(auto_all=True, max_combined_cardinality=200, low_card_threshold=100).fit(df)
    out = model.transform(df)
    parts = []
    for name in model.low_card_cols + model.high_card_cols:
        grp = "low" if name in model.low_card_cols else "high"
        parts.append(out.select("row_id", F.lit(name).alias("feature"), F.col(name).alias("value"), F.lit(grp).alias("card_group")))
    res = parts[0]
    for p_ in parts[1:]:
        res = res.unionByName(p_)
    return res


# --------------------------------------------------------------------------- C7 / C8
NUMCAT_PAIRS = [("p_retailprice", "p_brand"), ("p_size", "p_type")]
NUMCAT_STATS = ["mean", "std", "median", "min", "max"]
NUMCAT_LEAF = 80
_SQLSTAT = {"mean": "AVG({v})", "std": "STDDEV_SAMP({v})", "median": "quantile_cont({v}, 0.5)", "min": "MIN({v})", "max": "MAX({v})"}


def _numcat_sql():
    ctes, sel, joins = [], [], []
    for i, (num, cat) in enumerate(NUMCAT_PAIRS):
        stats = ", ".join(f"CASE WHEN COUNT({num}) >= {NUMCAT_LEAF} THEN {_SQLSTAT[s].format(v=num)} END AS {s}" for s in NUMCAT_STATS)
        ctes.append(f"g{i} AS (SELECT {cat} AS key, {stats} FROM p WHERE {cat} IS NOT NULL GROUP BY {cat})")
        ctes.append(f"gl{i} AS (SELECT {', '.join(f'{_SQLSTAT[s].format(v=num)} AS {s}' for s in NUMCAT_STATS)} FROM p)")
        joins.append(f"LEFT JOIN g{i} ON p.{cat} = g{i}.key CROSS JOIN gl{i}")
        sel += [f"{_f(f'COALESCE(g{i}.{s}, gl{i}.{s})')} AS {num}_by_{cat}_{s}" for s in NUMCAT_STATS]
    return f"WITH p AS ({PART_LIKE_SQL}), {', '.join(ctes)} SELECT p.row_id, {', '.join(sel)} FROM p {' '.join(joins)}"


@register("cross_num_cat", _numcat_sql())
def cross_num_cat(spark, sf_dir):
    """C7/C8 on part: per-category mean/std/median/min/max with the global fallback for groups
    under 80 non-null values."""
    df = part_like(spark, sf_dir)
    model = NumCatInteract(NUMCAT_PAIRS, NUMCAT_STATS, NUMCAT_LEAF).fit(df)
    cols = [f"{n}_by_{c}_{s}" for n, c in NUMCAT_PAIRS for s in NUMCAT_STATS]
    return rounded(model.transform(df).select("row_id", *cols))


# --------------------------------------------------------------------------- E1 / E4 / E5 / E7 / E8 / E14
@register("enc_target_dictionary", f"""
WITH {T}
SELECT CAST(row_number() OVER (ORDER BY n DESC, label ASC) - 1 AS INTEGER) AS code, label, n
FROM (SELECT CAST(y AS VARCHAR) AS label, COUNT(*) AS n FROM tr WHERE y IS NOT NULL GROUP BY 1)""")
def enc_target_dictionary(spark, sf_dir):
    """Class dictionary of the train split by descending frequency."""
    train, _ = _split(train_like(spark, sf_dir))
    return TargetDictionary("y").fit(train).dictionary


_MISS_NUMS = TRAIN_LIKE_NUMS


@register("enc_missing", f"""
WITH {T},
m AS (SELECT {", ".join(f"AVG({c}) AS m_{c}, COUNT(*) - COUNT({c}) AS ntr_{c}" for c in _MISS_NUMS)} FROM tr)
SELECT row_id, split,
  {", ".join(f"COALESCE(CAST({c} AS VARCHAR), 'missing') AS {c}" for c in TRAIN_LIKE_CATS)},
  {", ".join(f"{_f(f'COALESCE({c}, m_{c})')} AS {c}" for c in _MISS_NUMS)},
  {", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END AS {c}_has_missing" for c in ["sum_qty", "avg_disc", "n_items"])}
FROM t CROSS JOIN m""")
def enc_missing(spark, sf_dir):
    """Categorical NULL -> 'missing'; numeric NULL -> train mean + flag (flags only where a
    frame has NULLs: the three lineitem aggregates, NULL for orders without lines)."""
    df = train_like(spark, sf_dir)
    train, test = _split(df)
    model = MissingEncoder(TRAIN_LIKE_CATS, _MISS_NUMS).fit_pair(train, test)
    out = model.transform(df)
    flags = [c for c in out.columns if c.endswith("_has_missing")]
    return rounded(out.select("row_id", "split", *TRAIN_LIKE_CATS, *_MISS_NUMS, *flags))


ORD_COLS = ["o_orderpriority", "c_mktsegment", "y"]


@register("enc_ordinal", f"""
WITH {T},
{", ".join(f"d_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS code FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM tr WHERE {c} IS NOT NULL))" for c in ORD_COLS)}
SELECT row_id, split, {", ".join(f"COALESCE(d_{c}.code, CAST(0 AS INTEGER)) AS {c}" for c in ORD_COLS)}
FROM t {" ".join(f"LEFT JOIN d_{c} ON CAST(t.{c} AS VARCHAR) = d_{c}.v" for c in ORD_COLS)}""")
def enc_ordinal(spark, sf_dir):
    """Sorted train categories coded from 1 (0 = unknown/NULL) as smallint, applied to all rows."""
    df = train_like(spark, sf_dir)
    train, _ = _split(df)
    model = OrdinalEncoder(ORD_COLS).fit(train)
    return model.transform(df).select("row_id", "split", *ORD_COLS)


FACT_COLS = ["c_mktsegment", "o_orderpriority"]


@register("enc_factorize", f"""
WITH {T},
u AS (SELECT 0 AS part, row_id, {", ".join(FACT_COLS)} FROM t WHERE split = 'train'
      UNION ALL SELECT 1 AS part, row_id, {", ".join(FACT_COLS)} FROM t WHERE split = 'test'),
{", ".join(f"d_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY first_key) - 1 AS INTEGER) AS code FROM (SELECT CAST({c} AS VARCHAR) AS v, MIN(part * 100000000000 + row_id) AS first_key FROM u WHERE {c} IS NOT NULL GROUP BY 1))" for c in FACT_COLS)}
SELECT row_id, split, {", ".join(f"COALESCE(d_{c}.code, CAST(-1 AS INTEGER)) AS {c}" for c in FACT_COLS)}
FROM t {" ".join(f"LEFT JOIN d_{c} ON CAST(t.{c} AS VARCHAR) = d_{c}.v" for c in FACT_COLS)}""")
def enc_factorize(spark, sf_dir):
    """Joint first-appearance codes over train then test (by row_id); NULL -> -1."""
    df = train_like(spark, sf_dir)
    train, test = _split(df)
    tr, te = joint_factorize(train, test, FACT_COLS)
    return tr.select("row_id", F.lit("train").alias("split"), *FACT_COLS).unionByName(
        te.select("row_id", F.lit("test").alias("split"), *FACT_COLS))


@register("enc_label", f"""
WITH p AS ({PART_LIKE_SQL}),
d AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_type AS v FROM p WHERE p_type IS NOT NULL))
SELECT row_id, d.code AS p_type FROM p LEFT JOIN d ON p.p_type = d.v""")
def enc_label(spark, sf_dir):
    """Label encoding (sorted, from 0) of part types."""
    df = part_like(spark, sf_dir)
    return LabelEncoder(["p_type"]).fit(df).transform(df).select("row_id", "p_type")


@register("enc_embedding_sizes", f"""
WITH {T}
SELECT col AS "column", n AS n_unique, CAST(LEAST(50, (n + 1) // 2) AS INTEGER) AS emb_dim FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS col, COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n FROM tr" for c in TRAIN_LIKE_CATS + ["y"])})""")
def enc_embedding_sizes(spark, sf_dir):
    """Category cardinality -> embedding width min(50, (n + 1) // 2)."""
    train, _ = _split(train_like(spark, sf_dir))
    return embedding_sizes(train, TRAIN_LIKE_CATS + ["y"])


# --------------------------------------------------------------------------- E9 / E10 / E11 / E12
CLASSES = ["F", "O", "P"]


def _fold_enc_sql(col: str, formula: str) -> str:
    k = len(CLASSES)
    sums = ", ".join(f"SUM(CASE WHEN y = '{c}' THEN 1.0 ELSE 0.0 END) AS s{i}" for i, c in enumerate(CLASSES))
    def val(n, s, prior):
        if formula == "mestimate":
            return f"({s} + 5.0 * {prior}) / ({n} + 5.0)"
        w = f"(1.0 / (1.0 + exp(-({n} - 20.0) / 10.0)))"
        return f"CASE WHEN {n} = 1 THEN {prior} ELSE {prior} * (1 - {w}) + ({s} / {n}) * {w} END"
    oof_cols = ", ".join(
        sql_round(f"CASE WHEN o.n IS NULL OR o.n = 0 THEN pf.p{i} ELSE {val('o.n', f'o.s{i}', f'pf.p{i}')} END") + f" AS {col}_{'me' if formula == 'mestimate' else 'te'}_{c}"
        for i, c in enumerate(CLASSES))
    full_cols = ", ".join(
        sql_round(f"CASE WHEN a.n IS NULL OR a.n = 0 THEN pa.p{i} ELSE {val('a.n', f'a.s{i}', f'pa.p{i}')} END") + f" AS {col}_{'me' if formula == 'mestimate' else 'te'}_{c}"
        for i, c in enumerate(CLASSES))
    return f"""
WITH {T}, {TRF},
cf AS (SELECT CAST({col} AS VARCHAR) AS key, fold, COUNT(*) AS n, {sums} FROM trf GROUP BY 1, 2),
ca AS (SELECT key, SUM(n) AS n, {", ".join(f"SUM(s{i}) AS s{i}" for i in range(k))} FROM cf GROUP BY key),
fo AS (SELECT DISTINCT fold FROM trf),
oof AS (SELECT ca.key, fo.fold, ca.n - COALESCE(cf.n, 0) AS n,
               {", ".join(f"ca.s{i} - COALESCE(cf.s{i}, 0) AS s{i}" for i in range(k))}
        FROM ca CROSS JOIN fo LEFT JOIN cf ON cf.key = ca.key AND cf.fold = fo.fold),
pf AS (SELECT fo.fold, {", ".join(f"AVG(CASE WHEN x.y = '{c}' THEN 1.0 ELSE 0.0 END) AS p{i}" for i, c in enumerate(CLASSES))}
       FROM fo JOIN trf x ON x.fold <> fo.fold GROUP BY fo.fold),
pa AS (SELECT {", ".join(f"AVG(CASE WHEN y = '{c}' THEN 1.0 ELSE 0.0 END) AS p{i}" for i, c in enumerate(CLASSES))} FROM trf)
SELECT trf.row_id, 'train' AS split, {oof_cols}
FROM trf JOIN pf ON pf.fold = trf.fold LEFT JOIN oof o ON o.key = CAST(trf.{col} AS VARCHAR) AND o.fold = trf.fold
UNION ALL
SELECT t.row_id, 'test' AS split, {full_cols}
FROM t CROSS JOIN pa LEFT JOIN ca a ON a.key = CAST(t.{col} AS VARCHAR) WHERE t.split = 'test'
"""


def _fold_enc(spark, sf_dir, est_cls, col, **kw):
    df = train_like(spark, sf_dir)
    train, test = _split(df)
    folded = stratified_folds(train, "y", k=5, seed=1337)
    model = est_cls(col, "y", CLASSES, "fold", **kw).fit(folded)
    oof = model.transform_oof(folded).select("row_id", F.lit("train").alias("split"), *model.names)
    full = model.transform(test).select("row_id", F.lit("test").alias("split"), *model.names)
    return rounded(oof.unionByName(full))


@register("enc_fold_target", _fold_enc_sql("o_orderpriority", "smooth"))
def enc_fold_target(spark, sf_dir):
    """Fold-aware smoothed target encoding (min_samples_leaf 20, smoothing 10), one column per
    class; train rows out-of-fold, test rows from the full-train map."""
    return _fold_enc(spark, sf_dir, FoldTargetEncoder, "o_orderpriority", min_samples_leaf=20, smoothing=10.0)


@register("enc_m_estimate", _fold_enc_sql("c_mktsegment", "mestimate"))
def enc_m_estimate(spark, sf_dir):
    """Cross-fit m-estimate (m = 5) per class; unseen -> prior."""
    return _fold_enc(spark, sf_dir, MEstimateEncoder, "c_mktsegment", m=5.0)


@register("enc_class_weights", f"""
WITH {T}, {TRF},
c AS (SELECT fold, y, COUNT(*) AS n FROM trf GROUP BY 1, 2),
fo AS (SELECT DISTINCT fold FROM trf UNION ALL SELECT -1),
tc AS (SELECT fo.fold, c.y, SUM(c.n) AS nc FROM fo JOIN c ON c.fold <> fo.fold GROUP BY 1, 2)
SELECT CAST(fold AS INTEGER) AS fold, y,
       {sql_round("SUM(nc) OVER (PARTITION BY fold) / (COUNT(*) OVER (PARTITION BY fold) * nc)")} AS weight
FROM tc WHERE nc > 0""")
def enc_class_weights(spark, sf_dir):
    """Balanced class weights n / (k n_c) of each fold's training part (fold -1 = all rows)."""
    train, _ = _split(train_like(spark, sf_dir))
    folded = stratified_folds(train, "y", k=5, seed=1337)
    return rounded(balanced_class_weights(folded, "y", "fold"))


# --------------------------------------------------------------------------- T9 / C9
PLAN = dict(
    clip_cols=("c_acctbal",), clip_factor=0.5, log_cols=("o_totalprice", "c_acctbal"),
    ratio_pairs=(("o_totalprice", "n_items"),), diff_pairs=(("sum_qty", "n_items"),),
    poly_cols=("avg_disc",), poly_degrees=(2,), num_num_pairs=(("o_totalprice", "avg_disc"),),
    num_cat_pairs=(("o_totalprice", "c_mktsegment"),), num_cat_stats=("mean",), num_cat_min_leaf=10,
    cat_cat_pairs=(("o_orderpriority", "c_mktsegment"),), cat_cat_max_card=200, angle=("alpha", "delta"),
)
_CC = "COALESCE(CAST(o_orderpriority AS VARCHAR), 'nan') || '__' || COALESCE(CAST(c_mktsegment AS VARCHAR), 'nan')"


@register("fe_feature_plan", f"""
WITH {T},
q AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM tr),
b AS (SELECT q1 - 0.5 * (q3 - q1) AS lo, q3 + 0.5 * (q3 - q1) AS hi FROM q),
c AS (SELECT t.* REPLACE (CASE WHEN c_acctbal < lo THEN lo WHEN c_acctbal > hi THEN hi ELSE c_acctbal END AS c_acctbal),
             {_CC} AS cc FROM t CROSS JOIN b),
ctr AS (SELECT * FROM c WHERE split = 'train'),
g AS (SELECT c_mktsegment AS key, CASE WHEN COUNT(o_totalprice) >= 10 THEN AVG(o_totalprice) END AS mean
      FROM ctr WHERE c_mktsegment IS NOT NULL GROUP BY 1),
gl AS (SELECT AVG(o_totalprice) AS gmean FROM ctr),
d AS (SELECT v, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS code FROM (SELECT DISTINCT cc AS v FROM ctr))
SELECT c.row_id, c.split, {sql_round('c.c_acctbal')} AS c_acctbal,
  {_f('CASE WHEN c.o_totalprice IS NULL THEN NULL ELSE ln(1 + greatest(c.o_totalprice, 0.0)) END')} AS o_totalprice_log1p,
  {_f('CASE WHEN c.c_acctbal IS NULL THEN NULL ELSE ln(1 + greatest(c.c_acctbal, 0.0)) END')} AS c_acctbal_log1p,
  {_f('c.o_totalprice / (c.n_items + 1e-6)')} AS o_totalprice_per_n_items,
  {_f('c.sum_qty - c.n_items')} AS sum_qty_minus_n_items,
  {_f('pow(c.avg_disc, 2.0)')} AS avg_disc_sq,
  {_f('c.o_totalprice * c.avg_disc')} AS o_totalprice_x_avg_disc,
  {_f('COALESCE(g.mean, gl.gmean)')} AS o_totalprice_by_c_mktsegment_mean,
  COALESCE(d.code, CAST(0 AS INTEGER)) AS o_orderpriority__c_mktsegment,
  {_f('cos(radians(c.delta)) * cos(radians(c.alpha))')} AS unit_x,
  {_f('cos(radians(c.delta)) * sin(radians(c.alpha))')} AS unit_y,
  {_f('sin(radians(c.delta))')} AS unit_z
FROM c LEFT JOIN g ON c.c_mktsegment = g.key LEFT JOIN d ON c.cc = d.v CROSS JOIN gl""")
def fe_feature_plan(spark, sf_dir):
    """The ordered block plan (clip, log1p, ratio, difference, power, num x num, num x cat,
    cat x cat with low-cardinality compounds routed to ordinal codes, unit vector) fitted on
    the train split and applied to every row."""
    from tabspark.operators.feature_plan import FeaturePlan

    df = train_like(spark, sf_dir)
    train, _ = _split(df)
    model = FeaturePlan(**PLAN).fit(train)
    cols = ["c_acctbal", "o_totalprice_log1p", "c_acctbal_log1p", "o_totalprice_per_n_items", "sum_qty_minus_n_items",
            "avg_disc_sq", "o_totalprice_x_avg_disc", "o_totalprice_by_c_mktsegment_mean", "o_orderpriority__c_mktsegment",
            "unit_x", "unit_y", "unit_z"]
    return rounded(model.transform(df).select("row_id", "split", *cols))


_COMPOUND = "o_orderpriority__c_mktsegment"
_COMPOUND_SQL = "COALESCE(CAST(o_orderpriority AS VARCHAR), 'nan') || '__' || COALESCE(CAST(c_mktsegment AS VARCHAR), 'nan')"


@register("fe_high_card_routing", _fold_enc_sql(_COMPOUND, "smooth").replace(TRAIN_LIKE_SQL, f"SELECT *, {_COMPOUND_SQL} AS {_COMPOUND} FROM ({TRAIN_LIKE_SQL})", 1))
def fe_high_card_routing(spark, sf_dir):
    """A compound with more categories than the plan takes for ordinal codes, routed into fold-aware target encoding: training
    rows from the other folds, test rows from all of them."""
    from tabspark.operators.feature_plan import FeaturePlan

    train, test = _split(train_like(spark, sf_dir))
    folded = stratified_folds(train, "y", k=5, seed=1337)
    plan = FeaturePlan(cat_cat_pairs=(("o_orderpriority", "c_mktsegment"),), cat_cat_low_card=10, target="y", classes=tuple(CLASSES))
    model = plan.fit(folded)
    assert model.high_card_cols == [_COMPOUND]
    names = [f"{_COMPOUND}_te_{c}" for c in CLASSES]
    rows = model.transform_train(folded).select("row_id", F.lit("train").alias("split"), *names)
    return rounded(rows.unionByName(model.transform(test).select("row_id", F.lit("test").alias("split"), *names)))


# --------------------------------------------------------------------------- V7 / E2
@register("fe_missing_columns", f"""
WITH t AS ({TRAIN_LIKE_SQL})
SELECT 'skip' AS policy, 'log1p' AS step, COUNT(*) AS n_rows, ROUND(SUM(CAST(CAST(ln(1 + GREATEST(o_totalprice, 0)) AS FLOAT) AS DOUBLE)), 0) AS total, 1 AS n_new, FALSE AS refused FROM t
UNION ALL SELECT 'skip', 'difference', COUNT(*), ROUND(SUM(o_totalprice), 0), 0, FALSE FROM t
UNION ALL SELECT 'error', 'log1p', COUNT(*), ROUND(SUM(o_totalprice), 0), 0, TRUE FROM t
UNION ALL SELECT 'error', 'difference', COUNT(*), ROUND(SUM(o_totalprice), 0), 0, TRUE FROM t""")
def fe_missing_columns(spark, sf_dir):
    """V7: steps that name a column the table lacks: skipped (the other columns are still done) or refused, the table as it was."""
    df = train_like(spark, sf_dir)
    out = None
    for policy in ("skip", "error"):
        for name, step in (("log1p", Log1p(["o_totalprice", "not_there"], on_missing=policy)), ("difference", Subtract([("o_totalprice", "not_there")], on_missing=policy))):
            try:
                done, refused = step.transform(df), False
            except KeyError:
                done, refused = df, True
            new = [c for c in done.columns if c not in df.columns]
            value = F.col(new[0] if new else "o_totalprice").cast("double")
            row = done.agg(F.count("*").alias("n_rows"), F.sum(value).alias("total")).select(
                F.lit(policy).alias("policy"), F.lit(name).alias("step"), "n_rows", F.round("total", 0).alias("total"), F.lit(len(new)).alias("n_new"), F.lit(refused).alias("refused"))
            out = row if out is None else out.unionByName(row)
    return out


@register("enc_target_cast", f"""
WITH bn AS ({BINARY_SQL}) SELECT row_id, CAST(quality AS VARCHAR) AS quality, toxic FROM bn""")
def enc_target_cast(spark, sf_dir):
    """The target cast to another type, the rest as it was."""
    return cast_target(binary(spark, sf_dir).select("row_id", "quality", "toxic"), "quality", "string")
