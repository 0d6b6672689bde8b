import math

import numpy as np
import pandas as pd

from tabspark.operators import profile as P
from tabspark.operators.ranking import average_rank


def test_average_rank_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 500), "v": rng.integers(0, 40, 500).astype(float)})
    df = spark.createDataFrame(pdf)
    got = average_rank(df.withColumn("i", __import__("pyspark.sql.functions", fromlist=["x"]).monotonically_increasing_id()), ["g"], "v").toPandas()
    exp = pdf.assign(rank=pdf.groupby("g")["v"].rank(method="average"))
    a = got.groupby(["g", "v"])["rank"].first()
    b = exp.groupby(["g", "v"])["rank"].first()
    assert np.allclose(a.sort_index().values, b.sort_index().values)


def test_skew_kurt_match_pandas(spark):
    x = pd.Series([1.0, 2.0, 2.5, 9.0, 0.1, 3.3, None])
    df = spark.createDataFrame([(None if pd.isna(v) else float(v),) for v in x], "x double")
    r = P.univariate_summary(df, ["x"]).first()
    assert abs(r.skew - x.skew()) < 1e-9 and abs(r.kurtosis - x.kurt()) < 1e-9 and abs(r.median - x.median()) < 1e-12


def test_cramers_v_with_empty_cells(spark):
    rows = [("a", "x")] * 5 + [("a", "y")] * 1 + [("b", "y")] * 4 + [("c", "x")] * 2
    df = spark.createDataFrame(rows, "u string, v string")
    ct = pd.crosstab(pd.Series([r[0] for r in rows]), pd.Series([r[1] for r in rows])).to_numpy()
    n = ct.sum()
    e = ct.sum(1, keepdims=True) * ct.sum(0, keepdims=True) / n
    chi2 = ((ct - e) ** 2 / e).sum()
    expect = math.sqrt(chi2 / n / (min(ct.shape) - 1))
    assert abs(P.cramers_v(df, [("u", "v")]).first().cramers_v - expect) < 1e-12


def test_f_survival_closed_form():
    # F(2, d2): P(F > f) = (1 + 2 f / d2) ** (-d2 / 2)
    for f, d2 in ((0.5, 10), (3.0, 57), (12.0, 400)):
        assert abs(P.f_survival(f, 2, d2) - (1 + 2 * f / d2) ** (-d2 / 2)) < 1e-10


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.exponential(2, 1000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = [r["count"] for r in P.histogram(df, ["x"], bins=40).orderBy("bin").collect()]
    exp, _ = np.histogram(x, bins=40)
    assert sum(abs(a - b) for a, b in zip(got, exp)) <= 2  # edge rounding differences only


def test_kde_matches_formula(spark):
    x = np.array([0.0, 1.0, 1.5, 4.0, 4.2])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    out = P.kde(df, ["x"], grid_points=11).orderBy("point").collect()
    h = x.std(ddof=1) * len(x) ** (-0.2)
    for r in out:
        d = np.exp(-((r.x - x) ** 2) / (2 * h * h)).sum() / (len(x) * h * math.sqrt(2 * math.pi))
        assert abs(r.density - d) < 1e-12


def test_quantile_distance_and_ks_match_numpy(spark):
    from tabspark.operators.evaluate import ks_statistic, quantile_distance

    rng = np.random.default_rng(9)
    a, b = np.round(rng.normal(0, 1, 300), 2), np.round(rng.normal(0.2, 1.1, 170), 2)
    da = spark.createDataFrame([(float(v),) for v in a], "p double")
    db = spark.createDataFrame([(float(v),) for v in b], "p double")
    qd = quantile_distance(da, db).first()["quantile_distance"]
    exp_qd = np.abs(np.sort(a) - np.interp(np.linspace(0, 1, len(a)), np.linspace(0, 1, len(b)), np.sort(b))).max()
    assert abs(qd - exp_qd) < 1e-12
    grid = np.union1d(a, b)
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    assert abs(ks_statistic(da, db).first()["ks"] - np.abs(fa - fb).max()) < 1e-12


def test_binary_metrics_match_definitions(spark):
    from tabspark.operators.evaluate import binary_metrics

    y = np.array([1, 0, 1, 1, 0, 0, 1, 0, 1, 0])
    s = np.array([0.9, 0.8, 0.8, 0.6, 0.55, 0.5, 0.4, 0.3, 0.3, 0.1])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    r = binary_metrics(df).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    ap, tp = 0.0, 0
    for thr in np.unique(s)[::-1]:
        sel = s >= thr
        tp_t, prec = (y[sel] == 1).sum(), (y[sel] == 1).mean()
        ap += (tp_t - tp) / y.sum() * prec
        tp = tp_t
    pred = (s >= 0.5).astype(int)
    f1 = 2 * (pred & y).sum() / (pred.sum() + y.sum())
    assert abs(r.roc_auc - auc) < 1e-12 and abs(r.average_precision - ap) < 1e-12 and abs(r.f1 - f1) < 1e-12
