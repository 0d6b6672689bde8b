import numpy as np
import pandas as pd

from tabspark.operators.quantile import group_quantiles


def _frame(spark):
    rng = np.random.default_rng(7)
    g = np.where(rng.random(3000) < 0.6, "hot", rng.choice(["a", "b", "c"], 3000))
    v = np.round(rng.exponential(3, 3000), 2)  # many ties
    v[:5] = np.nan
    pdf = pd.DataFrame({"g": g, "v": v})
    return pdf, spark.createDataFrame([(a, None if np.isnan(b) else float(b)) for a, b in zip(g, v)], "g string, v double")


def test_direct_and_refined_paths_are_exact(spark):
    pdf, df = _frame(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    expect = {(g, q): s.dropna().quantile(q) for g, s in pdf.groupby("g")["v"] for q in probs}
    for kw in ({}, {"buckets": 8, "finish_rows": 5}):
        got = {(r.g, r.q): r.value for r in group_quantiles(df, "v", probs, ["g"], **kw).collect()}
        for k, v in expect.items():
            assert abs(got[k] - v) < 1e-9, (kw, k, got[k], v)


def test_global_quantiles_and_constant_group(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)], "v double")
    got = {r.q: r.value for r in group_quantiles(df, "v", [0.5, 1.0], buckets=4, finish_rows=1).collect()}
    assert got == {0.5: 1.0, 1.0: 2.0}


def test_approx_mode_close(spark):
    pdf, df = _frame(spark)
    got = {r.q: r.value for r in group_quantiles(df, "v", [0.5], exact=False).collect()}
    assert abs(got[0.5] - pdf["v"].dropna().median()) < 0.2
