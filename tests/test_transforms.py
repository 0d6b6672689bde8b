import math

import numpy as np
import pytest

from tabspark.operators.transform import AngleToUnitVector, ClipIQR, FoldStandardizer, Log1p, Polynomial, Ratio, Subtract


def test_log1p_null_and_floor(spark):
    df = spark.createDataFrame([(1, -5.0), (2, None), (3, float(math.e - 1))], "row_id long, x double")
    out = {r.row_id: r.x_log1p for r in Log1p(["x"]).transform(df).collect()}
    assert out[1] == 0.0 and out[2] is None and abs(out[3] - 1.0) < 1e-6


def test_ratio_zero_denominator_and_difference(spark):
    df = spark.createDataFrame([(1, 1.0, -1e-6), (2, 4.0, 2.0)], "row_id long, a double, b double")
    r = {x.row_id: x for x in Subtract([("a", "b")]).transform(Ratio([("a", "b")]).transform(df)).collect()}
    assert r[1].a_per_b is None
    assert abs(r[2].a_per_b - 4.0 / (2.0 + 1e-6)) < 1e-6 and r[2].a_minus_b == 2.0


def test_pairs_must_be_ordered(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "row_id long, a double, b double")
    with pytest.raises(TypeError):
        Ratio([{"a", "b"}]).transform(df)


def test_polynomial_names(spark):
    df = spark.createDataFrame([(1, 2.0)], "row_id long, x double")
    r = Polynomial(["x"], [2, 3, 5]).transform(df).first()
    assert (r.x_sq, r.x_cube, r.x_pow5) == (4.0, 8.0, 32.0)


def test_angle_unit_norm_and_collision(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0), (2, 359.9, -17.9)], "row_id long, alpha double, delta double")
    for r in AngleToUnitVector("alpha", "delta", "u_").transform(df).collect():
        assert abs(r.u_x ** 2 + r.u_y ** 2 + r.u_z ** 2 - 1) < 1e-6
    with pytest.raises(ValueError):  # an input band called z must not be overwritten
        AngleToUnitVector("alpha", "delta").transform(df.withColumn("z", df.delta * 0))


def test_clip_iqr_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=200), [50.0, -40.0]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_id long, x double")
    m = ClipIQR(["x"], 1.5, 1.5).fit(df)
    q1, q3 = np.percentile(x, [25, 75])
    lo, hi = m.bounds["x"]
    assert abs(lo - (q1 - 1.5 * (q3 - q1))) < 1e-9 and abs(hi - (q3 + 1.5 * (q3 - q1))) < 1e-9
    out = np.array([r.x for r in m.transform(df).orderBy("row_id").collect()])
    assert np.allclose(out, np.clip(x, lo, hi))
    assert m.clipped_counts(df)["x"] == int(((x < lo) | (x > hi)).sum())


def test_fold_standardizer_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3), float(v)) for i, v in enumerate(rng.normal(5, 2, size=60))]
    df = spark.createDataFrame(rows, "row_id long, fold int, x double")
    out = {r.row_id: r.x for r in FoldStandardizer(["x"]).fit(df).transform_oof(df).collect()}
    for i, f, v in rows[:10]:
        other = np.array([w for _, g, w in rows if g != f])
        assert abs(out[i] - (v - other.mean()) / other.std(ddof=1)) < 1e-5
