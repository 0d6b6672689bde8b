import pytest
from pyspark.sql import functions as F

from tabspark.operators.cv import stratified_folds
from tabspark.operators.encode import (
    FoldTargetEncoder,
    MEstimateEncoder,
    MissingEncoder,
    OrdinalEncoder,
    TargetDictionary,
    balanced_class_weights,
    joint_factorize,
)


def test_target_dictionary_ties_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "y string")
    d = {r.label: r.code for r in TargetDictionary("y").fit(df).dictionary.collect()}
    assert d == {"c": 0, "a": 1, "b": 2}


def test_missing_flags_when_either_frame_has_nulls(spark):
    tr = spark.createDataFrame([(1, "a", 1.0, 1.0), (2, None, 3.0, 2.0)], "row_id long, c string, x double, z double")
    te = spark.createDataFrame([(3, "a", None, 5.0)], "row_id long, c string, x double, z double")
    m = MissingEncoder(["c"], ["x", "z"]).fit_pair(tr, te)
    a, b = m.transform(tr), m.transform(te)
    assert "x_has_missing" in a.columns and "z_has_missing" not in a.columns
    r = b.first()
    assert r.x == 2.0 and r.x_has_missing == "1"
    assert [x.c for x in a.orderBy("row_id").collect()] == ["a", "missing"]


def test_ordinal_unknown_and_reserved(spark):
    tr = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    te = spark.createDataFrame([("a",), ("zzz",), (None,)], "c string")
    m = OrdinalEncoder(["c"]).fit(tr)
    assert [r.c for r in m.transform(te).collect()] == [1, 0, 0]
    with pytest.raises(ValueError):
        OrdinalEncoder(["c"]).fit(spark.createDataFrame([("__UNKNOWN__",)], "c string"))


def test_factorize_first_appearance(spark):
    tr = spark.createDataFrame([(2, "x"), (1, "y"), (3, None)], "row_id long, c string")
    te = spark.createDataFrame([(0, "z"), (9, "x")], "row_id long, c string")
    a, b = joint_factorize(tr, te, ["c"])
    assert {r.row_id: r.c for r in a.collect()} == {1: 0, 2: 1, 3: -1}
    assert {r.row_id: r.c for r in b.collect()} == {0: 2, 9: 1}


def _data(spark):
    rows = [(i, ["A", "B", "C"][i % 3], ["p", "q"][(i * 7) % 5 % 2]) for i in range(300)]
    return stratified_folds(spark.createDataFrame(rows, "row_id long, cat string, y string"), "y", k=5, seed=3)


def test_folds_balanced(spark):
    df = _data(spark)
    counts = [r["n"] for r in df.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()]
    per = {}
    for r in df.groupBy("y", "fold").agg(F.count("*").alias("n")).collect():
        per.setdefault(r.y, []).append(r.n)
    assert all(max(v) - min(v) <= 1 for v in per.values()) and sum(counts) == 300


def test_oof_encoding_has_no_leakage(spark):
    df = _data(spark)
    enc = FoldTargetEncoder("cat", "y", ["p", "q"], min_samples_leaf=2, smoothing=1.0)
    base = {r.row_id: r.cat_te_p for r in enc.fit(df).transform_oof(df).collect()}
    flipped = df.withColumn("y", F.when(F.col("row_id") == 5, F.lit("q" if df.where("row_id = 5").first().y == "p" else "p")).otherwise(F.col("y")))
    again = {r.row_id: r.cat_te_p for r in enc.fit(flipped).transform_oof(flipped).collect()}
    assert abs(base[5] - again[5]) < 1e-12


def test_m_estimate_rows_sum_to_one(spark):
    df = _data(spark)
    m = MEstimateEncoder("cat", "y", ["p", "q"], m=5.0).fit(df)
    for r in m.transform_oof(df).collect():
        assert abs(r.cat_me_p + r.cat_me_q - 1) < 1e-12


def test_balanced_weights(spark):
    df = _data(spark)
    w = {(r.fold, r.y): r.weight for r in balanced_class_weights(df, "y").collect()}
    n = df.count()
    np_ = df.where("y = 'p'").count()
    assert abs(w[(-1, "p")] - n / (2 * np_)) < 1e-12


def test_ordinal_numeric_categories_sort_numerically(spark):
    from tabspark.operators.encode import LabelEncoder

    df = spark.createDataFrame([(10,), (2,), (33,)], "c int")
    assert [r.c for r in OrdinalEncoder(["c"]).fit(df).transform(df).collect()] == [2, 1, 3]
    assert [r.c for r in LabelEncoder(["c"]).fit(df).transform(df).collect()] == [0, 1, 2]  # "10" < "2" < "33"
