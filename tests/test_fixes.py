"""Cases at the sizes, types and NULLs that earlier versions failed on."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_quantiles_with_infinities_null_groups_and_extreme_ranges(spark):
    from tabspark.operators.quantile import group_quantiles

    inf = float("inf")
    data = {"a": [-inf, 1.0, 2.0, inf, inf], None: [5.0, 7.0], "c": [-1.7e308, 1.7e308, 0.0], "d": [5e-324, 0.0, 1e-323], "e": [3.0] * 50 + [4.0]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("a", float("nan")), ("z", None)], "g string, v double")
    for kw in ({}, {"buckets": 3, "finish_rows": 1}):
        got = {(r.g, r.q): r.value for r in group_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0], ["g"], **kw).collect()}
        assert {g for g, _ in got} == set(data)
        assert [got["a", q] for q in (0.0, 0.25, 0.5, 1.0)] == [-inf, 1.0, 2.0, inf]
        assert got[None, 0.25] == 5.5 and got["c", 0.5] == 0.0 and got["d", 1.0] == 1e-323 and got["e", 0.5] == 3.0


def test_cramers_v_and_mutual_information_of_large_counts(spark, monkeypatch):
    from tabspark.operators import profile as P

    # the contingency table of a few billion rows, as the grouped count would give it
    counts = spark.createDataFrame([("a", "y", "0", "0", 3_000_000_000), ("a", "y", "0", "1", 1_000_000_000), ("a", "y", "1", "0", 1_000_000_000), ("a", "y", "1", "1", 3_000_000_000)],
                                   "a string, b string, va string, vb string, n long")
    monkeypatch.setattr(P, "_pair_counts", lambda df, pairs: counts)
    small = spark.createDataFrame([("0", "0")], "a string, y string")
    assert P.cramers_v(small, [("a", "y")]).first().cramers_v == pytest.approx(0.5)
    assert P.mutual_information(small, "y", ["a"]).first().mi == pytest.approx(0.75 * np.log(1.5) + 0.25 * np.log(0.5))


def test_pearson_diagonal_of_a_constant_column_is_null(spark):
    from tabspark.operators.profile import pearson_matrix

    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "x double, k double")
    got = {(r.col_a, r.col_b): r.r for r in pearson_matrix(df, ["x", "k"]).collect()}
    assert got["x", "x"] == 1.0 and got["k", "k"] is None and got["x", "k"] is None


def test_f_survival_against_known_values():
    from tabspark.operators.profile import betainc, f_survival

    assert betainc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)  # 1 - sum of binomial terms
    assert betainc(0.5, 0.5, 0.5) == pytest.approx(0.5)
    assert f_survival(1.0, 1, 1) == pytest.approx(0.5)
    assert f_survival(4.0, 2, 10) == pytest.approx((1 + 2 * 4.0 / 10) ** -5)  # closed form for two numerator degrees
    assert f_survival(1.002, 2, 2_000_000) == pytest.approx(np.exp(-1.002), rel=1e-4)


def test_fold_standardiser_keeps_the_spread_of_large_means(spark):
    from tabspark.operators.transform import FoldStandardizer

    x = np.random.default_rng(0).normal(1e9, 1.0, 300)
    df = spark.createDataFrame([(int(k % 3), float(v)) for k, v in enumerate(x)], "fold int, x double")
    model = FoldStandardizer(["x"]).fit(df)
    for f in range(3):
        rest = np.array([v for k, v in enumerate(x) if k % 3 != f])
        assert model.stats[f]["x"] == pytest.approx((rest.mean(), rest.std(ddof=1)), rel=1e-6)


def test_ordinal_codes_beyond_sixteen_bits(spark):
    from tabspark.operators.encode import OrdinalEncoder

    df = spark.range(40_000).select(F.format_string("c%05d", "id").alias("c"))
    out = OrdinalEncoder(["c"]).fit(df).transform(df)
    assert out.agg(F.max("c")).first()[0] == 40_000


def test_fold_target_encoder_beside_columns_of_its_own_names(spark):
    from tabspark.operators.encode import FoldTargetEncoder

    df = spark.createDataFrame([(k, "ab"[k % 2], k % 3, "xy"[k // 2 % 2], 7, 0.5) for k in range(60)], "row_id long, c string, fold int, y string, n int, s0 double")
    out = FoldTargetEncoder("c", "y", ["x", "y"]).fit(df).transform_oof(df)
    assert out.count() == 60 and out.where("n = 7 AND s0 = 0.5").count() == 60


def test_folds_keep_rows_without_a_label(spark):
    from tabspark.operators.cv import stratified_folds

    df = spark.createDataFrame([(k, None if k % 4 == 0 else k % 2) for k in range(40)], "row_id long, y int")
    out = stratified_folds(df, "y", k=5, seed=3)
    assert out.count() == 40 and out.where("fold IS NULL").count() == 0


def test_binary_metrics_leave_out_rows_without_a_score(spark):
    from tabspark.operators.evaluate import binary_metrics

    rows = [(1, 0.9), (0, 0.2), (1, 0.8), (0, 0.4)]
    with_null = spark.createDataFrame(rows + [(0, None), (None, 0.99), (0, float("nan"))], "label int, score double")
    r = binary_metrics(with_null).first()
    assert (r.roc_auc, r.average_precision, r.f1) == (1.0, 1.0, 1.0)


def test_content_hash_tells_nulls_apart(spark):
    from tabspark.sources.dataset import content_hash

    one = spark.createDataFrame([("v", None)], "a string, b string")
    two = spark.createDataFrame([(None, "v")], "a string, b string")
    assert content_hash(one).first() != content_hash(two).first()
    assert content_hash(one).first() == content_hash(one.select("b", "a")).first()


def test_ledger_survives_mixed_types(spark, tmp_path):
    from tabspark.sources import runs

    for rec in ({"exp_name": "a", "n_folds": 5, "mean_cv_metric": 1}, {"exp_name": "b", "n_folds": "—", "mean_cv_metric": 0.5}, {"exp_name": "c", "mean_cv_metric": "—", "extra": [1, 2]}):
        runs.log_run(str(tmp_path), rec, spark)
    got = {r.exp_name: (r.n_folds, r.mean_cv_metric, r.extra) for r in runs.read_ledger(spark, str(tmp_path)).collect()}
    assert got == {"a": ("5", 1.0, None), "b": ("—", 0.5, None), "c": (None, None, json.dumps([1, 2]))}


def test_lineage_runs_to_its_end_and_stops_at_a_cycle(spark):
    from tabspark.sources.dataset import lineage

    names = "name string, slug string, parent string, rows long, data_hash string"
    chain = spark.createDataFrame([(f"d{k}", "s", f"d{k + 1}" if k < 79 else None, 1, "h") for k in range(80)], names).cache()
    assert lineage(chain, "d0").count() == 80
    ring = spark.createDataFrame([("a", "s", "b", 1, "h"), ("b", "s", "a", 1, "h")], names)
    assert [r.name for r in lineage(ring, "a").orderBy("depth").collect()] == ["a", "b"]


def test_streams_of_directory_tables(spark, tmp_path):
    from tabspark.streaming.apply import run_available, stream_table

    spark.range(100).repartition(4).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/other.parquet")
    out = run_available(stream_table(spark, str(tmp_path), "t"), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    assert sorted(r.id for r in out.collect()) == list(range(100))


def test_missing_and_unreadable_text_are_told_apart(spark, tmp_path):
    from tabspark.sources.dataset import read_text

    assert read_text(spark, f"{tmp_path}/none") is None
    with pytest.raises(Exception):
        read_text(spark, "nosuchscheme://host/path")
