import numpy as np

from tabspark.operators import blend as BL
from tabspark.operators import evaluate as EV


def _probs(spark):
    rng = np.random.default_rng(11)
    n, k = 300, 3
    y = rng.integers(0, k, n)
    rows, labels = [], [(i, int(y[i])) for i in range(n)]
    for m, sharp in enumerate((2.0, 0.5, 1.0)):
        for i in range(n):
            logits = rng.normal(size=k)
            logits[y[i]] += sharp
            p = np.exp(logits) / np.exp(logits).sum()
            rows += [(f"r{m}", i, c, float(p[c])) for c in range(k)]
    return spark.createDataFrame(rows, "run string, row_id long, class int, p double"), \
        spark.createDataFrame(labels, "row_id long, y int")


def test_equal_blend_rows_sum_to_one(spark):
    long, _ = _probs(spark)
    sums = BL.blend_equal(long).groupBy("row_id").sum("p").collect()
    assert all(abs(r[1] - 1) < 1e-12 for r in sums)


def test_optimised_not_worse_than_singles_and_says_whether_it_converged(spark):
    long, lab = _probs(spark)
    local = BL.optimise_weights(long, lab)
    assert local.converged and not BL.optimise_weights(long, lab, max_iter=2).converged
    singles = {r.run: r.logloss for r in EV.log_loss(long, lab).collect()}
    eq = EV.log_loss(BL.blend_equal(long).withColumn("run", __import__("pyspark.sql.functions", fromlist=["x"]).lit("eq")), lab).first().logloss
    margin = 1e-9
    assert local.logloss <= min(singles.values()) + margin and local.logloss <= eq + margin


def test_weights_meet_the_optimality_conditions(spark):
    rng = np.random.default_rng(5)
    p = np.clip(rng.random((400, 3)) ** [0.5, 0.8, 2.5], 0.02, 0.98)  # of the true class, by run
    long = spark.createDataFrame([(i, f"r{m}", c, float(p[i, m] if c else 1 - p[i, m])) for i in range(400) for m in range(3) for c in (0, 1)], "row_id long, run string, class int, p double")
    res = BL.optimise_weights(long, spark.createDataFrame([(i, 1) for i in range(400)], "row_id long, y int"))
    w = np.array([dict(zip(res.runs, res.weights))[f"r{m}"] for m in range(3)])
    gain = (p / (p @ w)[:, None]).mean(axis=0)  # 1 where the weight is positive, at most 1 elsewhere
    assert abs(w.sum() - 1) < 1e-9 and gain.max() < 1 + 1e-7 and abs(gain[w > 1e-6] - 1).max() < 1e-7


def test_plans_have_no_python_udf_or_cartesian(spark):
    import __spark_entry__ as E

    qs = E.queries()
    for name in ("flagship_feature_slice", "enc_fold_target", "cross_num_cat", "prof_univariate"):
        plan = qs[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, (name, bad)


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
