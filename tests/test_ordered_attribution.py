import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.operators.attribution import mean_attribution, shapley_values, shapley_wide
from tabspark.operators.cv import fit_oof, stratified_folds
from tabspark.operators.ordered import OrderedTargetEncoder
from tabspark.session import temporary


def table(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    cats = rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1]).tolist()
    rows = [(i, cats[i] if i % 17 else None, int(rng.integers(0, 2) if cats[i] == "a" else cats[i] == "b"), float(rng.normal()), float(rng.normal())) for i in range(n)]
    return stratified_folds(spark.createDataFrame(rows, "row_id long, cat string, label int, x1 double, x2 double"), "label", k=3, seed=5)


def test_ordered_statistics_equal_a_plain_version(spark):
    folded = table(spark)
    model = OrderedTargetEncoder(["cat"], "label", [0, 1], strength=2.0, seed=9).fit(folded)
    rows = folded.collect()
    got = {r.row_id: r for r in model.transform_train(folded).collect()}
    assert set(got) == {r.row_id for r in rows} and got[0].__fields__ == folded.columns + [model.feature("cat", k, f) for f in range(3) for k in (0, 1)]
    key = lambda r: ((r.row_id * 48271 + 9) % 2147483647, r.row_id)
    for r, f, k in itertools.product(rows, range(3), (0, 1)):
        others = [q for q in rows if q.fold != f]
        prior = sum(q.label == k for q in others) / len(others)
        seen = [q for q in others if q.cat == r.cat and (r.fold == f or key(q) < key(r))]
        want = (sum(q.label == k for q in seen) + 2.0 * prior) / (len(seen) + 2.0)
        assert got[r.row_id][model.feature("cat", k, f)] == pytest.approx(want, abs=1e-12)
    new = model.transform(spark.createDataFrame([("a", 1), ("new", 2), (None, 3)], "cat string, i int")).orderBy("i").collect()
    for f in range(3):
        others = [q for q in rows if q.fold != f]
        prior = sum(q.label for q in others) / len(others)
        for r, cat in zip(new, ("a", "new", None)):
            seen = [q for q in others if q.cat == cat]
            assert r[model.feature("cat", 1, f)] == pytest.approx((sum(q.label for q in seen) + 2.0 * prior) / (len(seen) + 2.0))


def test_own_label_does_not_enter_a_row(spark):
    """Turning a row's label over changes neither its own features nor those of rows before it (priors apart)."""
    folded = table(spark, 60)
    flipped = folded.withColumn("label", F.when(F.col("row_id") == 30, 1 - F.col("label")).otherwise(F.col("label")))
    enc = OrderedTargetEncoder(["cat"], "label", [0, 1], strength=1e-9, seed=9)
    one, two = ({r.row_id: r for r in enc.fit(d).transform_train(d).collect()} for d in (folded, flipped))
    own = one[30].fold
    for f in range(3):
        assert one[30][f"cat_ots1_f{f}"] == pytest.approx(two[30][f"cat_ots1_f{f}"], abs=1e-6)
        if f == own:  # the held-out fold's labels never enter the features of its own model
            assert all(one[i][f"cat_ots1_f{f}"] == pytest.approx(two[i][f"cat_ots1_f{f}"], abs=1e-6) for i in one)


def test_fold_columns_reach_each_folds_model(spark):
    folded = table(spark)
    model = OrderedTargetEncoder(["cat"], "label", [0, 1]).fit(folded)
    test = model.transform(spark.createDataFrame([(1000 + i, c, 0.0, 0.0) for i, c in enumerate(["a", "b", "c", None])], "row_id long, cat string, x1 double, x2 double"))
    res = fit_oof(model.transform_train(folded), test, ["x1", *model.features()], "label", "decision_tree", {"maxDepth": 3, "seed": 1}, n_classes=2)
    assert res.oof.count() == 480 and res.test.count() == 8
    p = {r.row_id: r.p for r in res.test.where("class = 1").collect()}
    assert p[1001] > 0.8 and p[1002] < 0.2  # the label is the category, but for "a"


@pytest.fixture(scope="module")
def fitted(spark):
    folded = table(spark).withColumn("x3", F.col("x1") * F.col("x2"))
    return folded, fit_oof(folded, folded, ["x1", "x2", "x3"], "label", "decision_tree", {"maxDepth": 3, "seed": 1}, n_classes=2, run="dt")


def test_contributions_add_up_to_prediction_less_base(spark, fitted):
    folded, res = fitted
    with temporary():
        values = shapley_values(res, folded, ["x1", "x2", "x3"], sample=10, background=6, draws=5)
        wide = shapley_wide(values, ["x1", "x2", "x3"]).collect()
        means = mean_attribution(values).collect()
    assert len(wide) == 3 * 10 * 2 and {r.fold for r in wide} == {0, 1, 2} and len(means) == 6
    probs = {(r.row_id, r["class"]): r.p for r in res.oof.collect()}
    for r in wide:
        assert r.x1 + r.x2 + r.x3 == pytest.approx(r.prediction - r.base, abs=1e-12)
        assert r.prediction == pytest.approx(probs[r.row_id, r["class"]], abs=1e-12)  # by the model that has not seen the row


def test_enumeration_gives_exact_shapley_values(spark, fitted):
    from pyspark.ml.linalg import Vectors

    folded, res = fitted
    feats = ["x1", "x2", "x3"]
    values = shapley_values(res, folded, feats, sample=4, background=3, enumerate_orders=True).collect()
    rows = {r.row_id: [r[c] for c in feats] for r in folded.collect()}
    key = lambda i: ((i * 48271 + 7) % 2147483647, i)
    for fold in range(3):
        model = res.models[fold]
        fold_of = {r.row_id: r.fold for r in folded.collect()}
        back = [rows[i] for i in sorted(sorted((i for i in rows if fold_of[i] != fold), key=key)[:3])]
        f = lambda x: model.predictProbability(Vectors.dense(x)).toArray()
        for i in sorted((i for i in rows if fold_of[i] == fold), key=key)[:4]:
            x = rows[i]
            worth = lambda s: np.mean([f([x[k] if k in s else z[k] for k in range(3)]) for z in back], axis=0)  # noqa: E731, B023
            for k in range(3):
                others = [j for j in range(3) if j != k]
                want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (worth({*s, k}) - worth(set(s))) for n in range(3) for s in itertools.combinations(others, n))
                got = {v["class"]: v.contribution for v in values if v.row_id == i and v.feature == feats[k]}
                assert [got[0], got[1]] == pytest.approx(list(want), abs=1e-9)


def test_test_mean_is_a_projection_of_the_models(spark):
    folded = table(spark)
    test = spark.createDataFrame([(1000 + i, float(i), -float(i)) for i in range(7)], "row_id long, x1 double, x2 double")
    for kind, params in (("decision_tree", {"maxDepth": 3, "seed": 1}), ("gbt_ovr", {"maxIter": 2, "maxDepth": 2, "seed": 1})):
        runs = [fit_oof(folded, test, ["x1", "x2"], "label", kind, params, n_classes=2, parallel=n) for n in (1, 3)]
        one, two = (sorted(map(tuple, r.test.select("row_id", "class", "p").collect())) for r in runs)
        assert one == two and len(one) == 14  # however many folds are fitted at a time
        assert sorted(map(tuple, runs[0].oof.select("row_id", "class", "p").collect())) == sorted(map(tuple, runs[1].oof.select("row_id", "class", "p").collect()))
        if kind == "decision_tree":
            from pyspark.ml.linalg import Vectors

            for row, c, p in one:
                each = [m.predictProbability(Vectors.dense([row - 1000.0, 1000.0 - row]))[c] for m in runs[0].models.values()]
                assert p == pytest.approx(sum(each) / 3, abs=1e-12)
