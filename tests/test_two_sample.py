import re

import numpy as np
import pytest

from tabspark.operators.evaluate import binary_metrics, two_sample
from tabspark.session import temporary


def plain(a, b):
    a, b = np.sort(a), np.sort(b)
    level = np.arange(len(a)) / (len(a) - 1) if len(a) > 1 else np.zeros(1)
    points = np.unique(np.concatenate((a, b)))
    f = lambda s: np.searchsorted(s, points, side="right") / len(s)
    return np.abs(a - np.quantile(b, level)).max(), np.abs(f(a) - f(b)).max()


def samples(seed):
    rng = np.random.default_rng(seed)
    yield "apart", rng.random(400), rng.random(300) * 0.5 + 2
    yield "ties", rng.integers(0, 4, 500) / 4.0, rng.integers(0, 6, 90) / 4.0
    yield "heavy", np.where(rng.random(800) < 0.5, 0.3, rng.random(800)), rng.random(1000) ** 4
    yield "one", np.array([0.5]), rng.random(20)
    yield None, rng.normal(size=60), np.array([0.1, 0.1])


@pytest.mark.parametrize("partitions", [1, 8, 60])
def test_equals_a_plain_version(spark, partitions):
    every = list(samples(partitions))
    table = lambda k: spark.createDataFrame([(s[0], float(x)) for s in every for x in s[k]] + [("apart", None), ("apart", float("nan")), (f"only{k}", 1.0)], "g string, p double")
    with temporary():
        got = {r.g: (r.quantile_distance, r.ks) for r in two_sample(table(1), table(2), "p", ["g"], partitions).collect()}
    assert set(got) == {s[0] for s in every}
    for g, a, b in every:
        assert got[g] == pytest.approx(plain(a, b), abs=1e-12), g


def test_without_groups(spark):
    _, a, b = list(samples(3))[2]
    one = two_sample(*(spark.createDataFrame([(float(x),) for x in s], "p double") for s in (a, b)))
    assert tuple(one.first()) == pytest.approx(plain(a, b), abs=1e-12) and one.columns == ["quantile_distance", "ks"]
    assert two_sample(spark.createDataFrame([], "p double"), one.selectExpr("ks AS p")).collect() == []


def test_two_exchanges_of_rows(spark, tmp_path):
    for name in "ab":
        spark.range(3000).selectExpr("CAST(id % 3 AS INT) AS g", "rand(1) AS p").write.parquet(f"{tmp_path}/{name}")
    out = two_sample(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b"), "p", ["g"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan and "Scan ExistingRDD" not in plan
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"[^d]Exchange hashpartitioning\(([^)]*)", "\n".join(x for x in plan.splitlines() if "ReusedExchange" not in x))]
    # rows: distinct values (shown again below each of the two cached small tables that were made from them), and their codes' tasks; the
    # rest is a row a code (the fronts of lookups, the cached tables) or a row a group
    assert sum(k.startswith("g, __v,") for k in keys) <= 3 and sum(k.startswith("g, __c,") for k in keys) in (1, 2)
    assert {k.rsplit(",", 1)[0] for k in keys} <= {"g, __v", "g, __c", "g, __code", "g"}


def test_binary_metrics_unchanged(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 30, 300) / 30
    r = binary_metrics(spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "label int, score double")).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert r.roc_auc == pytest.approx(auc, abs=1e-12)
