import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.operators import profile as P
from tabspark.operators.transform import ClipIQRModel
from tabspark.sources.dataset import lineage


def psi(n):
    return -P.EULER_GAMMA + sum(1 / i for i in range(1, n))


def plain_mi(rows, k):
    """rows: (class, value); classes of one row are left out."""
    sizes = {}
    for y, _ in rows:
        sizes[y] = sizes.get(y, 0) + 1
    rows = [(y, v) for y, v in rows if sizes[y] > 1]
    total = 0.0
    for i, (y, v) in enumerate(rows):
        own = min(k, sizes[y] - 1)
        d = sorted(abs(v - w) for j, (z, w) in enumerate(rows) if z == y and j != i)[own - 1]
        m = max(1, sum(abs(v - w) < d for _, w in rows))
        total += psi(own) - psi(sizes[y]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.mark.parametrize("partitions", ["2", "40"])
def test_nearest_neighbour_information(spark, partitions):
    rng = np.random.default_rng(8)
    n = 300
    y = rng.choice(["a", "b", "c"], n, p=[0.7, 0.25, 0.05]).tolist()
    shift = {"a": 0, "b": 30, "c": 60}
    apart = [float(rng.integers(0, 60) + shift[c]) for c in y]  # whole numbers: many ties
    same = [float(x) for x in rng.integers(0, 10**6, n)]
    rows = [(i, y[i], apart[i], same[i] if i % 7 else None) for i in range(n)] + [(900, "alone", 5.0, 5.0), (901, None, 1.0, 1.0), (902, "a", float("nan"), None), (903, "two", 1.0, 2.0), (904, "two", 9.0, 2.0)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.feature: r for r in P.knn_mutual_information(spark.createDataFrame(rows, "row_id long, y string, apart double, same double"), "y", ["apart", "same"], 3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for c, at in (("apart", 2), ("same", 3)):
        use = [(r[1], r[at]) for r in rows if r[1] is not None and r[at] is not None and r[at] == r[at]]
        assert got[c].mi == pytest.approx(plain_mi(use, 3), abs=1e-9)
        assert got[c].n_rows == len([1 for y_, _ in use if y_ != "alone"])
    assert got["apart"].mi > 0.3 > got["same"].mi


def test_digamma(spark):
    got = spark.range(1, 60).select("id", P.digamma(F.col("id")).alias("d")).collect()
    assert all(r.d == pytest.approx(psi(r.id), abs=1e-10) for r in got)


@pytest.mark.parametrize("kind", ["normal", "heavy", "two"])
def test_kde_equals_the_formula(spark, kind):
    rng = np.random.default_rng(6)
    x = {"normal": rng.normal(size=500), "heavy": np.concatenate((rng.standard_cauchy(400) * 5, [1e4])), "two": np.array([1.0, 2.0])}[kind]
    out = P.kde(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"], grid_points=60).orderBy("point").collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 60)
    want = np.exp(-(((grid[:, None] - x) / h) ** 2) / 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert [r.x for r in out] == pytest.approx(list(grid)) and np.abs(np.array([r.density for r in out]) - want).max() < 1e-12 * want.max() + 1e-15


def test_lineage_of_many_ancestors_and_a_cycle(spark):
    chain = [(f"d{i:02}", "s", f"d{i + 1:02}" if i < 80 else None, i, "h") for i in range(81)]
    chain += [("x", "s", "y", 1, "h"), ("y", "s", "x", 1, "h"), ("z", "s", "gone", 1, "h")]
    cat = spark.createDataFrame(chain, "name string, slug string, parent string, rows long, data_hash string")
    rows = lineage(cat, "d00").orderBy("depth").collect()
    assert [(r.depth, r.name, r.found) for r in rows] == [(i, f"d{i:02}", True) for i in range(81)]
    assert [(r.name, r.parent) for r in lineage(cat, "x").orderBy("depth").collect()] == [("x", "y"), ("y", "x")]
    assert [(r.name, r.found) for r in lineage(cat, "z").orderBy("depth").collect()] == [("z", True), ("gone", False)]


def test_whole_numbers_are_clipped_inside_the_fences(spark):
    df = spark.createDataFrame([(v, float(v)) for v in (-9, 0, 1, 5, 6, 99)], "i int, d double")
    out = ClipIQRModel({"i": (0.5, 5.5), "d": (0.5, 5.5)}).transform(df).collect()
    assert [r.i for r in out] == [1, 1, 1, 5, 5, 5] and [r.d for r in out] == [0.5, 0.5, 1.0, 5.0, 5.5, 5.5]
