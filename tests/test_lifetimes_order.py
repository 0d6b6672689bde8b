import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.operators import ranking as R
from tabspark.operators.cv import stratified_folds
from tabspark.session import cut_lineage, materialise_small, temporary


def kept(spark):
    """(cached tables?, files below the checkpoint folder)."""
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return spark._jsparkSession.sharedState().cacheManager().isEmpty(), {f for f in glob.glob(f"{base}/*") if "metadata" not in f}


@pytest.mark.parametrize("name", ["fe_clip_iqr", "cross_num_cat", "blend_rank", "prof_histogram", "enc_ordinal"])
def test_nothing_is_left_after_a_query(spark, name):
    import __spark_entry__ as E

    queries = E.queries()
    assert name in queries
    spark.catalog.clearCache()
    before = kept(spark)[1]
    with temporary():
        assert len(queries[name](spark, "/root/testdata/sf0.001").collect()) > 0
    assert kept(spark) == (True, before)


def test_blocks_nest_and_end_on_errors(spark):
    spark.catalog.clearCache()
    before = kept(spark)[1]
    with temporary():
        outer, n = materialise_small(spark.range(5))
        with pytest.raises(RuntimeError), temporary():
            cut_lineage(spark.range(3))
            materialise_small(spark.range(7))
            raise RuntimeError
        assert kept(spark) == (False, before) and n == outer.count() == 5
    assert kept(spark) == (True, before)


def plain_before(rows, key):
    """Total weight before each row within its group; NULL first, NaN last, as Spark sorts."""
    def order(v):
        return tuple((0, 0) if x is None else (2, 0) if isinstance(x, float) and x != x else (1, x) for x in v)
    return {r["i"]: sum(q["w"] for q in rows if q["g"] == r["g"] and order(key(q)) < order(key(r))) for r in rows}


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_positions_with_ties_nulls_and_groups(spark, partitions):
    rng = random.Random(partitions)
    values = [None, float("nan"), float("inf"), -float("inf"), 0.0, 1e-300, -5.0, 7.25]
    rows = [{"i": k, "g": rng.choice(["a", "b", None]), "v": rng.choice(values) if k % 3 else rng.random(), "w": rng.randint(0, 4)} for k in range(400)]
    for r in rows[::4]:
        r["v"] = 0.5  # a quarter of all rows are tied: divided by the second column
    df = spark.createDataFrame([(r["i"], r["g"], r["v"], r["w"]) for r in rows], "i int, g string, v double, w int")
    got = {r.i: r["__before"] for r in R.count_before(df, ["g"], ["v", "i"], "w", partitions).collect()}
    assert got == plain_before(rows, lambda r: (r["v"], r["i"]))
    two = R.running_totals(df.withColumn("x", F.lit(1)), [], ["i"], ["w", "x"], partitions).collect()
    assert all(r["__before_x"] == r.i and r["__before_w"] == sum(q["w"] for q in rows if q["i"] < r.i) for r in two)


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "long", "decimal(20,3)", "boolean"])
def test_positions_of_other_types(spark, kind):
    rng = random.Random(1)
    texts = ["", "a", "b", "aé", "zz", "prefix-1", "prefix-2", "prefix-10", "Ω", "中"]
    df = spark.createDataFrame([(k, rng.choice(texts) if kind == "string" else rng.randint(-10**6, 10**6)) for k in range(200)], "i long, r " + ("string" if kind == "string" else "long"))
    cast = {"string": "r", "date": "date_add(DATE'2020-01-01', CAST(r % 1000 AS INT))", "timestamp": "timestamp_micros(r * 1000)", "long": "r * 1000000007 + 9007199254740993", "decimal(20,3)": "CAST(r / 7 AS DECIMAL(20,3))", "boolean": "r > 0"}
    df = df.selectExpr("i", f"{cast[kind]} AS v")
    got = [r.i for r in R.dense_index(df, [], ["v", "i"]).orderBy("index").collect()]
    assert got == [r.i for r in df.orderBy("v", "i").collect()]
    assert sorted(r["index"] for r in R.dense_index(df, [], ["v", "i"]).collect()) == list(range(200))


def test_average_rank_with_heavy_ties(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    v = np.where(rng.random(3000) < 0.4, 0.25, rng.random(3000).round(2))
    pdf = pd.DataFrame({"i": range(3000), "g": rng.choice(["a", "b"], 3000), "v": v})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(9999, "a", None)], "i long, g string, v double"))
    got = {r.i: r["rank"] for r in R.average_rank(df, ["g"], "v").collect()}
    assert got.pop(9999) is None
    want = pdf.groupby("g")["v"].rank(method="average")
    assert got == {int(i): want[i] for i in pdf["i"]}


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    return plan


def test_rows_are_exchanged_once(spark, tmp_path):
    spark.range(5000).selectExpr("id AS row_id", "CAST(id % 7 AS INT) AS y", "id * 0.5 AS x").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    folded = stratified_folds(df, "y")
    plan = exchanges(folded)
    # the rows once by (class, code); besides, the histogram's partial sums by (class, code) and its prefix sums by class
    assert plan.count("Exchange hashpartitioning") == 3 and "rangepartitioning" not in plan and "SinglePartition" not in plan and "Scan ExistingRDD" not in plan
    assert "Join" not in plan
    sizes = folded.groupBy("y", "fold").count().collect()
    assert max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 1
    ranked = exchanges(R.average_rank(df, ["y"], "x"))
    assert "rangepartitioning" not in ranked and "SortMergeJoin" not in ranked
