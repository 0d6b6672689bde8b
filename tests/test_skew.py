"""Hot-key behaviour: one key holding a third (or more) of the rows."""

import numpy as np
from pyspark.sql import functions as F

from tabspark.operators.cv import stratified_folds
from tabspark.operators.ranking import count_before


def _hot(spark, n=6000):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 7}", float((i * 7919) % 1000)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, g string, v double")


def test_count_before_spreads_a_hot_group_over_partitions(spark):
    df = _hot(spark)
    out = count_before(df, ["g"], ["v", "row_id"], num_partitions=8)
    # exact positions within the hot group
    hot = out.where(F.col("g") == "hot").orderBy("v", "row_id").select("__before").collect()
    assert [r[0] for r in hot] == list(range(len(hot)))
    # the hot group is not confined to one range partition
    parts = (df.where(F.col("g") == "hot").repartitionByRange(8, "g", "v", "row_id")
             .select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts > 1


def test_folds_balanced_with_a_dominant_class(spark):
    df = _hot(spark).withColumn("y", F.when(F.col("g") == "hot", "A").otherwise("B"))
    f = stratified_folds(df, "y", k=5, seed=1)
    sizes = {}
    for r in f.groupBy("y", "fold").count().collect():
        sizes.setdefault(r.y, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in sizes.values())


def test_group_quantile_of_hot_group_uses_bounded_path(spark):
    from tabspark.operators.quantile import group_quantiles

    df = _hot(spark)
    got = {(r.g, r.q): r.value for r in group_quantiles(df, "v", [0.5, 0.9], ["g"], buckets=16, finish_rows=50).collect()}
    pdf = df.toPandas()
    for (g, q), v in got.items():
        assert abs(v - np.quantile(pdf.loc[pdf.g == g, "v"], q)) < 1e-9
