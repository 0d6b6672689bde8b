"""Tables in buckets of their row: what groups and joins by row stays where it is, and a task's share does not grow with the table."""

import pytest
from pyspark.sql import functions as F

from tabspark import session as S
from tabspark.operators import blend as BL
from tabspark.operators import evaluate as EV
from tabspark.operators.cv import fit_oof
from tabspark.plans.probs import prob_runs
from tabspark.sources import dataset as DS


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_probability_sets_are_grouped_and_joined_where_they_are(spark, unbroadcast):
    with S.temporary():
        oof, tst, labels = prob_runs(spark, "/root/testdata/sf0.001")
        lab = labels.where("split = 'train'")
        assert exchanges(EV.max_prob(oof)) == exchanges(EV.max_prob(tst)) == exchanges(BL.blend_equal(oof)) == 0
        assert exchanges(EV.scores(oof, lab)) == 2  # of the sums by class, and by run
        sums = oof.groupBy("run", "row_id").agg(F.sum("p").alias("s"), F.count("*").alias("n")).agg(F.min("n"), F.max("n"), F.max(F.abs(F.col("s") - 1))).first()
        assert tuple(sums)[:2] == (3, 3) and sums[2] < 1e-9


def test_a_models_probabilities_are_grouped_where_they_are(spark, unbroadcast):
    rows = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("fold"), F.col("id").cast("double").alias("x"))
    with S.temporary():
        res = fit_oof(rows, rows.select("row_id", "x"), ["x"], kind="decision_tree", params={"maxDepth": 2, "seed": 1}, n_classes=2)
        assert exchanges(res.oof.groupBy("run", "row_id", "fold").count()) == exchanges(res.test.groupBy("run", "row_id").count()) == 0
        assert res.oof.count() == res.test.count() == 120 and res.oof.select("row_id").distinct().count() == 60


def test_partitions_grow_with_the_rows(spark):
    assert S.spread(spark, 0) == 1
    assert S.spread(spark, 100 * S.ROWS_PER_BUCKET) == 100 and S.spread(spark, 1000 * S.ROWS_PER_BUCKET) == 1000


def test_cut_tables_hold_all_rows_and_go(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, None, None), (None, "b", 1.5)], "k long, s string, v double")
    with S.temporary():
        for cut in (S.cut_lineage(df), S.cut_by_key(df, "k", 3)):
            assert cut.schema.names == df.schema.names and sorted(map(str, cut.collect())) == sorted(map(str, df.collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("keyed_")]


def test_scores_of_a_leaderboard_are_worked_out_once(spark):
    with S.temporary():
        single = spark.createDataFrame([("a", 0.5, 0.6), ("b", 0.4, 0.7)], "run string, logloss double, bal_acc double")
        blends = spark.createDataFrame([("eq", 0.3, 0.8, "blend")], "strategy string, logloss double, bal_acc double, note string")
        board = EV.leaderboard(single, blends)
        assert "InMemoryTableScan" in board._jdf.queryExecution().executedPlan().toString()
        assert {r.strategy: r.delta_vs_best_single for r in board.collect()} == {"a": None, "b": None, "eq": pytest.approx(-0.1)}


def test_both_fingerprints_come_from_one_pass(spark):
    df = spark.createDataFrame([(1, "a", 0.25), (2, None, None), (2, None, None)], "k long, s string, v double")
    both = DS.fingerprints(df).first()
    assert (both.hash_sum, both.rows) == tuple(DS.portable_fingerprint(df).first())
    assert (both.fast_sum, both.rows) == tuple(DS.content_hash(df).first())
