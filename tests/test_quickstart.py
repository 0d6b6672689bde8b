from pyspark.sql import functions as F

from tabspark.operators import evaluate
from tabspark.operators.cv import fit_oof, stratified_folds
from tabspark.operators.encode import MissingEncoder
from tabspark.plans.fixtures import TRAIN_LIKE_NUMS, train_like


def test_readme_quick_start_flow(spark):
    df = train_like(spark, "/root/testdata/sf0.001")
    train = df.where(F.col("split") == "train").withColumn("label", (F.col("y") == "F").cast("int"))
    test = df.where(F.col("split") == "test")
    enc = MissingEncoder([], TRAIN_LIKE_NUMS).fit_pair(train, test)
    train, test = enc.transform(train), enc.transform(test)
    folded = stratified_folds(train, "label", k=3, seed=1337)
    run = fit_oof(folded, test, TRAIN_LIKE_NUMS, "label", "random_forest", {"numTrees": 5, "seed": 1})
    rows = evaluate.scores(run.oof, folded.select("row_id", "fold", folded.label.alias("y"))).collect()
    assert len(rows) == 1 and 0 <= rows[0].bal_acc <= 1 and rows[0].logloss > 0
    assert run.oof.select("row_id").distinct().count() == folded.count()
