import uuid

import pytest

from tabspark.sources import dataset as DS
from tabspark.sources import runs as RS
from tabspark.spec import FeatureSpec, LearnerSpec, override


def test_sidecar_roundtrip_and_ledger_growth(spark):
    root = DS.artifact_root(spark, f"t-{uuid.uuid4().hex[:8]}")
    df = spark.createDataFrame([(1, "a", 1.5, "x"), (2, "b", None, "y")], "row_id long, c string, v double, y string")
    meta = DS.save_dataset(df, f"{root}/d_v1", "d", ["y"])
    back = DS.load_meta(spark, f"{root}/d_v1")
    assert back["num_stats"]["v"]["n_null"] == 1 and back["rows"] == 2 and back["str_cols"] == ["c"]
    assert meta["data_hash"] == back["data_hash"]
    RS.log_run(root, {"exp_name": "a", "mean_cv_metric": 0.5}, spark)
    RS.log_run(root, {"exp_name": "b", "mean_cv_metric": 0.7, "extra": "new column"}, spark)
    led = RS.read_ledger(spark, root)
    assert "extra" in led.columns and led.count() == 2
    assert RS.leaderboard(led).orderBy("rank").first().exp_name == "b"


def test_content_hash_is_order_insensitive(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as k")
    a = DS.content_hash(df).first()
    b = DS.content_hash(df.orderBy("k").repartition(5)).first()
    assert a == b


def test_specs_validate():
    with pytest.raises(ValueError):
        FeatureSpec("y", ("a",), ("a",))
    with pytest.raises(ValueError):
        LearnerSpec("random_forest", {"gamma": 1})
    s = override(LearnerSpec("random_forest", {"numTrees": 5}), params={"maxDepth": 3})
    assert s.params == {"numTrees": 5, "maxDepth": 3}
    with pytest.raises(ValueError):
        override(LearnerSpec("gbt_ovr", {}), params={"stepSize": 2.0})
