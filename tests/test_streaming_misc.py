import uuid


from tabspark.operators.cross import cardinalities
from tabspark.operators.transform import Log1p
from tabspark.sources.dataset import artifact_root
from tabspark.streaming.apply import apply_models, run_available, stream_table

SF = "/root/testdata/sf0.001"


def test_stream_apply_matches_batch(spark):
    model = Log1p(["value"])
    stream = stream_table(spark, SF, "events")
    root = artifact_root(spark, f"stream-test-{uuid.uuid4().hex[:8]}")
    out = run_available(apply_models(stream, [model]).select("event_id", "value_log1p"), f"{root}/sink", f"{root}/ckpt")
    batch = model.transform(spark.read.parquet(f"{SF}/events.parquet")).select("event_id", "value_log1p")
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_cardinalities_exact_and_approx(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("a", 2), (None, 3)], "c string, n int")
    assert cardinalities(df, ["c", "n"]) == {"c": 3, "n": 4}
    assert cardinalities(df, ["c", "n"], count_null=False) == {"c": 2, "n": 3}
    approx = cardinalities(df, ["c"], approx=True)
    assert approx["c"] == 3
