"""Run artifacts, the run ledger, submissions and run orchestration.

Layout under a shared ``root``::

    probs/run=<run>/split=<oof|test>/   (row_id, fold, probs array<double>) parquet
    runs/<run>/meta, runs/<run>/config  one-line JSON text
    ledger/                              append-only parquet, schema grows (mergeSchema)
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabspark.functions.exprs import argmax_index
from tabspark.operators.blend import collect_probs, explode_probs
from tabspark.sources.dataset import path_exists, write_text

# ledger columns that hold numbers; every other column is text
LEDGER_NUMBERS = {"mean_cv_metric", "std_cv_metric", "mean_logloss", "std_logloss", "cv_auc", "cv_logloss", "seconds"}


def _exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, path)


# --------------------------------------------------------------------------- S8 / S10 / B6
def save_run(root: str, run: str, oof: DataFrame, test: DataFrame, meta: dict, config: dict | None = None,
             overwrite: bool = False) -> None:
    """S8 + S10: persist a run's OOF and test probability sets (partitioned by run and split),
    its metadata and a config snapshot; an existing run name is refused."""
    spark = oof.sparkSession
    if not overwrite and _exists(spark, f"{root}/runs/{run}/meta"):
        raise FileExistsError(f"run {run!r} already exists under {root}")
    keep_oof = ["row_id", "fold"] if "fold" in oof.columns else ["row_id"]
    o = collect_probs(oof.drop("run"), keep=keep_oof)
    if "fold" not in o.columns:
        o = o.withColumn("fold", F.lit(None).cast("int"))
    t = collect_probs(test.drop("run"), keep=["row_id"]).withColumn("fold", F.lit(None).cast("int"))
    both = o.withColumn("split", F.lit("oof")).unionByName(t.withColumn("split", F.lit("test"))).withColumn("run", F.lit(run))
    (both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run", "split").parquet(f"{root}/probs"))
    write_text(spark, f"{root}/runs/{run}/meta", json.dumps({"fname": run, **meta}))
    if config is not None:
        write_text(spark, f"{root}/runs/{run}/config", json.dumps(config))


def load_configs(spark: SparkSession, root: str) -> DataFrame:
    """``(run, param, value)`` of every run folder's configuration JSON."""
    raw = spark.read.text(f"{root}/runs/*/config").withColumn("run", F.regexp_extract(F.input_file_name(), r"/runs/([^/]+)/config", 1))
    return raw.select("run", F.explode(F.from_json("value", "map<string,string>")).alias("param", "value"))


# --------------------------------------------------------------------------- S11 / S12 / S13 / S14
def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """Every run folder with metadata; the metric falls back from ``cv_auc`` to
    ``mean_cv_metric`` and the log-loss from ``cv_logloss`` to ``mean_logloss``; sorted by metric (desc)."""
    schema = "fname string, train string, test string, created string, cv_auc double, mean_cv_metric double, cv_logloss double, mean_logloss double"
    raw = spark.read.text(f"{root}/runs/*/meta")
    m = raw.select(F.from_json("value", schema).alias("m")).select("m.*")
    return m.select(F.col("fname").alias("run"), "train", "created",
                    F.coalesce("cv_auc", "mean_cv_metric").alias("metric"), F.coalesce("cv_logloss", "mean_logloss").alias("logloss")
                    ).orderBy(F.desc("metric"), "run")


def select_runs(runs: DataFrame, names: Sequence[str] | None = None) -> list[str]:
    """Chosen run names (or all); at least two are needed for blending."""
    chosen = runs if not names else runs.where(F.col("run").isin(list(names)))
    got = [r["run"] for r in chosen.select("run").collect()]  # run names: a short list
    if names:
        missing = sorted(set(names) - set(got))
        if missing:
            raise KeyError(f"runs not found: {missing}")
    if len(got) < 2:
        raise ValueError("need at least two runs to blend")
    return got


def load_probs(spark: SparkSession, root: str, runs: Sequence[str], split: str) -> DataFrame:
    """Long ``(run, row_id, class, p)`` of the chosen runs (partition-pruned read), after the
    consistency checks: same row count, same key set and same class count for every run."""
    df = spark.read.parquet(f"{root}/probs").where(F.col("run").isin(list(runs)) & (F.col("split") == split))
    chk = df.groupBy("run").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("row_id").cast("decimal(38,0)")).alias("keys"),
        F.min(F.size("probs")).alias("kmin"), F.max(F.size("probs")).alias("kmax")).collect()
    if len({(r["n"], r["keys"]) for r in chk}) > 1 or len({(r["kmin"], r["kmax"]) for r in chk}) > 1 or \
            any(r["kmin"] != r["kmax"] for r in chk):
        raise AssertionError(f"probability sets are not aligned: {[r.asDict() for r in chk]}")
    if len(chk) != len(set(runs)):
        raise KeyError("some runs have no stored probabilities")
    return explode_probs(df, keep=["run", "row_id"])


def load_labels(spark: SparkSession, root: str, runs: Sequence[str], target: str, classes: Sequence[str],
                frame_loader: Callable[[str], DataFrame]) -> DataFrame:
    """Ground truth ``(row_id, y)`` from the training dataset named in the runs' metadata."""
    trains = {r["train"] for r in discover_runs(spark, root).where(F.col("run").isin(list(runs))).collect()}
    if len(trains) != 1:
        raise ValueError(f"runs were trained on different datasets: {sorted(map(str, trains))}")
    df = frame_loader(trains.pop())
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target).cast("string")) - 1
    return df.select("row_id", code.cast("int").alias("y"))


# --------------------------------------------------------------------------- S7 / S17
def log_run(root: str, record: dict, spark: SparkSession) -> None:
    """Append one ledger row (append-only; new keys become new columns on read).

    A column has one type whatever a record holds: ``LEDGER_NUMBERS`` are doubles, all others
    strings (lists and dicts as JSON), so a placeholder in one row leaves the others readable."""
    rec = {"run_id": uuid.uuid4().hex, "date": datetime.datetime.now().strftime("%Y-%m-%d %H:%M"), **record}
    fields = [f"`{k}` {'double' if k in LEDGER_NUMBERS else 'string'}" for k in rec]
    vals = tuple(_ledger_number(v) if k in LEDGER_NUMBERS else _ledger_text(v) for k, v in rec.items())
    spark.createDataFrame([vals], ", ".join(fields)).write.mode("append").parquet(f"{root}/ledger")


def _ledger_number(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def _ledger_text(v):
    return v if v is None or isinstance(v, str) else json.dumps(v)


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/ledger")


def batch_summary(spark: SparkSession, rows: list[tuple], path: str | None = None) -> DataFrame:
    """Per-run status of a batch ``(name, status, error, seconds)``, optionally written."""
    df = spark.createDataFrame(rows, "name string, status string, error string, seconds double")
    if path:
        df.write.mode("overwrite").parquet(path)
    return df


# --------------------------------------------------------------------------- S9
def write_submission(preds: DataFrame, keys: DataFrame, classes: Sequence[str], path: str, as_label: bool = True) -> DataFrame:
    """First-max class per row joined onto the expected key list (``row_id``), written as
    CSV, re-read and checked: two columns, one row per key, no missing prediction."""
    spark = preds.sparkSession
    code = argmax_index("probs")
    lab = F.array(*[F.lit(c) for c in classes])[code] if as_label else code
    p = preds.select("row_id", lab.alias("class"))
    out = keys.select("row_id").join(p, "row_id", "left")
    out.write.mode("overwrite").option("header", True).csv(path)
    back = spark.read.option("header", True).csv(path)
    chk = back.agg(F.count("*").alias("n"), F.sum(F.col("class").isNull().cast("long")).alias("missing")).first()
    n_keys = keys.count()
    if len(back.columns) != 2 or chk["n"] != n_keys or chk["missing"]:
        raise AssertionError(f"submission check failed: columns={back.columns} rows={chk['n']}/{n_keys} missing={chk['missing']}")
    return back.select(F.col("row_id").cast("bigint").alias("row_id"), "class")


# --------------------------------------------------------------------------- B10 / B23-B28
def leaderboard(ledger: DataFrame, metric: str = "mean_cv_metric") -> DataFrame:
    """Runs ranked by metric (desc, ties by name)."""
    w = Window.orderBy(F.desc_nulls_last(metric), "exp_name")
    return ledger.withColumn("rank", F.row_number().over(w))


def two_metric_table(ledger: DataFrame) -> DataFrame:
    """Rank by metric (desc) and by log-loss (asc) side by side."""
    return ledger.withColumn("rank_metric", F.rank().over(Window.orderBy(F.desc_nulls_last("mean_cv_metric")))).withColumn(
        "rank_logloss", F.rank().over(Window.orderBy(F.asc_nulls_last("mean_logloss"))))


def params_as_rows(ledger: DataFrame, params_col: str = "params") -> DataFrame:
    """A run's JSON parameters as ``(exp_name, param, value)`` rows."""
    m = F.from_json(F.col(params_col), "map<string,string>")
    return ledger.select("exp_name", F.explode(m).alias("param", "value"))


def top_importance(imp: DataFrame, run: str, k: int = 20) -> DataFrame:
    """The k most important features of one run (mean over folds)."""
    return imp.where(F.col("run") == run).groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(
        F.desc("importance"), "feature").limit(k)


def importance_side_by_side(imp: DataFrame, runs: Sequence[str], k: int = 20) -> DataFrame:
    """Mean importance per feature and run, pivoted by run (aligned by feature name), top-k
    features by the mean across runs."""
    per = imp.where(F.col("run").isin(list(runs))).groupBy("feature", "run").agg(F.avg("importance").alias("imp"))
    wide = per.groupBy("feature").pivot("run", list(runs)).agg(F.first("imp"))
    mean = sum((F.coalesce(F.col(f"`{r}`"), F.lit(0.0)) for r in runs), F.lit(0.0)) / len(runs)
    return wide.withColumn("mean", mean).orderBy(F.desc("mean"), "feature").limit(k)


def prob_summary(long: DataFrame) -> DataFrame:
    """Mean maximum probability per run (with ``per_class_hist`` for the histograms)."""
    return long.groupBy("run", "row_id").agg(F.max("p").alias("m")).groupBy("run").agg(F.avg("m").alias("mean_max_prob"))


def check_recorded(recomputed: DataFrame, ledger: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Recomputed OOF log-loss vs the ledger's, flagged when they differ by more than ``tol``."""
    j = recomputed.join(ledger.select(F.col("exp_name").alias("run"), F.col("mean_logloss").alias("recorded")), "run", "left")
    return j.withColumn("ok", F.abs(F.col("logloss") - F.col("recorded")) <= tol)


# --------------------------------------------------------------------------- B7 / M16
def run_batch(configs: dict[str, Callable[[], None]], exists: Callable[[str], bool]) -> list[tuple]:
    """B7 / M16 orchestration: run each named job unless it already exists; a failure is
    recorded and does not stop the batch.  Returns S17 status rows."""
    rows = []
    for name, job in configs.items():
        t0 = time.time()
        if exists(name):
            rows.append((name, "skipped", None, 0.0))
            continue
        try:
            job()
            rows.append((name, "ok", None, time.time() - t0))
        except Exception as e:  # noqa: BLE001 - isolate failures per run
            rows.append((name, "failed", f"{type(e).__name__}: {e}"[:500], time.time() - t0))
    return rows
