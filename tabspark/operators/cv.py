"""K-fold modelling M1-M11, M17-M18.

The fold is a column, so "fit on k-1 folds, predict the held-out fold" is a filter on
the same (persisted) table; held-out predictions are unioned into one OOF table keyed
by ``row_id``; fold metrics are one ``groupBy(fold)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.functions.exprs import fold_order_key
from tabspark.operators.ranking import count_before


def stratified_folds(df: DataFrame, y: str, k: int = 5, seed: int = 1337, row_id: str = "row_id",
                     fold_col: str = "fold") -> DataFrame:
    """M1: stratified, shuffled K folds as a column.

    Inside every class rows are ordered by a seeded key of ``row_id`` (ties by ``row_id``) and
    dealt round-robin, so each fold holds each class within one row.  The position inside a
    class comes from the range-partitioned ``count_before``: a class holding a third of
    the table is still spread over all tasks (no per-class window).
    """
    if k < 2:
        raise ValueError("n_folds must be >= 2")
    keyed = df.withColumn("__ok", fold_order_key(row_id, seed))
    pos = count_before(keyed, [y], ["__ok", row_id])
    return pos.withColumn(fold_col, (F.col("__before") % k).cast("int")).drop("__ok", "__before")


def folds_sql(source_sql: str, y: str = "y", k: int = 5, seed: int = 1337, row_id: str = "row_id") -> str:
    """The same fold assignment in SQL (for the oracle)."""
    key = f"((({row_id} % 2147483647 + 2147483647) % 2147483647) * 48271 + {seed}) % 2147483647"
    return (
        f"SELECT *, CAST((row_number() OVER (PARTITION BY {y} ORDER BY {key}, {row_id}) - 1) % {k} AS INTEGER) AS fold "
        f"FROM ({source_sql})"
    )


# --------------------------------------------------------------------------- M2-M8, M10
from concurrent.futures import ThreadPoolExecutor  # noqa: E402
from dataclasses import dataclass, field  # noqa: E402

from pyspark import StorageLevel, inheritable_thread_target  # noqa: E402
from pyspark.ml.classification import (  # noqa: E402
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402

from tabspark.operators.joins import join_fitted  # noqa: E402
from tabspark.session import cached, cut_by_key  # noqa: E402

ROWS_PER_FIT_TASK = 250_000
VALUES_PER_FIT_TASK = 4_000_000
FIT_ROWS = 40_000_000

# Parameters each learner slot accepts (anything else is an error, never silently dropped).
LEARNER_PARAMS = {
    "gbt_ovr": {"maxIter", "maxDepth", "stepSize", "subsamplingRate", "featureSubsetStrategy", "minInstancesPerNode",
                "minInfoGain", "maxBins", "seed", "validationTol"},
    "random_forest": {"numTrees", "maxDepth", "subsamplingRate", "featureSubsetStrategy", "minInstancesPerNode",
                      "minInfoGain", "maxBins", "seed", "bootstrap"},
    "decision_tree": {"maxDepth", "minInstancesPerNode", "minInfoGain", "maxBins", "seed"},
    "logreg": {"regParam", "elasticNetParam", "maxIter", "tol", "standardization", "fitIntercept"},
}


def make_learner(kind: str, params: dict | None = None):
    """Pluggable estimator slot (M4-M6, M12-M13); unknown parameters raise."""
    params = dict(params or {})
    if kind not in LEARNER_PARAMS:
        raise ValueError(f"unknown learner {kind!r}; choose from {sorted(LEARNER_PARAMS)}")
    bad = set(params) - LEARNER_PARAMS[kind]
    if bad:
        raise ValueError(f"{kind}: unknown parameters {sorted(bad)}")
    if kind == "gbt_ovr":
        return GBTClassifier(**params)
    if kind == "random_forest":
        return RandomForestClassifier(**params)
    if kind == "decision_tree":
        return DecisionTreeClassifier(**params)
    return LogisticRegression(family="multinomial", **params)


@dataclass
class CVResult:
    run: str
    oof: DataFrame  # run, row_id, fold, class, p
    test: DataFrame  # run, row_id, class, p  (mean of the fold models)
    importances: list[tuple[int, str, float]] = field(default_factory=list)  # fold, feature, importance
    models: dict = field(default_factory=dict)  # fold -> fitted model
    kind: str = "random_forest"
    n_classes: int = 0


def predict_probs(model, kind: str, df: DataFrame, n_classes: int) -> DataFrame:
    """Probability array column ``probs`` for any slot; one-vs-rest scores are renormalised."""
    if kind == "gbt_ovr":
        out = df
        for c, sub in enumerate(model.models):
            sub = sub.copy()
            sub.setProbabilityCol(f"__pr{c}").setRawPredictionCol(f"__raw{c}").setPredictionCol(f"__pred{c}")
            out = sub.transform(out).withColumn(f"__p{c}", vector_to_array(f"__pr{c}")[1]).drop(f"__pr{c}", f"__raw{c}", f"__pred{c}")
        each = [F.col(f"__p{c}") for c in range(n_classes)]
        total = sum(each, F.lit(0.0))
        return out.withColumn("probs", F.array(*[x / total for x in each])).drop(*[f"__p{c}" for c in range(n_classes)])
    return model.transform(df).withColumn("probs", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")


@dataclass
class FoldFrames:
    """The rows of a cross-validation as learners read them: made once, for all runs over the same rows and features.

    ``train`` has ``row_id``, ``label``, ``fold`` and ``features``, or the columns of every fold's own model (``own``, features by
    fold): a row then holds one vector at a time, not one a fold."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    folds: list[int]
    n_train: int
    n_test: int
    n_classes: int
    tasks: int
    categorical: dict[str, int] | None
    own: bool

    def vectors(self, df: DataFrame, f: int) -> DataFrame:
        """``df`` with the vector that fold ``f``'s model reads."""
        return _assembled(df, [c.replace("{fold}", str(f)) for c in self.features], self.features, self.categorical) if self.own else df

    def fold_rows(self, f: int) -> DataFrame:
        """All training rows for fold ``f``'s model."""
        return self.vectors(self.train, f).select("row_id", "label", "fold", "features", f"__is_valid{f}") if self.own else self.train

    def release(self) -> None:
        if not self.own:
            self.train.unpersist()


def _assembled(df: DataFrame, columns: list[str], features: list[str], categorical: dict[str, int] | None) -> DataFrame:
    out = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)
    return _mark_nominal(out, features, categorical) if categorical else out


def fold_frames(train: DataFrame, test: DataFrame, features: list[str], label: str = "label", n_classes: int | None = None,
                fold_col: str = "fold", categorical: dict[str, int] | None = None) -> FoldFrames:
    """What ``fit_oof`` fits and scores; see there.  Ends with ``release``, or the innermost ``temporary`` block."""
    folds = sorted(r[fold_col] for r in train.select(fold_col).distinct().collect())
    own = any("{fold}" in c for c in features)
    n_tr, n_te = train.count(), test.count()
    # a fit is many short passes; its blocks go through an executor's memory whole when another executor reads them
    rows_a_task = max(1, min(ROWS_PER_FIT_TASK, VALUES_PER_FIT_TASK // max(1, len(features))))
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, -(-n_tr // rows_a_task))
    columns = list(dict.fromkeys(c.replace("{fold}", str(f)) for f in folds for c in features)) if own else ["features"]
    tr_src, te_src = (train, test) if own else (_assembled(d, features, features, categorical) for d in (train, test))
    all_tr = tr_src.select("row_id", F.col(label).cast("double").alias("label"), F.col(fold_col).alias("fold"), *columns)
    all_te = te_src.select("row_id", *columns)
    valid = {f"__is_valid{f}": F.col("fold") == f for f in folds}
    if own:
        all_tr = cut_by_key(all_tr, "row_id", n_tr).withColumns(valid)
    else:
        all_tr = cached(all_tr.withColumns(valid).coalesce(tasks))
        all_tr.count()  # several fits would each make the same blocks
    if n_classes is None:
        n_classes = int(all_tr.agg(F.max("label")).first()[0]) + 1
    return FoldFrames(all_tr, all_te, features, folds, n_tr, n_te, n_classes, tasks, categorical, own)


def fit_models(frames: FoldFrames, kind: str, params: dict | None = None, weights: DataFrame | None = None, early_stopping: bool = True, parallel: int = 5) -> dict:
    """A model a fold, fitted on the rows outside it."""
    # the learners keep each fit's rows: as many fits run at a time as hold so many rows together
    fits = max(1, FIT_ROWS // max(1, frames.n_train))
    parallel = max(1, min(parallel, fits, len(frames.folds)))
    classes_at_once = max(1, min(fits // parallel, frames.n_classes or 1))

    def fit_fold(f: int):
        rows = frames.fold_rows(f)
        if frames.own:
            rows = rows.coalesce(frames.tasks).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return fit(rows, f)
        finally:
            if frames.own:
                rows.unpersist()

    def fit(fit_df: DataFrame, f: int):
        if weights is not None:
            wf = weights.where(F.col("fold") == f).select(F.col("y").cast("double").alias("label"), "weight")
            fit_df = join_fitted(fit_df, wf, "label", frames.n_classes, "left").fillna(1.0, subset=["weight"])
        est = make_learner(kind, params)
        if weights is not None:
            est.setWeightCol("weight")
        if kind != "gbt_ovr":
            return est.fit(fit_df.where(F.col("fold") != f))
        if early_stopping:
            est.setValidationIndicatorCol(f"__is_valid{f}")  # a column of the cached rows, so OneVsRest makes no copy of these
        else:
            fit_df = fit_df.where(F.col("fold") != f)
        ovr = OneVsRest(classifier=est, parallelism=classes_at_once)
        if weights is not None:
            ovr.setWeightCol("weight")
        return ovr.fit(fit_df)

    # the folds' fits are jobs of their own: a few run at a time, each with the caller's job properties
    carried = inheritable_thread_target(frames.train.sparkSession)
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        running = {f: pool.submit(carried(lambda f=f: fit_fold(f))) for f in frames.folds}
        return {f: r.result() for f, r in running.items()}


def score_runs(frames: FoldFrames, runs: dict[str, tuple[str, dict]]) -> dict[str, CVResult]:
    """OOF and test probabilities of each run, ``{name: (kind, models)}``: all runs from one pass over the rows, written once."""
    n_classes, folds = frames.n_classes, frames.folds
    imps = {run: [] for run in runs}
    for run, (kind, models) in runs.items():
        for f, model in models.items():
            parts = model.models if kind == "gbt_ovr" else [model] if hasattr(model, "featureImportances") else []
            imps[run] += [(f, frames.features[i], float(v) / len(parts)) for part in parts for i, v in enumerate(part.featureImportances.toArray())]
    oof, scored = None, frames.test
    for f in folds:
        held = frames.fold_rows(f).where(F.col("fold") == f)
        # the models are chained on the rows, so their mean on the test rows is a projection
        scored = frames.vectors(scored, f)
        for i, (kind, models) in enumerate(runs.values()):
            held = predict_probs(models[f], kind, held, n_classes).withColumnRenamed("probs", f"__probs{i}")
            scored = predict_probs(models[f], kind, scored, n_classes).withColumnRenamed("probs", f"__mean{i}_{f}")
        held = held.select("row_id", "fold", *(f"__probs{i}" for i in range(len(runs))))
        oof = held if oof is None else oof.unionByName(held)
        scored = scored.drop("features") if frames.own else scored

    def means(i: int, kind: str, models: dict):
        sizes = {f: n_classes if kind == "gbt_ovr" else m.numClasses for f, m in models.items()}
        each = [[F.get(F.col(f"__mean{i}_{f}"), F.lit(c)) for f in folds if sizes[f] > c] for c in range(max(sizes.values(), default=0))]
        return F.array(*(sum(found, F.lit(0.0)) / F.lit(len(found)) for found in each)).alias(f"__probs{i}")

    tst = scored.select("row_id", *(means(i, *run) for i, run in enumerate(runs.values())))
    # the OOF and test probability sets are the runs' artifacts: write them once (a row holds all classes)
    oof, tst = cut_by_key(oof, "row_id", frames.n_train), cut_by_key(tst, "row_id", frames.n_test)
    return {
        run: CVResult(run, oof.select("row_id", "fold", F.posexplode(f"__probs{i}").alias("class", "p"), F.lit(run).alias("run")),
                      tst.select("row_id", F.posexplode(f"__probs{i}").alias("class", "p"), F.lit(run).alias("run")), imps[run], models, kind, n_classes)
        for i, (run, (kind, models)) in enumerate(runs.items())
    }


def fit_oof(
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    label: str = "label",
    kind: str = "random_forest",
    params: dict | None = None,
    n_classes: int | None = None,
    weights: DataFrame | None = None,
    fold_col: str = "fold",
    run: str = "run",
    early_stopping: bool = True,
    categorical: dict[str, int] | None = None,
    parallel: int = 5,
) -> CVResult:
    """M2/M3: K-fold out-of-fold training with any learner slot.

    ``train`` carries ``row_id``, the integer ``label``, ``fold`` and the feature columns;
    fold f's model is fitted on ``fold != f`` and scores fold f (OOF) and every test row;
    the test prediction is the mean of the K fold models.  At most ``parallel`` folds are fitted at a time, fewer on large
    tables.  ``weights`` is the
    ``(fold, y, weight)`` table of E12.  For the one-vs-rest GBT slot the held-out fold
    is passed as the validation set (early stopping), as the original did.
    ``categorical`` maps integer-coded feature columns to their number of codes; those
    slots are marked as nominal in the vector metadata, so tree learners split them as
    categories (native categorical handling) instead of as ordered numbers.
    A feature name with ``{fold}`` in it stands for a column of each fold's own model (the ordered target statistics of
    M6, which must not see the fold that the model is judged on).
    """
    frames = fold_frames(train, test, features, label, n_classes, fold_col, categorical)
    models = fit_models(frames, kind, params, weights, early_stopping, parallel)
    res = score_runs(frames, {run: (kind, models)})[run]
    frames.release()
    return res


def permutation_importance(result: CVResult, frame: DataFrame, features: list[str], fold: int,
                           label: str = "label", seed: int = 7) -> DataFrame:
    """M9 (re-aimed from per-row TreeSHAP): increase in log-loss of fold ``fold``'s model on its
    held-out rows when one feature column is permuted across those rows.

    The permutation is a join on positions: each row's position in ``row_id`` order is matched
    with the position of another row in a seeded pseudo-random order (both from the
    range-partitioned ``count_before``), so no row set passes through one task.
    """
    from tabspark.operators.blend import EPS

    model = result.models[fold]
    valid = frame.where(F.col("fold") == fold).select("row_id", F.col(label).cast("int").alias("y"), *features)
    pos = count_before(valid, [], ["row_id"]).withColumnRenamed("__before", "__i")
    shuf = count_before(valid.select("row_id", fold_order_key("row_id", seed).alias("__k"), *features), [], ["__k", "row_id"])
    shuf = shuf.withColumnRenamed("__before", "__i")
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")

    def loss(df):
        scored = predict_probs(model, result.kind, asm.transform(df), result.n_classes)
        p = F.col("probs")[F.col("y")]
        return scored.agg(F.avg(-F.log(F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))))).first()[0]

    base = loss(valid)
    rows = []
    for c in features:
        permuted = pos.drop(c).join(shuf.select("__i", c), "__i").drop("__i")
        rows.append((result.run, fold, c, base, loss(permuted) - base))
    return frame.sparkSession.createDataFrame(
        rows, "run string, fold int, feature string, base_logloss double, importance double")


def _mark_nominal(df: DataFrame, features: list[str], categorical: dict[str, int], vector: str = "features") -> DataFrame:
    """Attach ML attribute metadata declaring the given slots nominal with ``n`` values."""
    attrs = []
    for i, f in enumerate(features):
        if f in categorical:
            attrs.append({"idx": i, "name": f, "type": "nominal", "num_vals": int(categorical[f])})
        else:
            attrs.append({"idx": i, "name": f, "type": "numeric"})
    nominal = [{"idx": a["idx"], "name": a["name"], "vals": [str(v) for v in range(a["num_vals"])]}
               for a in attrs if a["type"] == "nominal"]
    numeric = [{"idx": a["idx"], "name": a["name"]} for a in attrs if a["type"] == "numeric"]
    meta = {"ml_attr": {"attrs": {"numeric": numeric, "nominal": nominal}, "num_attrs": len(features)}}
    return df.withColumn(vector, F.col(vector).alias(vector, metadata=meta))


def importance_table(spark, result: CVResult) -> DataFrame:
    """M8: ``(run, fold, feature, importance)``."""
    return spark.createDataFrame([(result.run, f, n, v) for f, n, v in result.importances],
                                 "run string, fold int, feature string, importance double")


def importance_stability(imp: DataFrame, top_k: int = 5) -> DataFrame:
    """Mean, sample std and coefficient of variation of each feature's importance over
    folds (folds only), with the share of total mean importance held by the top-k features."""
    s = imp.groupBy("run", "feature").agg(F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("std"))
    s = s.withColumn("cv", F.try_divide(F.col("std"), F.col("mean")))
    w = Window.partitionBy("run").orderBy(F.desc("mean"), "feature")
    s = s.withColumn("rank", F.row_number().over(w))
    tot = Window.partitionBy("run")
    top = F.sum(F.when(F.col("rank") <= top_k, F.col("mean")).otherwise(0.0)).over(tot) / F.sum("mean").over(tot)
    return s.withColumn(f"top{top_k}_share", top)


def sweep(train: DataFrame, test: DataFrame, features: list[str], kind: str, themes: dict[str, dict], frames: FoldFrames | None = None,
          weights: DataFrame | None = None, early_stopping: bool = True, parallel: int = 5, **kw) -> dict[str, CVResult]:
    """Named parameter themes, each validated and run through the same OOF loop.  ``frames``: what ``fold_frames`` made of the
    same rows, where more sweeps read them; else they are made here."""
    for name, params in themes.items():
        bad = set(params) - LEARNER_PARAMS[kind]
        if bad:
            raise ValueError(f"theme {name!r}: unknown parameters {sorted(bad)}")
    own = frames or fold_frames(train, test, features, **kw)
    out = score_runs(own, {name: (kind, fit_models(own, kind, params, weights, early_stopping, parallel)) for name, params in themes.items()})
    if frames is None:
        own.release()
    return out
