"""Registered queries: K-fold model training, importances, stacking, binary metrics (M*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.operators import evaluate as EV
from tabspark.operators.attribution import shapley_values, shapley_wide
from tabspark.operators.cv import LEARNER_PARAMS, CVResult, fit_oof, folds_sql, importance_stability, importance_table, permutation_importance, stratified_folds
from tabspark.operators.encode import MEstimateEncoder, MissingEncoder, OrdinalEncoder, balanced_class_weights
from tabspark.operators.ordered import OrderedTargetEncoder
from tabspark.operators.stack import fit_meta_learner, meta_features
from tabspark.plans.common import rounded, sql_round
from tabspark.plans.fixtures import BINARY_SQL, TRAIN_LIKE_CATS, TRAIN_LIKE_NUMS, TRAIN_LIKE_SQL, binary, train_like
from tabspark.plans.probs import CLASSES, RUNS, prob_runs, prob_runs_sql
from tabspark.session import cut_by_key, cut_lineage, read_table

QUERIES: dict = {}
SQL: dict = {}
R = sql_round


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


RF_PARAMS = {"numTrees": 20, "maxDepth": 6, "seed": 1337, "featureSubsetStrategy": "sqrt"}
GBT_PARAMS = {"maxIter": 10, "maxDepth": 3, "stepSize": 0.1, "seed": 1337}


def model_frames(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[str]]:
    """train_like -> imputed (E4) + ordinal-coded (E5) features, integer label, stratified folds (M1)."""
    df = train_like(spark, sf_dir, materialise=True)
    train, test = df.where(F.col("split") == "train"), df.where(F.col("split") == "test")
    miss = MissingEncoder(TRAIN_LIKE_CATS, TRAIN_LIKE_NUMS).fit_pair(train, test)
    train, test = miss.transform(train), miss.transform(test)
    enc = OrdinalEncoder(TRAIN_LIKE_CATS).fit(train)
    train, test = enc.transform(train), enc.transform(test)
    flags = [c for c in train.columns if c.endswith("_has_missing")]
    code = (F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("y")) - 1).cast("int")
    train = train.withColumn("label", code).select("row_id", "y", "label", *TRAIN_LIKE_NUMS, *TRAIN_LIKE_CATS,
                                                   *[F.col(f).cast("int").alias(f) for f in flags])
    test = test.select("row_id", *TRAIN_LIKE_NUMS, *TRAIN_LIKE_CATS, *[F.col(f).cast("int").alias(f) for f in flags])
    folded = cut_by_key(stratified_folds(train, "label", k=5, seed=1337), "row_id", train.count())  # in as many buckets as a run's probabilities
    return folded, test, TRAIN_LIKE_NUMS + TRAIN_LIKE_CATS + flags


def audited(res: CVResult, folded: DataFrame) -> DataFrame:
    """What must hold of a run's probabilities, counted over all of them.  Per split, fold (-1: the test set) and class: rows,
    distinct ids, probabilities within [0, 1], rows whose classes sum to 1, and rows that were scored in the fold they were dealt to."""
    dealt = folded.select("row_id", F.col("fold").alias("dealt"))
    classes = range(res.n_classes)

    def per_fold(df: DataFrame, split: str) -> DataFrame:
        """One row a fold: a column's values by class are arrays.  The rows' own sums stay in the buckets of their row."""
        of = lambda c, x: F.sum(F.when(F.col("class") == c, x))
        row = df.groupBy("run", "row_id", "fold").agg(
            (F.abs(F.sum("p") - 1) < 1e-9).cast("long").alias("unit"), (F.max("dealt") == F.col("fold")).cast("long").alias("own"),
            *(of(c, F.lit(1)).alias(f"n{c}") for c in classes), *(of(c, F.col("p").between(0, 1).cast("long")).alias(f"in{c}") for c in classes))
        sums = {"n_rows": lambda c: F.col(f"n{c}"), "n_ids": lambda c: (F.col(f"n{c}").isNotNull() & F.col("row_id").isNotNull()).cast("long"),
                "n_inside": lambda c: F.col(f"in{c}"), "n_unit": lambda c: F.col("unit") * F.col(f"n{c}"), "n_own": lambda c: F.col("own") * F.col(f"n{c}")}
        each = [F.struct(F.lit(c).alias("class"), *(F.sum(x(c)).alias(name) for name, x in sums.items())) for c in classes]
        out = row.groupBy("run", "fold").agg(F.array(*each).alias("classes"))
        return out.select("run", F.lit(split).alias("split"), "fold", F.explode("classes").alias("c")).select("run", "split", "fold", "c.*").where("n_rows > 0")

    test = res.test.withColumns({"fold": F.lit(-1), "dealt": F.lit(-1)})
    return per_fold(res.oof.join(dealt, "row_id", "left"), "oof").unionByName(per_fold(test, "test"))


def audit_sql(*runs: str, seed: int = 1337) -> str:
    """The same from the data alone."""
    names = ", ".join(f"('{r}')" for r in runs)
    return f"""
WITH t AS ({TRAIN_LIKE_SQL}), f AS ({folds_sql("SELECT * FROM t WHERE split = 'train'", seed=seed)}),
c AS (SELECT CAST(range AS INTEGER) AS class FROM range({len(CLASSES)})), r(run) AS (VALUES {names}),
n AS (SELECT 'oof' AS split, fold, COUNT(*) AS n FROM f GROUP BY fold UNION ALL SELECT 'test', -1, COUNT(*) FROM t WHERE split = 'test')
SELECT run, split, fold, class, n AS n_rows, n AS n_ids, n AS n_inside, n AS n_unit, n AS n_own FROM n, c, r WHERE n > 0"""


@register("cv_oof_random_forest", audit_sql("rf"))
def cv_oof_random_forest(spark, sf_dir):
    """5-fold random forest with balanced class weights; OOF probabilities of
    every train row and the mean of the fold models on every test row."""
    folded, test, feats = model_frames(spark, sf_dir)
    w = balanced_class_weights(folded, "label", "fold")
    res = fit_oof(folded, test, feats, "label", "random_forest", RF_PARAMS, n_classes=len(CLASSES), weights=w, run="rf")
    return audited(res, folded)


@register("cv_oof_gbt_ovr", audit_sql("gbt"))
def cv_oof_gbt_ovr(spark, sf_dir):
    """M4: one-vs-rest gradient-boosted trees per fold with the held-out fold as the early-stopping
    validation set; class scores renormalised (T8)."""
    folded, test, feats = model_frames(spark, sf_dir)
    res = fit_oof(folded, test, feats, "label", "gbt_ovr", GBT_PARAMS, n_classes=len(CLASSES), run="gbt")
    return audited(res, folded)


@register("cv_oof_decision_tree", audit_sql("dt"))
def cv_oof_decision_tree(spark, sf_dir):
    """M6 slot: a third learner (decision tree) through the same OOF loop, with the ordinal-coded
    categoricals declared nominal so they are split as categories (native categorical handling)."""
    folded, test, feats = model_frames(spark, sf_dir)
    top = folded.agg(*[F.max(c).alias(c) for c in TRAIN_LIKE_CATS]).first()  # one row: code ranges
    cards = {c: int(top[c]) + 1 for c in TRAIN_LIKE_CATS}
    res = fit_oof(folded, test, feats, "label", "decision_tree", {"maxDepth": 5, "seed": 1337}, n_classes=len(CLASSES),
                  run="dt", categorical=cards)
    return audited(res, folded)


_ORDER = "(((row_id % 2147483647 + 2147483647) % 2147483647) * 48271 + 1337) % 2147483647"


@register("enc_ordered_target", f"""
WITH t AS (SELECT row_id, y, CAST(o_custkey_nation AS VARCHAR) AS cat FROM (
  SELECT o.o_orderkey AS row_id, o.o_orderstatus AS y, c.c_nationkey AS o_custkey_nation, o.o_orderdate FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)
  WHERE o_orderdate < TIMESTAMP '2000-01-01'),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY {_ORDER}, row_id) - 1) % 5 AS INTEGER) AS fold FROM t),
classes AS (SELECT DISTINCT y AS k FROM t),
folds AS (SELECT DISTINCT fold FROM f),
prior AS (SELECT folds.fold, k, AVG(CASE WHEN f.y = k THEN 1.0 ELSE 0.0 END) AS p FROM folds JOIN f ON f.fold <> folds.fold CROSS JOIN classes GROUP BY folds.fold, k),
w AS (SELECT f.row_id, f.fold, f.cat, k, m.fold AS model,
             SUM(CASE WHEN f.fold <> m.fold THEN 1 ELSE 0 END) OVER b AS bn, SUM(CASE WHEN f.fold <> m.fold AND f.y = k THEN 1 ELSE 0 END) OVER b AS bs,
             SUM(CASE WHEN f.fold <> m.fold THEN 1 ELSE 0 END) OVER a AS hn, SUM(CASE WHEN f.fold <> m.fold AND f.y = k THEN 1 ELSE 0 END) OVER a AS hs
      FROM f CROSS JOIN classes CROSS JOIN folds m
      WINDOW a AS (PARTITION BY cat, k, m.fold), b AS (PARTITION BY cat, k, m.fold ORDER BY {_ORDER.replace("row_id", "f.row_id")}, f.row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT row_id, w.fold, w.model, w.k AS class,
       {R("CASE WHEN w.fold = model THEN (hs + p) / (hn + 1.0) ELSE (COALESCE(bs, 0) + p) / (COALESCE(bn, 0) + 1.0) END")} AS statistic
FROM w JOIN prior ON prior.fold = w.model AND prior.k = w.k""")
def enc_ordered_target(spark, sf_dir):
    """M6: ordered target statistics of the customer's nation, for every training row, fold's model and class."""
    orders = read_table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp"))
    customer = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    rows = orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("y"), "o_custkey").join(customer, "o_custkey", "left")
    folded = stratified_folds(rows, "y", k=5, seed=1337)
    classes = sorted(r["y"] for r in rows.select("y").distinct().collect())
    model = OrderedTargetEncoder(["nation"], "y", classes).fit(folded)
    each = [F.struct(F.lit(f).alias("model"), F.lit(c).alias("class"), F.col(model.feature("nation", k, f)).alias("statistic")) for f in model.folds for k, c in enumerate(classes)]
    out = model.transform_train(folded).select("row_id", "fold", F.explode(F.array(*each)).alias("s"))
    return rounded(out.select("row_id", "fold", "s.model", "s.class", "s.statistic"))


@register("cv_oof_ordered_gbt", audit_sql("ordered_gbt"))
def cv_oof_ordered_gbt(spark, sf_dir):
    """M6: the boosted slot over ordered target statistics of the categories (with the held-out fold's labels left out of each
    fold's statistics) and the numbers as they are."""
    folded, test, feats = model_frames(spark, sf_dir)
    model = OrderedTargetEncoder(TRAIN_LIKE_CATS, "label", list(range(len(CLASSES)))).fit(folded)
    nums = [c for c in feats if c not in TRAIN_LIKE_CATS]
    res = fit_oof(model.transform_train(folded), model.transform(test), nums + model.features(), "label", "gbt_ovr", GBT_PARAMS, n_classes=len(CLASSES), run="ordered_gbt")
    return audited(res, folded)


@register("stack_gbt", audit_sql("stack_gbt", seed=42))
def stack_gbt(spark, sf_dir):
    """Boosted stacker (one-vs-rest GBT) over the three runs' OOF probabilities, nested 5-fold CV."""
    oof, tst, labels = prob_runs(spark, sf_dir)
    runs = list(RUNS)
    mtr, names = meta_features(oof, runs, len(CLASSES))
    mte, _ = meta_features(tst, runs, len(CLASSES))
    mtr = mtr.join(labels.where(F.col("split") == "train").select("row_id", F.col("y").alias("label")), "row_id")
    res = fit_meta_learner(mtr, mte, names, "gbt_ovr", 5, 42, balanced=False, run="stack_gbt",
                           params={"maxIter": 5, "maxDepth": 3, "seed": 42})
    return audited(res, stratified_folds(mtr, "label", k=5, seed=42))


@register("cv_importance", f"""
WITH t AS ({TRAIN_LIKE_SQL}), f AS ({folds_sql("SELECT * FROM t WHERE split = 'train'")}),
cols AS (UNPIVOT (SELECT {", ".join(f"COUNT(*) - COUNT({c}) AS {c}" for c in TRAIN_LIKE_NUMS)} FROM t) ON * INTO NAME col VALUE missing)
SELECT 'rf' AS run, fold, CAST((SELECT {len(TRAIN_LIKE_NUMS) + len(TRAIN_LIKE_CATS)} + COUNT(*) FROM cols WHERE missing > 0) AS BIGINT) AS n_features, 0 AS n_negative, 1.0 AS total
FROM f GROUP BY fold""")
def cv_importance(spark, sf_dir):
    """M8: gain importances of every fold's random forest: a value a feature (missing flags included), none negative, summing to 1."""
    folded, test, feats = model_frames(spark, sf_dir)
    res = fit_oof(folded, test, feats, "label", "random_forest", RF_PARAMS, n_classes=len(CLASSES), run="rf")
    table = importance_table(spark, res)
    return rounded(table.groupBy("run", "fold").agg(
        F.count_distinct("feature").alias("n_features"), F.sum((F.col("importance") < 0).cast("int")).cast("int").alias("n_negative"), F.sum("importance").alias("total")))


# Importances that SQL can compute too: per fold, over the rows outside it, the absolute correlation of each number with the class
# code, and with the indicator of the first class.
_IMPORTANCE_RUNS = {"class_code": "label", "first_class": "first"}


def data_importances(spark, sf_dir) -> DataFrame:
    train = train_like(spark, sf_dir).where(F.col("split") == "train")
    code = (F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("y")) - 1).cast("double")
    folded = stratified_folds(train, "y", k=5, seed=1337).withColumns({"label": code, "first": (F.col("y") == CLASSES[0]).cast("double")})
    keys = [(run, f, c) for run in _IMPORTANCE_RUNS for f in range(5) for c in TRAIN_LIKE_NUMS]
    one = folded.agg(*(F.abs(F.corr(F.when(F.col("fold") != f, F.col(c).cast("double")), F.col(_IMPORTANCE_RUNS[run]))).alias(f"i{k}") for k, (run, f, c) in enumerate(keys)))
    rows = F.array(*(F.struct(F.lit(run).alias("run"), F.lit(f).alias("fold"), F.lit(c).alias("feature"), F.col(f"i{k}").alias("importance")) for k, (run, f, c) in enumerate(keys)))
    return one.select(F.explode(rows).alias("s")).select("s.*")


_IMPORTANCE_SQL = f"""t AS ({TRAIN_LIKE_SQL}), f AS ({folds_sql("SELECT * FROM t WHERE split = 'train'")}),
coded AS (SELECT *, CASE y {" ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSES))} END AS label, CASE WHEN y = '{CLASSES[0]}' THEN 1 ELSE 0 END AS first FROM f),
folds AS (SELECT DISTINCT fold FROM f),
imp AS ({" UNION ALL ".join(f"SELECT '{run}' AS run, m.fold, '{c}' AS feature, abs(corr({c}, {y})) AS importance FROM folds m JOIN coded x ON x.fold <> m.fold GROUP BY m.fold" for run, y in _IMPORTANCE_RUNS.items() for c in TRAIN_LIKE_NUMS)})"""


@register("cv_importance_stability", f"""
WITH {_IMPORTANCE_SQL},
s AS (SELECT run, feature, AVG(importance) AS mean, stddev_samp(importance) AS std FROM imp GROUP BY run, feature),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY mean DESC, feature) AS INTEGER) AS rank FROM s)
SELECT run, feature, {R("mean")} AS mean, {R("std")} AS std, {R("std / mean")} AS cv, rank,
       {R("SUM(CASE WHEN rank <= 5 THEN mean ELSE 0 END) OVER (PARTITION BY run) / SUM(mean) OVER (PARTITION BY run)")} AS top5_share FROM r""")
def cv_importance_stability(spark, sf_dir):
    """Stability of importances over the folds: mean, deviation, their ratio, rank and the share of the top five."""
    return rounded(importance_stability(data_importances(spark, sf_dir), 5))


@register("cv_permutation_importance")
def cv_permutation_importance(spark, sf_dir):
    """M9: permutation importance (log-loss increase) of fold 0's random forest on its held-out rows."""
    folded, test, feats = model_frames(spark, sf_dir)
    res = fit_oof(folded, test, feats, "label", "random_forest", RF_PARAMS, n_classes=len(CLASSES), run="rf")
    return rounded(permutation_importance(res, folded, feats, 0, "label"))


_SHAPLEY_SAMPLE, _SHAPLEY_FEATURES = 40, ["o_totalprice", "sum_qty", "avg_disc", "n_items", "c_acctbal", "alpha", "delta"]


@register("cv_shapley", f"""
WITH t AS ({TRAIN_LIKE_SQL}), f AS ({folds_sql("SELECT * FROM t WHERE split = 'train'")}),
n AS (SELECT fold, LEAST({_SHAPLEY_SAMPLE}, COUNT(*)) AS n FROM f GROUP BY fold), c AS (SELECT CAST(range AS INTEGER) AS class FROM range({len(CLASSES)}))
SELECT 'dt' AS run, fold, class, n AS n_rows, n * {len(_SHAPLEY_FEATURES)} AS n_contributions, n AS n_additive, n AS n_all_classes_cancel FROM n, c""")
def cv_shapley(spark, sf_dir):
    """M9: Shapley values of held-out rows of every fold, per class.  Rows whose contributions add up to the prediction less the
    base, and (as probabilities sum to 1) whose contributions over all classes cancel."""
    folded, test, _ = model_frames(spark, sf_dir)
    res = fit_oof(folded, test, _SHAPLEY_FEATURES, "label", "decision_tree", {"maxDepth": 4, "seed": 1337}, n_classes=len(CLASSES), run="dt")
    values = cut_lineage(shapley_values(res, folded, _SHAPLEY_FEATURES, _SHAPLEY_SAMPLE, background=10, draws=8))
    wide = shapley_wide(values, _SHAPLEY_FEATURES)
    total = sum((F.col(c) for c in _SHAPLEY_FEATURES), F.lit(0.0))
    rows = wide.select("run", "fold", "row_id", "class", total.alias("total"), (F.col("prediction") - F.col("base")).alias("apart"))
    rows = rows.join(rows.groupBy("run", "fold", "row_id").agg(F.sum("total").alias("over_classes")), ["run", "fold", "row_id"])
    checks = rows.groupBy("run", "fold", "class").agg(
        F.count("*").alias("n_rows"), F.sum((F.abs(F.col("total") - F.col("apart")) < 1e-9).cast("long")).alias("n_additive"),
        F.sum((F.abs("over_classes") < 1e-9).cast("long")).alias("n_all_classes_cancel"))
    per = values.groupBy("run", "fold", "class").agg(F.count("contribution").alias("n_contributions"))
    return checks.join(per, ["run", "fold", "class"])


@register("stack_logreg", audit_sql("stack_logreg", seed=42))
def stack_logreg(spark, sf_dir):
    """Multinomial logistic-regression stacker (C = 1, balanced weights) over the
    three runs' OOF probabilities, nested 5-fold CV with seed 42."""
    oof, tst, labels = prob_runs(spark, sf_dir)
    runs = list(RUNS)
    mtr, names = meta_features(oof, runs, len(CLASSES))
    mte, _ = meta_features(tst, runs, len(CLASSES))
    mtr = mtr.join(labels.where(F.col("split") == "train").select("row_id", F.col("y").alias("label")), "row_id")
    res = fit_meta_learner(mtr, mte, names, "logreg", 5, 42, 1.0, True, run="stack_logreg")
    return audited(res, stratified_folds(mtr, "label", k=5, seed=42))


@register("stack_meta_features", f"""
WITH {prob_runs_sql()},
p AS (SELECT * FROM oof UNION ALL SELECT * FROM tst)
SELECT row_id, {", ".join(f"{R(f"MAX(CASE WHEN run = '{r}' AND class = {c} THEN p END)")} AS {r}__p{c}" for r in RUNS for c in range(len(CLASSES)))} FROM p GROUP BY row_id""")
def stack_meta_features(spark, sf_dir):
    """One row a train or test row, one column a run and class."""
    oof, tst, _ = prob_runs(spark, sf_dir)
    return rounded(meta_features(oof.unionByName(tst), list(RUNS), len(CLASSES))[0])


@register("stack_metrics", f"""
WITH t AS ({TRAIN_LIKE_SQL}), f AS ({folds_sql("SELECT * FROM t WHERE split = 'train'", seed=42)})
SELECT 'stack_logreg' AS run, fold, COUNT(*) AS n_rows, COUNT(DISTINCT y) AS n_classes, TRUE AS recall_in_range, TRUE AS folds_make_up_total FROM f GROUP BY fold""")
def stack_metrics(spark, sf_dir):
    """Fold metrics of the stacker.  The folds' log-losses, weighted by their rows, make up the run's log-loss."""
    oof, tst, labels = prob_runs(spark, sf_dir)
    runs = list(RUNS)
    mtr, names = meta_features(oof, runs, len(CLASSES))
    mte, _ = meta_features(tst, runs, len(CLASSES))
    lab = labels.where(F.col("split") == "train").select("row_id", F.col("y").alias("label"))
    res = fit_meta_learner(mtr.join(lab, "row_id"), mte, names, "logreg", 5, 42, 1.0, True, run="stack_logreg")
    truth = lab.select("row_id", F.col("label").alias("y")).join(res.oof.select("row_id", "fold").distinct(), "row_id")
    per_fold, summary = EV.fold_metrics(res.oof, truth)
    sizes = truth.groupBy("fold").agg(F.count("*").alias("n_rows"), F.count_distinct("y").alias("n_classes"))
    whole, mean = EV.log_loss(res.oof, truth).first()["logloss"], summary.first()["mean_logloss"]
    rows = per_fold.join(sizes, "fold")
    totals = rows.agg((F.sum(F.col("logloss") * F.col("n_rows")) / F.sum("n_rows")).alias("weighted"), F.avg("logloss").alias("mean")).first()
    adds_up = abs(totals["weighted"] - whole) < 1e-9 and abs(totals["mean"] - mean) < 1e-9
    return rows.select("run", "fold", "n_rows", "n_classes", F.col("bal_acc").between(0, 1).alias("recall_in_range"), F.lit(adds_up).alias("folds_make_up_total"))


# --------------------------------------------------------------------------- M18
@register("cv_binary_metrics", f"""
WITH bn AS ({BINARY_SQL}),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY quality ORDER BY (((row_id % 2147483647 + 2147483647) % 2147483647) * 48271 + 1337) % 2147483647, row_id) - 1) % 5 AS INTEGER) AS fold FROM bn),
cf AS (SELECT source AS key, fold, COUNT(*) AS n, SUM(CASE WHEN CAST(quality AS VARCHAR) = '1' THEN 1.0 ELSE 0.0 END) AS s FROM f GROUP BY 1, 2),
ca AS (SELECT key, SUM(n) AS n, SUM(s) AS s FROM cf GROUP BY key),
fo AS (SELECT DISTINCT fold FROM f),
oo AS (SELECT ca.key, fo.fold, ca.n - COALESCE(cf.n, 0) AS n, ca.s - COALESCE(cf.s, 0) AS s FROM ca CROSS JOIN fo LEFT JOIN cf ON cf.key = ca.key AND cf.fold = fo.fold),
pf AS (SELECT fo.fold, AVG(CASE WHEN CAST(x.quality AS VARCHAR) = '1' THEN 1.0 ELSE 0.0 END) AS p FROM fo JOIN f x ON x.fold <> fo.fold GROUP BY fo.fold),
sc AS (SELECT f.row_id, f.quality AS label, CASE WHEN o.n IS NULL OR o.n = 0 THEN pf.p ELSE (o.s + 5.0 * pf.p) / (o.n + 5.0) END AS score
       FROM f JOIN pf ON pf.fold = f.fold LEFT JOIN oo o ON o.key = f.source AND o.fold = f.fold),
g AS (SELECT score AS s, SUM(label) AS tp, SUM(1 - label) AS fp FROM sc GROUP BY score),
c AS (SELECT s, tp, fp, SUM(tp) OVER w - tp AS tp_above, SUM(fp) OVER w - fp AS fp_above FROM g
      WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tot AS (SELECT SUM(tp) AS P, SUM(fp) AS N FROM g)
SELECT {R('SUM(tp * ((tot.N - fp_above - fp) + fp / 2.0)) / (tot.P * tot.N)')} AS roc_auc,
       {R('SUM(CASE WHEN tp > 0 THEN (tp / tot.P) * (tp_above + tp) / (tp_above + tp + fp_above + fp) ELSE 0 END)')} AS average_precision,
       {R('(SELECT 2.0 * SUM(CASE WHEN score >= 0.5 THEN label ELSE 0 END) / (SUM(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) + SUM(label)) FROM sc)')} AS f1
FROM c, tot GROUP BY tot.P, tot.N""")
def cv_binary_metrics(spark, sf_dir):
    """ROC-AUC, average precision and F1 at 0.5 of an out-of-fold binary score (the
    cross-fitted m-estimate of P(quality = 1 | source)) on the labelled documents."""
    df = binary(spark, sf_dir).withColumn("q", F.col("quality").cast("string"))
    folded = stratified_folds(df, "quality", k=5, seed=1337)
    model = MEstimateEncoder("source", "q", ["0", "1"], "fold", m=5.0).fit(folded)
    scored = model.transform_oof(folded).select(F.col("quality").alias("label"), F.col(model.names[1]).alias("score"))
    return rounded(EV.binary_metrics(scored, "label", "score", 0.5))


# --------------------------------------------------------------------------- M10 / M16 / B26 / B28
_THEMES = {
    "decision_tree": {"tree_shallow": {"maxDepth": 3, "seed": 1337}, "tree_deep": {"maxDepth": 6, "seed": 1337}},
    "random_forest": {"forest_small": {"numTrees": 5, "maxDepth": 4, "seed": 1337}, "forest_large": {"numTrees": 15, "maxDepth": 5, "seed": 1337}},
    "gbt_ovr": {"boosted": {"maxIter": 3, "maxDepth": 2, "stepSize": 0.3, "seed": 1337}},
    "logreg": {"linear": {"regParam": 0.01, "maxIter": 20}},
}


@register("cv_sweep_themes", audit_sql(*(t for themes in _THEMES.values() for t in themes)))
def cv_sweep_themes(spark, sf_dir):
    """Named parameter themes of every learner slot, each through the same OOF loop."""
    from tabspark.operators.cv import fold_frames, sweep

    assert set(_THEMES) == set(LEARNER_PARAMS)
    folded, test, feats = model_frames(spark, sf_dir)
    frames = fold_frames(folded, test, feats, "label", len(CLASSES))  # read by every learner's sweep
    out = None
    for kind, themes in _THEMES.items():
        for res in sweep(folded, test, feats, kind, themes, frames=frames).values():
            one = audited(res, folded)
            out = one if out is None else out.unionByName(one)
    frames.release()
    return out


_IMP_MEANS = "per AS (SELECT run, feature, AVG(importance) AS importance FROM imp GROUP BY run, feature)"


@register("cv_importance_side_by_side", f"""
WITH {_IMPORTANCE_SQL}, {_IMP_MEANS},
w AS (SELECT feature, {", ".join(f"MAX(CASE WHEN run = '{r}' THEN importance END) AS {r}" for r in _IMPORTANCE_RUNS)} FROM per GROUP BY feature)
SELECT feature, {", ".join(f"{R(r)} AS {r}" for r in _IMPORTANCE_RUNS)}, {R("(" + " + ".join(f"COALESCE({r}, 0)" for r in _IMPORTANCE_RUNS) + f") / {len(_IMPORTANCE_RUNS)}")} AS mean
FROM w ORDER BY mean DESC, feature LIMIT 20""")
def cv_importance_side_by_side(spark, sf_dir):
    """Importances of two runs aligned by feature name (not position), the top 20 by mean importance."""
    from tabspark.sources.runs import importance_side_by_side

    return rounded(importance_side_by_side(data_importances(spark, sf_dir), list(_IMPORTANCE_RUNS), 20))


@register("stack_run_single", f"""
WITH t AS ({TRAIN_LIKE_SQL}), n AS (SELECT split, COUNT(*) * {len(CLASSES)} AS n FROM t GROUP BY split),
oof AS (SELECT n FROM n WHERE split = 'train'), tst AS (SELECT COALESCE((SELECT n FROM n WHERE split = 'test'), 0) AS n)
SELECT 'pass0' AS attempt, 'stack_logreg' AS name, 'ok' AS status, oof.n AS oof_rows, tst.n AS test_rows, TRUE AS recorded_ok FROM oof, tst
UNION ALL SELECT 'pass1', 'stack_logreg', 'skipped', oof.n, tst.n, TRUE FROM oof, tst""")
def stack_run_single(spark, sf_dir):
    """One stacker configuration end to end (meta features, nested CV, artifacts, ledger row),
    refusing to redo an existing name."""
    import uuid

    from tabspark.sources import dataset as DS
    from tabspark.sources import runs as RS

    root = DS.artifact_root(spark, f"stack-{uuid.uuid4().hex[:12]}")
    oof, tst, labels = prob_runs(spark, sf_dir)
    runs = list(RUNS)

    def job():
        mtr, names = meta_features(oof, runs, len(CLASSES))
        mte, _ = meta_features(tst, runs, len(CLASSES))
        lab = labels.where(F.col("split") == "train").select("row_id", F.col("y").alias("label"))
        res = fit_meta_learner(mtr.join(lab, "row_id"), mte, names, "logreg", 5, 42, 1.0, True, run="stack_logreg")
        truth = lab.select("row_id", F.col("label").alias("y"))
        sc = EV.scores(res.oof, truth, ("run",)).first()
        RS.save_run(root, "stack_logreg", res.oof, res.test, {"train": "train_like", "cv_auc": sc["bal_acc"], "cv_logloss": sc["logloss"]},
                    {"meta_learner": "logreg", "C": 1.0, "n_folds": 5, "seed": 42, "models": runs})
        RS.log_run(root, {"exp_name": "stack_logreg", "mean_cv_metric": sc["bal_acc"], "mean_logloss": sc["logloss"],
                          "ensemble_models": runs, "ensemble_strategy": "stack_logreg"}, spark)

    exists = lambda n: DS.read_text(spark, f"{root}/runs/{n}/meta") is not None
    first = RS.run_batch({"stack_logreg": job}, exists)
    second = RS.run_batch({"stack_logreg": job}, exists)
    status = spark.createDataFrame([(f"pass{i}", *r) for i, r in enumerate(first + second)],
                                   "attempt string, name string, status string, error string, seconds double")
    stored = {split: RS.load_probs(spark, root, ["stack_logreg"], split) for split in ("oof", "test")}
    truth = labels.where(F.col("split") == "train").select("row_id", "y")
    check = RS.check_recorded(EV.log_loss(stored["oof"], truth), RS.read_ledger(spark, root), 1e-9)
    counts = [stored[s].agg(F.count("*").alias(f"{s}_rows")) for s in ("oof", "test")]  # one row each
    out = status.select("attempt", "name", "status").join(check.select(F.col("run").alias("name"), F.col("ok").alias("recorded_ok")), "name", "left")
    return out.select("*", *(F.lit(c.first()[0]).alias(c.columns[0]) for c in counts))


@register("cv_top_importance", f"""
WITH {_IMPORTANCE_SQL}, {_IMP_MEANS}
SELECT feature, {R("importance")} AS importance FROM per WHERE run = 'class_code' ORDER BY importance DESC, feature LIMIT 20""")
def cv_top_importance(spark, sf_dir):
    """The 20 most important features of one run (mean over its folds)."""
    from tabspark.sources.runs import top_importance

    return rounded(top_importance(data_importances(spark, sf_dir), "class_code", 20))
