"""Registered queries: datasets, sidecars, lineage, run artifacts, ledger, submission, streaming (S*, B6, B23)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabspark.operators import blend as BL
from tabspark.operators import evaluate as EV
from tabspark.operators.cross import NumCatInteract
from tabspark.operators.encode import MissingEncoder, TargetDictionary
from tabspark.operators.transform import Log1p, Subtract
from tabspark.plans.common import rounded, sql_round
from tabspark.plans.fixtures import TRAIN_LIKE_NUMS, TRAIN_LIKE_SQL, train_like
from tabspark.plans.probs import CLASSES, RUNS, prob_runs, prob_runs_sql
from tabspark.plans.q_features import FLAGSHIP_SQL
from tabspark.session import read_table
from tabspark.sources import dataset as DS
from tabspark.sources import runs as RS
from tabspark.streaming.apply import apply_models, run_available, stream_table

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


def _root(spark, tag):
    return DS.artifact_root(spark, f"{tag}-{uuid.uuid4().hex[:12]}")


def _train(spark, sf_dir):
    return train_like(spark, sf_dir).where(F.col("split") == "train").drop("split")


# --------------------------------------------------------------------------- S4 / S5 / S16 / V4
@register("io_dataset_sidecar", f"""
WITH t AS ({TRAIN_LIKE_SQL}), tr AS (SELECT * FROM t WHERE split = 'train')
{" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {R(f'ROUND(AVG({c}), 6)')} AS mean, {R(f'ROUND(STDDEV_SAMP({c}), 6)')} AS std, {R(f'ROUND(MIN({c}), 6)')} AS min, {R(f'ROUND(MAX({c}), 6)')} AS max, COUNT(*) - COUNT({c}) AS n_null FROM tr" for c in TRAIN_LIKE_NUMS)}""")
def io_dataset_sidecar(spark, sf_dir):
    """Save the train split as a dataset with its JSON sidecar (one statistics pass,
    content hash, column classification), load the sidecar back, return its numeric statistics."""
    root = _root(spark, "dataset")
    df = train_like(spark, sf_dir)
    DS.save_dataset(df.where(F.col("split") == "train").drop("split"), f"{root}/train_base_v1", "train_base", ["y"],
                    __file__, None, ["basic"], "base")
    DS.save_dataset(df.where(F.col("split") == "test").drop("split", "y"), f"{root}/test_base_v1", "test_base", [],
                    __file__, None, ["basic"], "base")
    # The processed pair, feature lists taken from the sidecar
    tr, te, cats, nums = DS.read_parquet_pair(spark, f"{root}/train_base_v1", f"{root}/test_base_v1", "y")
    DS.check_parity(tr, te, "y")
    meta = DS.load_meta(spark, f"{root}/train_base_v1")
    stats = [r for r in DS.sidecar_stats(meta) if r[0] in nums]
    return rounded(spark.createDataFrame(stats, "column string, mean double, std double, min double, max double, n_null long"))


@register("io_lineage", f"""
WITH t AS ({TRAIN_LIKE_SQL}), n AS (SELECT COUNT(*) AS rows FROM t WHERE split = 'train')
SELECT 0 AS depth, 'train_fe_v2' AS name, 'train_fe' AS slug, 'train_base_v1' AS parent, rows, TRUE AS found FROM n
UNION ALL SELECT 1, 'train_base_v1', 'train_base', NULL, rows, TRUE FROM n""")
def io_lineage(spark, sf_dir):
    """Base dataset -> log1p feature dataset with a parent link; the catalog picks the
    latest 'train_fe' version and the lineage walks back to the base."""
    root = _root(spark, "lineage")
    base = _train(spark, sf_dir)
    DS.save_dataset(base, f"{root}/train_base_v1", "train_base", ["y"], __file__, None, ["basic"])
    fe = Log1p(TRAIN_LIKE_NUMS).transform(spark.read.parquet(f"{root}/train_base_v1"))
    audit = DS.audit_features(fe, base)
    DS.save_dataset(fe, f"{root}/train_fe_v1", "train_fe", ["y"], __file__, "train_base_v1", ["log1p"])
    DS.save_dataset(fe, f"{root}/train_fe_v2", "train_fe", ["y"], __file__, "train_base_v1", ["log1p"],
                    notes=f"{audit.count()} columns added")
    cat = DS.catalog(spark, root)
    newest = DS.latest(cat, "train_fe")
    name = newest.rstrip("/").split("/")[-1]
    return DS.lineage(cat, name).select("depth", "name", "slug", "parent", "rows", "found")


# Columns of the fingerprinted tables, by how their values are written.
_FINGERPRINT_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal:double c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal:double", "part": "p_partkey p_name p_brand p_type p_size p_retailprice:double",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:double o_orderdate:time o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag l_linestatus l_shipdate:time",
    "events": "event_id ts:time user_id event_type value:double props",
}


def _fingerprint_sql() -> str:
    parts = []
    for table, columns in _FINGERPRINT_COLUMNS.items():
        texts = []
        for c in sorted(columns.split()):
            name, _, kind = c.partition(":")
            v = {"double": f"CAST(CAST(FLOOR({name} * {DS.MICRO} + 0.5) AS BIGINT) AS VARCHAR)", "time": f"CAST(epoch_us({name}) AS VARCHAR)", "": f"CAST({name} AS VARCHAR)"}[kind]
            texts.append(f"COALESCE(strlen({v}) || ':' || {v} || ';', 'N;')")
        parts.append(f"SELECT '{table}' AS \"table\", COUNT(*) AS rows, CAST(SUM(CAST(('0x' || substr(md5({' || '.join(texts)}), 1, {DS.FINGERPRINT_DIGITS})) AS BIGINT)) AS VARCHAR) AS hash_sum, TRUE AS order_invariant FROM {table}")
    return " UNION ALL ".join(parts)


@register("io_content_hash", _fingerprint_sql())
def io_content_hash(spark, sf_dir):
    """Order-insensitive content fingerprint of every relational table, checked against a reshuffled copy; and the library's
    faster fingerprint by a 64-bit hash, checked in the same way."""
    rows = []
    for t in _FINGERPRINT_COLUMNS:
        df = read_table(spark, sf_dir, t)
        dealt = df.repartition(F.rand(3))
        one, two = DS.fingerprints(df).first(), DS.fingerprints(dealt).first()
        rows.append((t, int(one["rows"]), one["hash_sum"], tuple(one) == tuple(two)))
    return spark.createDataFrame(rows, "table string, rows long, hash_sum string, order_invariant boolean")


# --------------------------------------------------------------------------- S7-S14 / B6 / B23
LEDGER_RANK_SELECT = f"""SELECT CAST(row_number() OVER (ORDER BY mean_cv_metric DESC, exp_name) AS INTEGER) AS rank, exp_name,
       {R('mean_cv_metric')} AS mean_cv_metric, {R('mean_logloss')} AS mean_logloss FROM allr"""
LEDGER_TWO_RANKS_SELECT = """SELECT exp_name, CAST(rank() OVER (ORDER BY mean_cv_metric DESC) AS INTEGER) AS rank_metric,
       CAST(rank() OVER (ORDER BY mean_logloss ASC) AS INTEGER) AS rank_logloss FROM allr"""


def _ledger_sql(final: str = LEDGER_RANK_SELECT):
    P = prob_runs_sql()
    EPSL = "2.220446049250313e-16"
    return f"""
WITH {P},
pfm AS (SELECT o.run, l.fold, AVG(CASE WHEN o.class = l.y THEN -ln(LEAST(GREATEST(o.p, {EPSL}), 1 - {EPSL})) END) AS logloss
        FROM oof o JOIN lab l ON l.row_id = o.row_id AND l.split = 'train' GROUP BY o.run, l.fold),
pr AS (SELECT run, row_id, arg_min(class, (-p, class)) AS pred FROM oof GROUP BY run, row_id),
rc AS (SELECT pr.run, l.fold, l.y, AVG(CASE WHEN pred = l.y THEN 1.0 ELSE 0.0 END) AS rec FROM pr JOIN lab l ON l.row_id = pr.row_id AND l.split = 'train' GROUP BY ALL),
ba AS (SELECT run, fold, AVG(rec) AS bal_acc FROM rc GROUP BY run, fold),
singles AS (SELECT run AS exp_name, AVG(bal_acc) AS mean_cv_metric, AVG(logloss) AS mean_logloss FROM pfm JOIN ba USING (run, fold) GROUP BY run),
eq AS (SELECT row_id, class, p / SUM(p) OVER (PARTITION BY row_id) AS p FROM (SELECT row_id, class, AVG(p) AS p FROM oof GROUP BY row_id, class)),
eqp AS (SELECT row_id, arg_min(class, (-p, class)) AS pred FROM eq GROUP BY row_id),
eqb AS (SELECT AVG(r) AS b FROM (SELECT l.y, AVG(CASE WHEN pred = l.y THEN 1.0 ELSE 0.0 END) AS r FROM eqp JOIN lab l USING (row_id) WHERE l.split = 'train' GROUP BY l.y)),
eql AS (SELECT AVG(-ln(LEAST(GREATEST(e.p, {EPSL}), 1 - {EPSL}))) AS ll FROM eq e JOIN lab l ON l.row_id = e.row_id AND l.y = e.class AND l.split = 'train'),
allr AS (SELECT * FROM singles UNION ALL SELECT 'ensemble_equal', b, ll FROM eqb, eql)
{final}"""


def _build_ledger(spark, sf_dir):
    root = _root(spark, "runs")
    oof, tst, labels = prob_runs(spark, sf_dir)
    lab = labels.where(F.col("split") == "train")
    _, summary = EV.fold_metrics(oof, lab)
    stats = {r["run"]: r for r in summary.collect()}  # one row per run
    n_rows = lab.count()
    for run in RUNS:
        o = oof.where(F.col("run") == run).join(lab.select("row_id", "fold"), "row_id")
        RS.save_run(root, run, o, tst.where(F.col("run") == run),
                    {"train": "train_like", "cv_auc": stats[run]["mean_bal_acc"], "cv_logloss": stats[run]["mean_logloss"]},
                    {"encoder": "m_estimate", "key": RUNS[run], "m": 5.0, "n_folds": 5, "seed": 1337, "train_rows": n_rows})
        RS.log_run(root, {"exp_name": run, "train_file": "train_like", "n_folds": 5,
                          "mean_cv_metric": stats[run]["mean_bal_acc"], "std_cv_metric": stats[run]["std_bal_acc"],
                          "mean_logloss": stats[run]["mean_logloss"], "params": {"key": RUNS[run], "m": 5.0, "train_rows": n_rows}}, spark)
    names = RS.select_runs(RS.discover_runs(spark, root))
    stored = RS.load_probs(spark, root, names, "oof")
    truth = RS.load_labels(spark, root, names, "y", CLASSES,
                           lambda _: train_like(spark, sf_dir).where(F.col("split") == "train"))
    blended = BL.blend_equal(stored)
    sc = EV.scores(blended.withColumn("run", F.lit("ensemble_equal")), truth, ("run",)).first()
    RS.save_run(root, "ensemble_equal", blended.withColumn("run", F.lit("ensemble_equal")),
                BL.blend_equal(RS.load_probs(spark, root, names, "test")),
                {"train": "train_like", "cv_auc": sc["bal_acc"], "cv_logloss": sc["logloss"]}, {"strategy": "equal", "models": names})
    RS.log_run(root, {"exp_name": "ensemble_equal", "mean_cv_metric": sc["bal_acc"], "std_cv_metric": 0.0,
                      "n_folds": "—", "mean_logloss": sc["logloss"], "ensemble_models": names, "ensemble_strategy": "equal"}, spark)
    return root, RS.read_ledger(spark, root)


@register("io_ensemble_ledger", _ledger_sql())
def io_ensemble_ledger(spark, sf_dir):
    """The three runs are saved as artifacts (probabilities partitioned by run and
    split, meta and config JSON) and logged to the append-only ledger with their fold-mean
    metrics; an equal-blend ensemble is built from the stored artifacts (discover, select,
    load with consistency checks, labels), saved and logged; the ledger is ranked by metric."""
    _, ledger = _build_ledger(spark, sf_dir)
    board = RS.leaderboard(ledger)
    return rounded(board.select(F.col("rank").cast("int"), "exp_name", "mean_cv_metric", "mean_logloss"))


@register("io_ledger_ranks", _ledger_sql(LEDGER_TWO_RANKS_SELECT))
def io_ledger_ranks(spark, sf_dir):
    """The ledger ranked two ways, by metric (desc) and by log-loss (asc)."""
    _, ledger = _build_ledger(spark, sf_dir)
    t = RS.two_metric_table(ledger)
    return t.select("exp_name", F.col("rank_metric").cast("int"), F.col("rank_logloss").cast("int"))


_CONFIG_VALUES = ", ".join(f"('{run}', '{key}')" for run, key in RUNS.items())


@register("io_ledger_params", f"""
WITH t AS ({TRAIN_LIKE_SQL}), n AS (SELECT CAST(COUNT(*) AS VARCHAR) AS n FROM t WHERE split = 'train'), r(run, key) AS (VALUES {_CONFIG_VALUES})
SELECT run AS exp_name, unnest(['key', 'm', 'train_rows']) AS param, unnest([key, '5.0', n]) AS value FROM r, n""")
def io_ledger_params(spark, sf_dir):
    """The JSON parameters stored in the ledger rows as (exp_name, param, value) rows."""
    _, ledger = _build_ledger(spark, sf_dir)
    return RS.params_as_rows(ledger.where(F.col("params").isNotNull()))


@register("io_run_configs", f"""
WITH t AS ({TRAIN_LIKE_SQL}), n AS (SELECT CAST(COUNT(*) AS VARCHAR) AS n FROM t WHERE split = 'train'), r(run, key) AS (VALUES {_CONFIG_VALUES})
SELECT run, unnest(['encoder', 'key', 'm', 'n_folds', 'seed', 'train_rows']) AS param, unnest(['m_estimate', key, '5.0', '5', '1337', n]) AS value FROM r, n""")
def io_run_configs(spark, sf_dir):
    """The configuration that each run's folder holds, read back as rows."""
    root, _ = _build_ledger(spark, sf_dir)
    return RS.load_configs(spark, root).where(F.col("run").isin(list(RUNS)))


@register("io_submission", f"""
WITH {prob_runs_sql()},
eq AS (SELECT row_id, class, p / SUM(p) OVER (PARTITION BY row_id) AS p FROM (SELECT row_id, class, AVG(p) AS p FROM tst GROUP BY row_id, class))
SELECT row_id, CASE CAST(arg_min(class, (-p, class)) AS INTEGER) {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES))} END AS class
FROM eq GROUP BY row_id""")
def io_submission(spark, sf_dir):
    """Equal-blend test prediction decoded to labels, joined onto the test keys, written as
    CSV, re-read and checked (two columns, one row per key)."""
    root = _root(spark, "submission")
    _, tst, labels = prob_runs(spark, sf_dir)
    preds = BL.collect_probs(BL.blend_equal(tst), keep=("row_id",))
    keys = labels.where(F.col("split") == "test").select("row_id")
    return RS.write_submission(preds, keys, CLASSES, f"{root}/submission.csv")


# --------------------------------------------------------------------------- streaming
@register("stream_feature_slice", FLAGSHIP_SQL)
def stream_feature_slice(spark, sf_dir):
    """The flagship feature slice with models fitted on the batch train split and applied to the
    orders table read as a file stream (stream-static joins, parquet sink, availableNow)."""
    batch = train_like(spark, sf_dir, materialise=True)
    train = batch.where(F.col("split") == "train")
    models = [
        TargetDictionary("y").fit(train),
        Log1p(["o_totalprice", "c_acctbal"]),
        MissingEncoder([], ["sum_qty"]).fit_pair(train, batch.where(F.col("split") == "test")),
        Subtract([("o_totalprice", "c_acctbal")]),
        NumCatInteract([("o_totalprice", "o_orderpriority")], ["mean"], 10).fit(train),
    ]
    stream = train_like(spark, sf_dir, orders=stream_table(spark, sf_dir, "orders"))
    out = apply_models(stream, models).select(
        "row_id", "split", "y", "o_totalprice_log1p", "c_acctbal_log1p", "sum_qty", "sum_qty_has_missing",
        "o_totalprice_minus_c_acctbal", "o_totalprice_by_o_orderpriority_mean")
    root = _root(spark, "stream")
    return rounded(run_available(out, f"{root}/sink", f"{root}/checkpoint"))


# --------------------------------------------------------------------------- S1 / V1-V4
@register("io_csv_pair", f"""
WITH t AS ({TRAIN_LIKE_SQL})
SELECT row_id, split, CASE WHEN split = 'train' THEN y END AS y, o_orderpriority, c_mktsegment, {", ".join(f"{R(c)} AS {c}" for c in TRAIN_LIKE_NUMS)} FROM t""")
def io_csv_pair(spark, sf_dir):
    """The train and test splits written as raw CSV (with an ``id`` column), read back with
    an explicit schema, ``id`` kept as ``row_id``, column parity asserted; the target is what the train file has."""
    root = _root(spark, "csv")
    df = train_like(spark, sf_dir)
    cols = ["y", "o_orderpriority", "c_mktsegment", *TRAIN_LIKE_NUMS]
    df.where(F.col("split") == "train").select(F.col("row_id").alias("id"), *cols).write.option("header", True).csv(f"{root}/train")
    df.where(F.col("split") == "test").select(F.col("row_id").alias("id"), *cols).drop("y").write.option("header", True).csv(f"{root}/test")
    schema = "id long, y string, o_orderpriority string, c_mktsegment string, " + ", ".join(f"{c} double" for c in TRAIN_LIKE_NUMS)
    from pyspark.sql.types import _parse_datatype_string

    tr, te = DS.read_csv_pair(spark, f"{root}/train", f"{root}/test", _parse_datatype_string(schema), "y")
    both = tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")).withColumn("y", F.lit(None).cast("string")))
    return rounded(both.select("row_id", "split", "y", "o_orderpriority", "c_mktsegment", *TRAIN_LIKE_NUMS))


_FEATURES = ["o_orderpriority", "c_mktsegment", *TRAIN_LIKE_NUMS]


@register("io_validation_checks", f"""
WITH t AS ({TRAIN_LIKE_SQL}), tr AS (SELECT *, CASE WHEN row_id % 7 <> 0 THEN y END AS y7 FROM t WHERE split = 'train')
SELECT 'null_target_rows' AS "check", CAST(COUNT(*) - COUNT(y7) AS BIGINT) AS value FROM tr
UNION ALL SELECT 'rows_with_target', COUNT(y7) FROM tr
UNION ALL SELECT 'nulls_before_missing_encode', CAST(SUM({" + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _FEATURES)}) AS BIGINT) FROM tr WHERE y7 IS NOT NULL
UNION ALL SELECT 'columns_with_nulls', {" + ".join(f"MAX(CAST({c} IS NULL AS INTEGER))" for c in _FEATURES)} FROM tr WHERE y7 IS NOT NULL
UNION ALL SELECT 'nulls_after_missing_encode', 0
UNION ALL SELECT 'feature_columns_added', {" + ".join(f"MAX(CAST({c} IS NULL AS INTEGER))" for c in TRAIN_LIKE_NUMS)} FROM tr WHERE y7 IS NOT NULL
UNION ALL SELECT 'nulls_in_added_columns', 0
UNION ALL SELECT 'frame_without_a_column_refused', 1
UNION ALL SELECT 'column_of_unknown_type_refused', 1""")
def io_validation_checks(spark, sf_dir):
    """V1-V5 as a report over a frame whose target is NULL in every seventh row: rows dropped and kept (V1), NULLs before and
    after the missing encoder and whether V2 names the columns that have them, parity (V3) and column groups (V4)
    refusing frames that break them, and the columns a step added (V5)."""
    from tabspark.operators.encode import MissingEncoder as ME
    from tabspark.operators.encode import assert_no_nulls, drop_null_target
    from tabspark.operators.profile import missing_summary

    def refused(check, *args) -> int:
        try:
            check(*args)
        except AssertionError:
            return 1
        return 0

    def nulls(df, cols):
        return {r["column"]: int(r["missing_count"]) for r in missing_summary(df, cols).collect()}  # one row a column

    df = train_like(spark, sf_dir)
    train, test = df.where(F.col("split") == "train").drop("split"), df.where(F.col("split") == "test").drop("split", "y")
    train = train.withColumn("y", F.when(F.col("row_id") % 7 != 0, F.col("y")))
    train, n_drop = drop_null_target(train, "y")
    before = nulls(train, _FEATURES)
    m = ME(["o_orderpriority", "c_mktsegment"], TRAIN_LIKE_NUMS).fit_pair(train, test)
    a, b = m.transform(train), m.transform(test)
    named = sum(refused(assert_no_nulls, train, [c]) for c in _FEATURES)
    assert_no_nulls(b)
    DS.check_parity(a, b, "y")
    DS.classify_columns(a, ["y"])
    added = DS.audit_features(a, train).agg(F.count("*").alias("n"), F.coalesce(F.sum("n_null"), F.lit(0)).alias("nulls")).first()
    rows = [
        ("null_target_rows", n_drop), ("rows_with_target", train.count()), ("nulls_before_missing_encode", sum(before.values())),
        ("columns_with_nulls", named), ("nulls_after_missing_encode", sum(nulls(a, _FEATURES).values())),
        ("feature_columns_added", added["n"]), ("nulls_in_added_columns", added["nulls"]),
        ("frame_without_a_column_refused", refused(DS.check_parity, a, b.drop("alpha"), "y")),
        ("column_of_unknown_type_refused", refused(DS.classify_columns, a.withColumn("odd", F.array(F.lit(1))), ["y"])),
    ]
    return spark.createDataFrame(rows, "check string, value long")


# --------------------------------------------------------------------------- B27 / B10 / B7
@register("diag_mean_max_prob", f"""
WITH {prob_runs_sql()}
SELECT run, {R('AVG(m)')} AS mean_max_prob FROM (SELECT run, row_id, MAX(p) AS m FROM oof GROUP BY run, row_id) GROUP BY run""")
def diag_mean_max_prob(spark, sf_dir):
    """Mean maximum class probability of each run's OOF predictions."""
    oof, _, _ = prob_runs(spark, sf_dir)
    return rounded(RS.prob_summary(oof))


@register("io_ensemble_batch", f"""
WITH t AS ({TRAIN_LIKE_SQL}), n AS (SELECT COUNT(*) * {len(CLASSES)} AS n FROM t WHERE split = 'train')
SELECT name, status, ok, CASE WHEN ok OR status = 'skipped' THEN n ELSE 0 END AS oof_rows
FROM n, (VALUES ('ensemble_equal', 'ok', TRUE), ('ensemble_rank', 'ok', TRUE), ('ensemble_bad', 'failed', FALSE), ('me_priority', 'skipped', FALSE)) s(name, status, ok)""")
def io_ensemble_batch(spark, sf_dir):
    """A batch of ensemble configs built from stored run artifacts; an existing name is
    skipped, a failing config is isolated and reported; recorded log-losses are re-checked."""
    root = _root(spark, "batch")
    oof, tst, labels = prob_runs(spark, sf_dir)
    lab = labels.where(F.col("split") == "train")
    for run in RUNS:
        RS.save_run(root, run, oof.where(F.col("run") == run).join(lab.select("row_id", "fold"), "row_id"),
                    tst.where(F.col("run") == run), {"train": "train_like"})
    names = list(RUNS)
    truth = lab.select("row_id", "y")

    def job(name, strategy):
        def go():
            stored = RS.load_probs(spark, root, names, "oof")
            b = BL.blend(stored, strategy).withColumn("run", F.lit(name))
            sc = EV.scores(b, truth, ("run",)).first()
            RS.save_run(root, name, b, BL.blend(RS.load_probs(spark, root, names, "test"), strategy),
                        {"train": "train_like", "cv_auc": sc["bal_acc"], "cv_logloss": sc["logloss"]})
            RS.log_run(root, {"exp_name": name, "mean_cv_metric": sc["bal_acc"], "mean_logloss": sc["logloss"],
                              "ensemble_models": names, "ensemble_strategy": strategy}, spark)
        return go

    exists = lambda n: DS.read_text(spark, f"{root}/runs/{n}/meta") is not None
    configs = {"ensemble_equal": job("ensemble_equal", "equal"), "ensemble_rank": job("ensemble_rank", "rank"),
               "ensemble_bad": job("ensemble_bad", "no_such_strategy"), "me_priority": job("me_priority", "equal")}
    status = RS.batch_summary(spark, RS.run_batch(configs, exists), f"{root}/batch_summary")
    recomputed = EV.log_loss(RS.load_probs(spark, root, ["ensemble_equal", "ensemble_rank"], "oof"), truth)
    check = RS.check_recorded(recomputed, RS.read_ledger(spark, root))
    rows = RS.load_probs(spark, root, ["ensemble_equal", "ensemble_rank", "me_priority"], "oof").groupBy(F.col("run").alias("name")).agg(F.count("*").alias("oof_rows"))
    out = status.select("name", "status").join(check.select(F.col("run").alias("name"), "ok"), "name", "left").join(rows, "name", "left")
    return out.fillna({"ok": False, "oof_rows": 0})
