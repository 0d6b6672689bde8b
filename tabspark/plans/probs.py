"""Probability sets for the blending / diagnostics queries, produced by the library itself.

Three "runs" are leakage-free class-probability lookup models: the cross-fitted
m-estimate encoder (E10/E11) of one categorical key each (order priority, market
segment, and their cat x cat compound, C4).  Train rows get out-of-fold probabilities,
test rows the full-train map, exactly like K-fold model runs.  Each row sums to 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.operators.cross import CatCatInteract
from tabspark.operators.cv import folds_sql, stratified_folds
from tabspark.operators.encode import MEstimateEncoder
from tabspark.plans.fixtures import TRAIN_LIKE_SQL, train_like
from tabspark.session import cut_by_key, cut_lineage

# Fixed values of the probability fixture.
CLASSES = ["F", "O", "P"]  # class code = position
RUNS = {
    "me_priority": "o_orderpriority",
    "me_segment": "c_mktsegment",
    "me_priority_segment": "o_orderpriority__c_mktsegment",
}
M = 5.0


def prob_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(oof, test, labels)``: long ``(run, row_id, class, p)`` sets and ``(row_id, y, fold, split)``."""
    df = train_like(spark, sf_dir, materialise=True)
    train = df.where(F.col("split") == "train")
    test = df.where(F.col("split") == "test")
    cross = CatCatInteract([("o_orderpriority", "c_mktsegment")], max_combined_cardinality=200).fit(train)
    keys = list(RUNS.values())
    folded = cut_lineage(stratified_folds(cross.transform(train), "y", k=5, seed=1337).select("row_id", "y", "fold", *keys))
    test = cross.transform(test).select("row_id", "y", F.lit(None).cast("int").alias("fold"), *keys)
    models = MEstimateEncoder.fit_many(folded, keys, "y", CLASSES, "fold", m=M)
    for key in keys:
        folded, test = models[key].transform_oof(folded), models[key].transform(test)
    code = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("y")) - 1
    names = ["row_id", code.cast("int").alias("y"), "fold", *(n for key in keys for n in models[key].names)]
    # the probability sets are run artifacts: materialise them once, like saved prediction files (a row holds all runs)
    rows = folded.select(F.lit("train").alias("split"), *names).unionByName(test.select(F.lit("test").alias("split"), *names))
    rows = cut_by_key(rows, "row_id", df.count())
    each = F.explode(F.array(*(F.struct(F.lit(run).alias("run"), F.lit(k).alias("class"), F.col(n).alias("p")) for run, key in RUNS.items() for k, n in enumerate(models[key].names))))
    oof, tst = (rows.where(F.col("split") == split).select("row_id", each.alias("s")).select("s.run", "row_id", "s.class", "s.p") for split in ("train", "test"))
    return oof, tst, rows.select("row_id", "y", "fold", "split")


def prob_runs_sql() -> str:
    """CTEs ``oof``, ``tst`` and ``lab`` computing the same sets in SQL (for the oracle)."""
    keys = {
        "me_priority": "CAST(o_orderpriority AS VARCHAR)",
        "me_segment": "CAST(c_mktsegment AS VARCHAR)",
        "me_priority_segment": "COALESCE(CAST(o_orderpriority AS VARCHAR), 'nan') || '__' || COALESCE(CAST(c_mktsegment AS VARCHAR), 'nan')",
    }
    k = len(CLASSES)
    sums = ", ".join(f"SUM(CASE WHEN y = '{c}' THEN 1.0 ELSE 0.0 END) AS s{i}" for i, c in enumerate(CLASSES))
    ctes = [
        f"t AS ({TRAIN_LIKE_SQL})",
        "tr AS (SELECT * FROM t WHERE split = 'train')",
        "te AS (SELECT * FROM t WHERE split = 'test')",
        f"trf AS ({folds_sql('SELECT * FROM tr')})",
        "fo AS (SELECT DISTINCT fold FROM trf)",
        "pf AS (SELECT fo.fold, " + ", ".join(f"AVG(CASE WHEN x.y = '{c}' THEN 1.0 ELSE 0.0 END) AS p{i}" for i, c in enumerate(CLASSES))
        + " FROM fo JOIN trf x ON x.fold <> fo.fold GROUP BY fo.fold)",
        "pa AS (SELECT " + ", ".join(f"AVG(CASE WHEN y = '{c}' THEN 1.0 ELSE 0.0 END) AS p{i}" for i, c in enumerate(CLASSES)) + " FROM trf)",
    ]
    oof_parts, tst_parts = [], []
    for r, (run, key) in enumerate(RUNS.items()):
        expr = keys[run]
        ctes.append(f"cf{r} AS (SELECT {expr} AS key, fold, COUNT(*) AS n, {sums} FROM trf GROUP BY 1, 2)")
        ctes.append(f"ca{r} AS (SELECT key, SUM(n) AS n, " + ", ".join(f"SUM(s{i}) AS s{i}" for i in range(k)) + f" FROM cf{r} GROUP BY key)")
        ctes.append(
            f"oo{r} AS (SELECT ca.key, fo.fold, ca.n - COALESCE(cf.n, 0) AS n, "
            + ", ".join(f"ca.s{i} - COALESCE(cf.s{i}, 0) AS s{i}" for i in range(k))
            + f" FROM ca{r} ca CROSS JOIN fo LEFT JOIN cf{r} cf ON cf.key = ca.key AND cf.fold = fo.fold)")
        for i in range(k):
            oof_parts.append(
                f"SELECT '{run}' AS run, trf.row_id, {i} AS class, CASE WHEN o.n IS NULL OR o.n = 0 THEN pf.p{i} "
                f"ELSE (o.s{i} + {M} * pf.p{i}) / (o.n + {M}) END AS p FROM trf JOIN pf ON pf.fold = trf.fold "
                f"LEFT JOIN oo{r} o ON o.key = ({expr.replace('o_orderpriority', 'trf.o_orderpriority').replace('c_mktsegment', 'trf.c_mktsegment')}) AND o.fold = trf.fold")
            tst_parts.append(
                f"SELECT '{run}' AS run, te.row_id, {i} AS class, CASE WHEN a.n IS NULL OR a.n = 0 THEN pa.p{i} "
                f"ELSE (a.s{i} + {M} * pa.p{i}) / (a.n + {M}) END AS p FROM te CROSS JOIN pa "
                f"LEFT JOIN ca{r} a ON a.key = ({expr.replace('o_orderpriority', 'te.o_orderpriority').replace('c_mktsegment', 'te.c_mktsegment')})")
    ctes.append("oof AS (" + " UNION ALL ".join(oof_parts) + ")")
    ctes.append("tst AS (" + " UNION ALL ".join(tst_parts) + ")")
    code = "CASE y " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSES)) + " END"
    ctes.append(f"lab AS (SELECT row_id, {code} AS y, fold, 'train' AS split FROM trf "
                f"UNION ALL SELECT row_id, {code} AS y, NULL AS fold, 'test' AS split FROM te)")
    return ",\n".join(ctes)
