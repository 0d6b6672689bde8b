"""What all runs of a cross-validation read is made once, and a row of it holds one fold's vector at a time."""

import math

import pytest
from pyspark.sql import functions as F

from tabspark.operators import cv as C
from tabspark.operators.ordered import OrderedTargetEncoder
from tabspark.operators.ranking import running_totals
from tabspark.plans.q_model import audited
from tabspark.session import cut_by_key, temporary


def rows(spark, n=120):
    data = [(i, "abc"[i * i % 3] if i % 11 else None, (i // 3) % 2, i % 3, math.sin(i)) for i in range(n)]
    return spark.createDataFrame(data, "row_id long, cat string, label int, fold int, x1 double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_row_holds_the_vector_of_one_fold(spark, monkeypatch):
    folded, kept = rows(spark), []
    base = type(folded)
    persist = base.persist
    monkeypatch.setattr(base, "persist", lambda self, *a: (kept.append(self.schema), persist(self, *a))[1])
    with temporary():
        model = OrderedTargetEncoder(["cat"], "label", [0, 1]).fit(folded)
        res = C.fit_oof(model.transform_train(folded), model.transform(folded.drop("fold", "label")), ["x1", *model.features()], "label", "gbt_ovr", {"maxIter": 1, "maxDepth": 1, "seed": 1}, n_classes=2)
        assert res.oof.count() == res.test.count() == 240
    vectors = [sum(f.dataType.typeName() == "vectorudt" for f in schema) for schema in kept]
    assert max(vectors) == 1 and sum(vectors) == 3  # one a fold, and no copy of it for the classes


def test_weights_given_as_expressions_stay_out_of_the_exchange(spark):
    df = rows(spark)
    ones = {f"w{k}": (F.col("fold") == k).cast("int") for k in range(3)}
    plain = running_totals(df.withColumns(ones), ["cat"], ["row_id"], list(ones)).drop(*ones)
    short = running_totals(df, ["cat"], ["row_id"], ones)
    assert sorted(map(str, short.collect())) == sorted(map(str, plain.select(short.columns).collect()))
    assert not [c for c in short.columns if c in ones]
    sent = next(line for line in plan(short).split("\n") if "SortMergeJoin" not in line and "hashpartitioning(cat" in line and "__code" in line)
    below = plan(short).split(sent)[1].split("\n")
    assert "Union" in below[1] and "__front" in below[2] and "__before_w0" not in below[2]


def plain_audit(probs, dealt):
    """As the table is defined: rows that share an id and a fold are taken together."""
    groups = {}
    for run, i, fold, c, p in probs:
        for d in [d for j, d in dealt if j == i and i is not None] or [None]:
            groups.setdefault((run, i, fold), []).append((c, p, d))
    out = {}
    for (run, i, fold), members in groups.items():
        known = [d for _, _, d in members if d is not None]
        for c, p, _ in members:
            t = out.setdefault((run, fold, c), [0, set(), 0, 0, None])
            t[0] += 1
            t[1] |= {i} - {None}
            t[2] += 0 <= p <= 1
            t[3] += abs(sum(q for _, q, _ in members) - 1) < 1e-9
            if known:
                t[4] = (t[4] or 0) + (max(known) == fold)
    return {k: (t[0], len(t[1]), *t[2:]) for k, t in out.items()}


def test_audit_counts_odd_rows_and_leaves_them_in_their_buckets(spark):
    probs = [("r", 1, 0, 0, 0.25), ("r", 1, 0, 1, 0.75), ("r", 2, 0, 0, 0.5), ("r", 2, 0, 1, 0.75), ("r", 3, 1, 0, 1.5), ("r", 3, 1, 1, -0.5),
             ("r", 4, 1, 0, 0.5), ("r", 4, 1, 1, 0.5), ("r", 4, 1, 0, 0.5), ("r", 4, 1, 1, 0.5), ("r", None, 1, 0, 0.5), ("r", None, 1, 1, 0.5), ("r", 6, 2, 0, 1.0)]
    dealt = [(1, 0), (2, 1), (3, 1), (4, 1), (4, 1), (None, 1)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with temporary():
            oof = cut_by_key(spark.createDataFrame(probs, "run string, row_id long, fold int, class int, p double"), "row_id", 60)
            folded = cut_by_key(spark.createDataFrame(dealt, "row_id long, fold int"), "row_id", 60)
            out = audited(C.CVResult("r", oof, oof.drop("fold"), n_classes=2), folded)
            got = {(r.run, r.fold, r["class"]): (r.n_rows, r.n_ids, r.n_inside, r.n_unit, r.n_own) for r in out.where("split = 'oof'").collect()}
            tests = {r["class"]: r.n_rows for r in out.where("split = 'test'").collect()}
            assert plan(out).count("Exchange hashpartitioning") == 2  # of the sums by run and fold, for both splits
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == plain_audit(probs, dealt) and tests == {0: 7, 1: 6}


def test_a_sweep_reads_and_writes_its_rows_once(spark, monkeypatch):
    folded = rows(spark)
    themes = {"small": {"maxDepth": 1, "seed": 1}, "large": {"maxDepth": 3, "seed": 1}}
    args, made, cut = (folded, folded, ["x1"]), [], C.cut_by_key
    with temporary():
        single = {name: C.fit_oof(*args, kind="decision_tree", params=params, n_classes=2, run=name) for name, params in themes.items()}
        monkeypatch.setattr(C, "cut_by_key", lambda *a: (made.append(a), cut(*a))[1])
        swept = C.sweep(*args, "decision_tree", themes, n_classes=2)
        for name, res in swept.items():
            for a, b in ((res.oof, single[name].oof), (res.test, single[name].test)):
                assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert len(made) == 2  # the out-of-fold and the test rows of both themes
        with pytest.raises(ValueError):
            C.sweep(*args, "decision_tree", {"odd": {"depth": 1}}, n_classes=2)
