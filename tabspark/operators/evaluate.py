"""Metrics and run diagnostics B8-B22, M7, M18 over long probability tables.

``long``: ``(run, row_id, class, p)`` (a blended set has ``run`` added as a constant);
``labels``: ``(row_id, y)`` with ``y`` the 0-based class code (plus ``fold`` where needed).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.operators.blend import EPS
from tabspark.operators.joins import join_fitted
from tabspark.session import BROADCAST_MAX_ROWS, cut_by_key, materialise_small
from tabspark.operators.quantile import group_quantiles
from tabspark.operators.ranking import average_rank, bucket_count, running_totals, with_codes


# --------------------------------------------------------------------------- B8 / B9 / M7
def argmax_long(long: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """First-maximum class per (by, row): ``(…, row_id, pred)``."""
    return long.groupBy(*by, "row_id").agg(F.min_by("class", F.struct(-F.col("p"), F.col("class"))).alias("pred"))


def log_loss(long: DataFrame, labels: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Mean of ``-ln(clip(p_true, eps, 1 - eps))`` per group (no renormalisation)."""
    t = long.join(labels.select("row_id", F.col("y").alias("class"), *[c for c in labels.columns if c in by and c not in long.columns]),
                  ["row_id", "class"])
    pc = F.least(F.greatest(F.col("p"), F.lit(EPS)), F.lit(1 - EPS))
    return t.groupBy(*by).agg(F.avg(-F.log(pc)).alias("logloss"))


def balanced_accuracy(long: DataFrame, labels: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Mean recall over the classes present in the truth."""
    extra = [c for c in labels.columns if c in by and c not in long.columns]
    long_by = [c for c in by if c in long.columns]
    pred = argmax_long(long, long_by).join(labels.select("row_id", "y", *extra), "row_id")
    rec = pred.groupBy(*by, "y").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("recall"))
    return rec.groupBy(*by).agg(F.avg("recall").alias("bal_acc"))


def scores(long: DataFrame, labels: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """B8 + B9 from one pass: per (group, row) the first-max class and the true-class
    probability are taken in the same aggregate, then per group / class means."""
    extra = [c for c in labels.columns if c in by and c not in long.columns]
    long_by = [c for c in by if c in long.columns]
    j = long.join(labels.select("row_id", F.col("y").alias("__y"), *extra), "row_id")
    per_row = j.groupBy(*long_by, *extra, "row_id").agg(
        F.first("__y").alias("y"),
        F.min_by("class", F.struct(-F.col("p"), F.col("class"))).alias("pred"),
        F.max(F.when(F.col("class") == F.col("__y"), F.col("p"))).alias("p_true"))
    pc = F.least(F.greatest(F.col("p_true"), F.lit(EPS)), F.lit(1 - EPS))
    per_class = per_row.groupBy(*by, "y").agg(
        F.sum(-F.log(pc)).alias("__ll"), F.count("p_true").alias("__n"),
        F.avg((F.col("pred") == F.col("y")).cast("double")).alias("__rec"))
    return per_class.groupBy(*by).agg((F.sum("__ll") / F.sum("__n")).alias("logloss"), F.avg("__rec").alias("bal_acc"))


def fold_metrics(oof: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M7: per-fold log-loss and balanced accuracy, and their mean / population std per run."""
    per_fold = scores(oof, labels, ("run", "fold"))
    summary = per_fold.groupBy("run").agg(
        F.avg("bal_acc").alias("mean_bal_acc"), F.stddev_pop("bal_acc").alias("std_bal_acc"),
        F.avg("logloss").alias("mean_logloss"), F.stddev_pop("logloss").alias("std_logloss"))
    return per_fold, summary


# --------------------------------------------------------------------------- B11-B16, B21
def max_prob(long: DataFrame) -> DataFrame:
    return long.groupBy("run", "row_id").agg(F.max("p").alias("maxp"))


def _wide_maxprob(long: DataFrame, runs: Sequence[str]) -> DataFrame:
    mp = max_prob(long)
    return mp.groupBy("row_id").pivot("run", list(runs)).agg(F.first("maxp"))


def _pair_corr(wide: DataFrame, runs: Sequence[str], value_cols: dict[str, str]) -> DataFrame:
    pairs = list(itertools.combinations(runs, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(value_cols[a]), F.col(value_cols[b])
        aggs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"r{i}"))
    one = wide.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("run_a"), F.lit(b).alias("run_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)
    ])).alias("s")).select("s.*")


def diversity(long: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Pearson and Spearman correlation of per-row max probability between runs,
    with the diversity verdict (< 0.96 diverse, < 0.99 marginal, else redundant)."""
    mp = max_prob(long)
    mp = cut_by_key(mp, "row_id", mp.count())  # read by every pass below
    wide = mp.groupBy("row_id").pivot("run", list(runs)).agg(F.first("maxp"))
    pear = _pair_corr(wide, runs, {r: f"`{r}`" for r in runs}).withColumnRenamed("r", "pearson")
    ranked = average_rank(mp, ["run"], "maxp", out="rk")
    wide_r = ranked.groupBy("row_id").pivot("run", list(runs)).agg(F.first("rk"))
    spear = _pair_corr(wide_r, runs, {r: f"`{r}`" for r in runs}).withColumnRenamed("r", "spearman")
    out = pear.join(spear, ["run_a", "run_b"])
    verdict = F.when(F.col("pearson") < 0.96, "diverse").when(F.col("pearson") < 0.99, "marginal").otherwise("redundant")
    return out.withColumn("verdict", verdict)


def row_spread(long: DataFrame) -> DataFrame:
    """Per row, population std of the max probability across runs."""
    return max_prob(long).groupBy("row_id").agg(F.stddev_pop("maxp").alias("spread"))


def disagreement(long: DataFrame, labels: DataFrame, reference_run: str) -> tuple[DataFrame, DataFrame]:
    """Rows where any run's argmax differs from ``reference_run``: count and rate,
    and the rate per true class."""
    pred = argmax_long(long, ("run",))
    ref = pred.where(F.col("run") == reference_run).select("row_id", F.col("pred").alias("ref"))
    d = pred.join(ref, "row_id").groupBy("row_id").agg(F.max((F.col("pred") != F.col("ref")).cast("int")).alias("dis"))
    overall = d.agg(F.sum("dis").cast("long").alias("n_disagree"), F.count("*").alias("n_rows"),
                    F.avg("dis").alias("rate"))
    by_class = d.join(labels.select("row_id", "y"), "row_id").groupBy("y").agg(
        F.sum("dis").cast("long").alias("n_disagree"), F.count("*").alias("n_rows"), F.avg("dis").alias("rate"))
    return overall, by_class


def correlation_shift(oof: DataFrame, test: DataFrame, runs: Sequence[str], threshold: float = 0.03) -> DataFrame:
    """Max-probability Pearson between runs on OOF and on test, and a flag when they
    differ by more than ``threshold``."""
    a = _pair_corr(_wide_maxprob(oof, runs), runs, {r: f"`{r}`" for r in runs}).withColumnRenamed("r", "oof_r")
    b = _pair_corr(_wide_maxprob(test, runs), runs, {r: f"`{r}`" for r in runs}).withColumnRenamed("r", "test_r")
    j = a.join(b, ["run_a", "run_b"]).withColumn("delta", F.abs(F.col("test_r") - F.col("oof_r")))
    return j.withColumn("flag", F.when(F.col("delta") > threshold, "investigate").otherwise("ok"))


# --------------------------------------------------------------------------- B17 / B18 / B22
def leaderboard(single: DataFrame, blends: DataFrame) -> DataFrame:
    """Singles and blends ``(strategy, logloss, bal_acc, note)`` sorted by log-loss,
    with the log-loss delta to the best single model."""
    rows = single.select(F.col("run").alias("strategy"), "logloss", "bal_acc", F.lit("single model").alias("note")).unionByName(
        blends.select("strategy", "logloss", "bal_acc", "note"))
    rows, _ = materialise_small(rows)  # a row a strategy: the scores are worked out once
    best = rows.where(F.col("note") == "single model").agg(F.min("logloss").alias("__b")).first()["__b"]  # one number
    return rows.withColumn("delta_vs_best_single", F.when(F.col("note") != "single model", F.col("logloss") - F.lit(best)))


def verdict(board: DataFrame, pair_corr: DataFrame) -> DataFrame:
    """Gain of the best blend over the best single (thresholds 0.002 / 0) and the mean
    pair correlation (0.99 / 0.97) as a one-row summary (built from three one-row results)."""
    bs = board.where(F.col("note") == "single model").orderBy("logloss", "strategy").first()
    be = board.where(F.col("note") != "single model").orderBy("logloss", "strategy").first()
    mc = pair_corr.agg(F.avg("pearson")).first()[0]
    gain = bs["logloss"] - be["logloss"]
    ens = "worthwhile" if gain > 0.002 else "marginal" if gain > 0 else "no gain"
    div = "near-identical" if mc > 0.99 else "low diversity" if mc > 0.97 else "healthy"
    return board.sparkSession.createDataFrame(
        [(bs["strategy"], be["strategy"], gain, be["bal_acc"] - bs["bal_acc"], mc, ens, div)],
        "best_single string, best_ensemble string, logloss_gain double, bal_acc_gain double, mean_pair_corr double, "
        "ensemble_verdict string, diversity_verdict string")


# --------------------------------------------------------------------------- B19 / B20
def calibration_curve(long: DataFrame, labels: DataFrame, positive_class: int = 0, n_bins: int = 10) -> DataFrame:
    """One-vs-rest reliability curve with quantile bins (exact percentiles as edges,
    a value equal to an inner edge falls in the lower bin); empty bins dropped."""
    p = long.where(F.col("class") == positive_class).select("run", "row_id", "p")
    inner = [i / n_bins for i in range(1, n_bins)]
    edges = group_quantiles(p, "p", inner, ["run"]).groupBy("run").agg(
        F.array_sort(F.collect_list("value")).alias("edges"))  # n_bins - 1 values per run
    edges, n_e = materialise_small(edges)
    j = join_fitted(p, edges, "run", n_e).join(labels.select("row_id", "y"), "row_id")
    b = F.size(F.filter("edges", lambda e: e < F.col("p")))
    return j.groupBy("run", b.alias("bin")).agg(
        F.avg((F.col("y") == positive_class).cast("double")).alias("frac_pos"), F.avg("p").alias("mean_pred"),
        F.count("*").alias("n"))


def two_sample(a: DataFrame, b: DataFrame, value: str = "p", group_cols: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Per group, how far the samples ``a`` and ``b`` are apart: ``quantile_distance``, the largest
    |a_(i) - Q_b(i / (n_a - 1))| over the sorted sample ``a`` with ``Q_b`` the linear-interpolation quantile of ``b`` (the
    original labels it KS), and ``ks``, the two-sample Kolmogorov-Smirnov statistic sup |F_a - F_b|.

    One merged pass over the distinct values, each with its weight in either sample.  The distinct values are coded in order,
    and the histogram of codes (a small table) says which ranks of ``b`` each code's values of ``a`` will ask for and which codes hold those
    ranks.  So every code's task gets its own values and the values of ``b`` that it will look up, in one exchange: as the ranks
    asked for rise with the value, no code is sent to many tasks.  Inside a task two windows give the cumulative weights and read off
    the quantiles.  ``Q_b`` rises with the rank, so equal values of ``a`` are furthest from it at their first or their last rank.
    NULL and NaN values take no part; groups without a value in both samples are left out."""
    g = list(group_cols)
    if not g:
        one = lambda d: d.select(F.lit(0).alias("__g"), value)
        return two_sample(one(a), one(b), value, ["__g"], num_partitions).drop("__g")
    v = F.col(value).cast("double")
    both = a.select(*g, v.alias("__v"), F.lit(1).alias("__ca"), F.lit(0).alias("__cb")).unionAll(b.select(*g, v.alias("__v"), F.lit(0), F.lit(1)))
    both = both.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    distinct = both.groupBy(*g, "__v").agg(F.sum("__ca").alias("__ca"), F.sum("__cb").alias("__cb"))
    coded = with_codes(distinct, ["__v"], bucket_count(both, num_partitions), both).drop("__tied")

    codes, n_codes = materialise_small(_code_ranks(coded, g))
    lookups, n_lookups = materialise_small(_code_lookups(codes, g))  # at most twice as many as codes, and one a group

    null, front = F.lit(None).cast("long"), F.lit(None).cast("double")
    names = [*g, "__c", "__kind", "__v", "__xa", "__xb", "__xl", "__na", "__nb"]
    own = coded.select(*g, F.col("__code").alias("__c"), F.lit(1).alias("__kind"), "__v", "__ca", "__cb", null, null, null)
    asked = _null_safe(coded.where("__cb > 0"), lookups.select(*g, F.col("__src").alias("__code"), "__c"), [*g, "__code"], n_lookups)
    asked = asked.select(*g, "__c", F.lit(2).alias("__kind"), "__v", null, null, "__cb", null, null)
    fronts = codes.select(*g, "__code", F.lit(0), front, "__a0", "__b0", null, "__na", "__nb")
    ahead = lookups.groupBy(*g, "__c").agg(F.min("__first").alias("__first")).select(*g, "__c", F.lit(0), front, null, null, "__first", null, null)
    rows = own.toDF(*names)
    for more in (asked, fronts, ahead):
        rows = rows.unionAll(more.toDF(*names))

    upto = Window.partitionBy(*g, "__c").orderBy(F.col("__kind") > 0, "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "__fa": F.sum("__xa").over(upto), "__fb": F.sum("__xb").over(upto), "__fl": F.sum("__xl").over(upto),
        "__na": F.first("__na", ignorenulls=True).over(upto), "__nb": F.first("__nb", ignorenulls=True).over(upto),
    }).where("__kind > 0")
    point = lambda rank, order, end=None, h=None, side=None, ks=None: F.struct(
        rank.cast("long").alias("rank"), F.lit(order).alias("order"), F.lit(end).cast("int").alias("end"), (F.lit(None) if h is None else h - F.floor(h)).cast("double").alias("frac"),
        F.lit(side).cast("int").alias("side"), (F.lit(None) if ks is None else ks).cast("double").alias("ks"))
    steps = [point(F.lit(-1), 2, ks=F.abs(F.col("__fa") / F.col("__na") - F.col("__fb") / F.col("__nb")))]
    for end, i in enumerate((F.col("__fa") - F.col("__xa"), F.col("__fa") - 1)):
        h = _matched_rank(i)
        steps += [point(F.floor(h), 1, end, h, 0), point(F.least(F.floor(h) + 1, F.col("__nb") - 1), 1, end, h, 1)]
    points = F.when(F.col("__kind") == 2, F.array(point(F.col("__fl") - F.col("__xl"), 0))).when(F.col("__xa") > 0, F.array(*steps)).otherwise(F.array(steps[0]))
    points = rows.select(*g, "__c", "__v", F.explode(points).alias("s")).select(*g, "__c", "__v", "s.*")
    at = Window.partitionBy(*g, "__c").orderBy("rank", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = points.withColumn("__q", F.last(F.when(F.col("order") == 0, F.col("__v")), ignorenulls=True).over(at)).where("order > 0")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("__q")))
    each = points.groupBy(*g, "__c", "__v", "end").agg(side(0).alias("__q0"), side(1).alias("__q1"), F.max("frac").alias("frac"), F.max("ks").alias("ks"))
    apart = F.abs(F.col("__v") - (F.col("__q0") + (F.col("__q1") - F.col("__q0")) * F.col("frac")))
    out = each.groupBy(*g).agg(F.max(apart).alias("quantile_distance"), F.max("ks").alias("ks"))
    return out.where("quantile_distance IS NOT NULL")  # a group that is in both samples


def _matched_rank(i):
    """The (fractional) rank of sample b at the level of rank ``i`` of sample a."""
    return F.when(F.col("__na") > 1, i / (F.col("__na") - 1)).otherwise(F.lit(0.0)) * (F.col("__nb") - 1)


def _code_ranks(coded: DataFrame, g: list[str]) -> DataFrame:
    """Per group and code: rows of either sample in it and before it, and in the whole group."""
    before = Window.partitionBy(*g).orderBy("__code").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    h = coded.groupBy(*g, "__code").agg(F.sum("__ca").alias("__ca"), F.sum("__cb").alias("__cb"))
    return h.withColumns({
        "__a0": F.coalesce(F.sum("__ca").over(before), F.lit(0)), "__b0": F.coalesce(F.sum("__cb").over(before), F.lit(0)),
        "__na": F.sum("__ca").over(whole), "__nb": F.sum("__cb").over(whole),
    }).where("__na > 0 AND __nb > 0")


def _code_lookups(codes: DataFrame, g: list[str]) -> DataFrame:
    """(group, code __c, code __src that holds ranks of b which values of a in __c ask for, its first rank)."""
    last = F.least(F.floor(_matched_rank(F.col("__a0") + F.col("__ca") - 1)) + 1, F.col("__nb") - 1)
    asks = codes.where("__ca > 0").select(*(F.col(c).alias(f"__ask_{k}") for k, c in enumerate(g)), F.col("__code").alias("__c"), F.floor(_matched_rank(F.col("__a0"))).alias("__from"), last.alias("__to"))
    has = codes.where("__cb > 0").select(*g, F.col("__code").alias("__src"), F.col("__b0").alias("__first"), (F.col("__b0") + F.col("__cb") - 1).alias("__last"))
    same = F.lit(True)
    for k, c in enumerate(g):
        same = same & F.col(f"__ask_{k}").eqNullSafe(F.col(c))
    return asks.join(has, same & (F.col("__first") <= F.col("__to")) & (F.col("__last") >= F.col("__from"))).select(*g, "__c", "__src", "__first")


def _null_safe(df: DataFrame, small: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Join with a small table of known size on keys that may be NULL."""
    small = small.withColumnsRenamed({c: f"__on_{k}" for k, c in enumerate(on)})
    same = F.lit(True)
    for k, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"__on_{k}"))
    return df.join(F.broadcast(small) if rows <= BROADCAST_MAX_ROWS else small, same)


def quantile_distance(a: DataFrame, b: DataFrame, value: str = "p", group_cols: Sequence[str] = ()) -> DataFrame:
    """The matched-quantile distance of ``two_sample``."""
    return two_sample(a, b, value, group_cols).drop("ks")


def ks_statistic(a: DataFrame, b: DataFrame, value: str = "p", group_cols: Sequence[str] = ()) -> DataFrame:
    """True two-sample Kolmogorov-Smirnov statistic sup |F_a - F_b| over all observed values, of ``two_sample``."""
    return two_sample(a, b, value, group_cols).drop("quantile_distance")


def per_class_hist(long: DataFrame, bins: int = 50) -> DataFrame:
    """Density histogram of each class probability per run (G9 on long probabilities)."""
    rng, n_r = materialise_small(long.groupBy("run", "class").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("n")))
    idx = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("p") - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo"))).cast("int"), F.lit(bins - 1)))
    c = join_fitted(long, rng, ["run", "class"], n_r).groupBy("run", "class", idx.alias("bin")).agg(F.count("*").alias("count"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(c, ["run", "class", "bin"], "left").select(
        "run", "class", "bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.try_divide(F.coalesce("count", F.lit(0)).cast("double"), F.col("n") * width).alias("density"))


# --------------------------------------------------------------------------- M18
def binary_metrics(scored: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """ROC-AUC (ties averaged), average precision (step-wise, as scikit-learn) and F1 at
    ``threshold`` on the probability.  Exact from cumulative TP/FP over distinct scores; the
    running sums come from ``running_totals``.  Rows without a label or a score
    cannot be ranked and are left out of all three."""
    scored = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    g = scored.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("tp"), F.sum((1 - F.col(label).cast("long"))).alias("fp"))
    tot = g.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N")).first()
    P, N = tot["P"] or 0, tot["N"] or 0
    # descending score order: cumulative counts of scores strictly greater
    d = g.withColumn("neg_s", -F.col("s"))
    both = running_totals(d, [], ["neg_s"], ["tp", "fp"]).withColumnsRenamed({"__before_tp": "tp_above", "__before_fp": "fp_above"})
    # AUC: each positive at score s beats the negatives below s and ties half
    auc_num = F.sum(F.col("tp") * ((F.lit(N) - F.col("fp_above") - F.col("fp")) + F.col("fp") / 2.0))
    tp_cum = F.col("tp_above") + F.col("tp")
    fp_cum = F.col("fp_above") + F.col("fp")
    ap = F.sum(F.when(F.col("tp") > 0, (F.col("tp") / F.lit(float(P))) * tp_cum / (tp_cum + fp_cum)).otherwise(0.0))
    m = both.agg((auc_num / F.lit(float(P * N) if P * N else None)).alias("roc_auc"), ap.alias("average_precision"))
    pred = (F.col(score) >= threshold).cast("int")
    f = scored.agg(F.sum((pred * F.col(label)).cast("long")).alias("tp"), F.sum(pred.cast("long")).alias("pp"),
                   F.sum(F.col(label).cast("long")).alias("ap"))
    f1 = f.select(F.try_divide(2.0 * F.col("tp"), F.col("pp") + F.col("ap")).alias("f1")).first()[0]  # one number
    return m.withColumn("f1", F.lit(f1).cast("double"))

