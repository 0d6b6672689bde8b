"""Registered queries: blending, metrics and run diagnostics (B*, T8, M7, E13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabspark.operators import blend as BL
from tabspark.operators import evaluate as EV
from tabspark.operators.encode import decode_argmax
from tabspark.plans.common import rounded, sql_round
from tabspark.plans.probs import CLASSES, RUNS, prob_runs, prob_runs_sql

QUERIES: dict = {}
SQL: dict = {}
R = sql_round
RUN_NAMES = list(RUNS)
EPS = "2.220446049250313e-16"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


W = "WITH " + prob_runs_sql()


def _labels_train(labels):
    return labels.where(F.col("split") == "train")


# --------------------------------------------------------------------------- T8 / B1 / B2
EQUAL_SQL = """eq AS (SELECT row_id, class, p / SUM(p) OVER (PARTITION BY row_id) AS p
                 FROM (SELECT row_id, class, AVG(p) AS p FROM {src} GROUP BY row_id, class))"""
RANK_SQL = """rk AS (
  SELECT run, row_id, class,
         (rank() OVER (PARTITION BY run, class ORDER BY p) + (COUNT(*) OVER (PARTITION BY run, class, p) - 1) / 2.0)
           / COUNT(*) OVER (PARTITION BY run, class) AS p
  FROM {src}),
rb AS (SELECT row_id, class, p / SUM(p) OVER (PARTITION BY row_id) AS p FROM (SELECT row_id, class, AVG(p) AS p FROM rk GROUP BY row_id, class))"""


@register("blend_equal", f"""{W}, {EQUAL_SQL.format(src='oof')}
SELECT row_id, class, {R('p')} AS p FROM eq""")
def blend_equal(spark, sf_dir):
    """B1 + T8: equal-weight blend of the three OOF probability runs, rows renormalised."""
    oof, _, _ = prob_runs(spark, sf_dir)
    return rounded(BL.blend_equal(oof))


@register("blend_rank", f"""{W}, {RANK_SQL.format(src='oof')}
SELECT row_id, class, {R('p')} AS p FROM rb""")
def blend_rank(spark, sf_dir):
    """B2: rank blend (per run and class average rank / n, mean over runs, renormalised)."""
    oof, _, _ = prob_runs(spark, sf_dir)
    return rounded(BL.blend_rank(oof))


# --------------------------------------------------------------------------- B3 / B4
EM_SQL = f"""
tt AS (SELECT o.row_id, o.run, o.p FROM oof o JOIN lab l ON l.row_id = o.row_id AND l.y = o.class AND l.split = 'train'),
tv AS (SELECT {", ".join(f"COALESCE(MAX(CASE WHEN run = '{r}' THEN p END), 0.0) AS t{i}" for i, r in enumerate(sorted(RUN_NAMES)))}
       FROM tt GROUP BY row_id),
tc AS MATERIALIZED (SELECT {", ".join(f"t{i}" for i in range(len(RUN_NAMES)))}, CAST(COUNT(*) AS DOUBLE) AS c FROM tv GROUP BY ALL),
em AS (
  WITH RECURSIVE e(it, {", ".join(f"w{i}" for i in range(len(RUN_NAMES)))}, llp, delta) AS (
    SELECT 0, {", ".join(f"CAST(1.0 AS DOUBLE) / {len(RUN_NAMES)}" for _ in RUN_NAMES)}, CAST(NULL AS DOUBLE), CAST(1.0 AS DOUBLE)
    UNION ALL
    SELECT it + 1, {", ".join(f"n{i} / s" for i in range(len(RUN_NAMES)))}, llc, COALESCE(abs(llc - llp), 1.0)
    FROM (SELECT e.it, e.llp, {", ".join(f"e.w{i}" for i in range(len(RUN_NAMES)))},
                 {", ".join(f"SUM(c * e.w{i} * t{i} / ({' + '.join(f'e.w{j} * t{j}' for j in range(len(RUN_NAMES)))})) AS n{i}" for i in range(len(RUN_NAMES)))},
                 {' + '.join(f"SUM(c * e.w{i} * t{i} / ({' + '.join(f'e.w{j} * t{j}' for j in range(len(RUN_NAMES)))}))" for i in range(len(RUN_NAMES)))} AS s,
                 SUM(c * -ln(LEAST(GREATEST({' + '.join(f'e.w{j} * t{j}' for j in range(len(RUN_NAMES)))}, {EPS}), 1 - {EPS}))) / SUM(c) AS llc
          FROM e, tc WHERE e.delta >= 1e-16 AND e.it < 1000000
          GROUP BY e.it, e.llp, {", ".join(f"e.w{i}" for i in range(len(RUN_NAMES)))})
  )
  SELECT * FROM e ORDER BY it DESC LIMIT 1),
wt AS ({" UNION ALL ".join(f"SELECT '{r}' AS run, w{i} AS weight FROM em" for i, r in enumerate(sorted(RUN_NAMES)))})"""


@register("blend_weights", f"""{W}, {EM_SQL}
SELECT run, {R('weight', 4)} AS weight, (SELECT delta < 1e-16 FROM em) AS converged FROM wt""")
def blend_weights(spark, sf_dir):
    """Mixture weights minimising OOF log-loss (projected Newton), to four decimals: the EM of the oracle SQL is still about 1e-6 off when its log-loss stops moving."""
    oof, _, labels = prob_runs(spark, sf_dir)
    res = BL.optimise_weights(oof, _labels_train(labels))
    return rounded(spark.createDataFrame([(r, w, res.converged) for r, w in zip(res.runs, res.weights)], "run string, weight double, converged boolean"), 4)


@register("blend_optimised_test", f"""{W}, {EM_SQL},
bw AS (SELECT row_id, class, SUM(weight * p) AS p FROM tst JOIN wt USING (run) GROUP BY row_id, class)
SELECT row_id, class, {R('p / SUM(p) OVER (PARTITION BY row_id)')} AS p FROM bw""")
def blend_optimised_test(spark, sf_dir):
    """B3 + B4 + B5: fit weights on OOF, apply the optimised blend to the test probabilities."""
    oof, tst, labels = prob_runs(spark, sf_dir)
    res = BL.optimise_weights(oof, _labels_train(labels))
    return rounded(BL.blend(tst, "optimised", dict(zip(res.runs, res.weights))))


# --------------------------------------------------------------------------- B8 / B9 / B17 / B18 / M7
def _scores_sql(src: str, name_expr: str) -> str:
    return f"""
SELECT {name_expr} AS strategy,
  AVG(-ln(LEAST(GREATEST(p_true, {EPS}), 1 - {EPS}))) AS logloss, ANY_VALUE(bacc) AS bal_acc
FROM (SELECT s.*, (SELECT AVG(rec) FROM (SELECT y, AVG(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS rec FROM
         (SELECT l.row_id, l.y, arg_min(x.class, (-x.p, x.class)) AS pred FROM {src} x JOIN lab l USING (row_id)
          WHERE l.split = 'train' GROUP BY l.row_id, l.y) GROUP BY y)) AS bacc
      FROM (SELECT x.p AS p_true FROM {src} x JOIN lab l ON l.row_id = x.row_id AND l.y = x.class AND l.split = 'train') s)"""


BOARD_SELECT = f"""SELECT strategy, {R('logloss')} AS logloss, {R('bal_acc')} AS bal_acc, note,
       {R("CASE WHEN note <> 'single model' THEN logloss - (SELECT MIN(logloss) FROM board WHERE note = 'single model') END")} AS delta_vs_best_single
FROM board"""


def _board_sql(final: str = BOARD_SELECT):
    singles = []
    for r in RUN_NAMES:
        singles.append(f"SELECT *, 'single model' AS note FROM ({_scores_sql(f'(SELECT row_id, class, p FROM oof WHERE run = {chr(39)}{r}{chr(39)})', repr(r))})")
    blends = [
        f"SELECT *, 'blend' AS note FROM ({_scores_sql('eq', repr('equal'))})",
        f"SELECT *, 'blend' AS note FROM ({_scores_sql('rb', repr('rank'))})",
        f"SELECT *, 'blend' AS note FROM ({_scores_sql('ob', repr('optimised'))})",
    ]
    return f"""{W}, {EQUAL_SQL.format(src='oof')}, {RANK_SQL.format(src='oof')}, {EM_SQL},
ob AS (SELECT row_id, class, p / SUM(p) OVER (PARTITION BY row_id) AS p FROM
       (SELECT row_id, class, SUM(weight * p) AS p FROM oof JOIN wt USING (run) GROUP BY row_id, class)),
board AS ({" UNION ALL ".join(singles + blends)})
{final}"""


def _leaderboard(spark, sf_dir, sets=None):
    oof, _, labels = sets or prob_runs(spark, sf_dir)
    lab = _labels_train(labels)
    single = EV.scores(oof, lab, ("run",))
    res = BL.optimise_weights(oof, lab)
    blends = None
    for name, b in (("equal", BL.blend_equal(oof)), ("rank", BL.blend_rank(oof)),
                    ("optimised", BL.blend_weighted(oof, dict(zip(res.runs, res.weights))))):
        sc = EV.scores(b.withColumn("run", F.lit(name)), lab, ("run",)).select(
            F.col("run").alias("strategy"), "logloss", "bal_acc", F.lit("blend").alias("note"))
        blends = sc if blends is None else blends.unionByName(sc)
    return EV.leaderboard(single, blends)


@register("blend_leaderboard", _board_sql())
def blend_leaderboard(spark, sf_dir):
    """OOF log-loss and balanced accuracy of every run and of the equal, rank and
    optimised blends, with the delta to the best single run."""
    return rounded(_leaderboard(spark, sf_dir))


@register("cv_fold_metrics", f"""{W},
pfm AS (
  SELECT o.run, l.fold,
         AVG(CASE WHEN o.class = l.y THEN -ln(LEAST(GREATEST(o.p, {EPS}), 1 - {EPS})) END) AS logloss
  FROM oof o JOIN lab l ON l.row_id = o.row_id AND l.split = 'train' GROUP BY o.run, l.fold),
pr AS (SELECT o.run, o.row_id, arg_min(o.class, (-o.p, o.class)) AS pred FROM oof o GROUP BY o.run, o.row_id),
rc AS (SELECT pr.run, l.fold, l.y, AVG(CASE WHEN pred = l.y THEN 1.0 ELSE 0.0 END) AS rec
       FROM pr JOIN lab l ON l.row_id = pr.row_id AND l.split = 'train' GROUP BY ALL),
ba AS (SELECT run, fold, AVG(rec) AS bal_acc FROM rc GROUP BY run, fold),
f AS (SELECT * FROM pfm JOIN ba USING (run, fold))
SELECT run, {R('AVG(bal_acc)')} AS mean_bal_acc, {R('STDDEV_POP(bal_acc)')} AS std_bal_acc,
       {R('AVG(logloss)')} AS mean_logloss, {R('STDDEV_POP(logloss)')} AS std_logloss FROM f GROUP BY run""")
def cv_fold_metrics(spark, sf_dir):
    """M7: per-fold log-loss / balanced accuracy of each run; mean and population std over folds."""
    oof, _, labels = prob_runs(spark, sf_dir)
    _, summary = EV.fold_metrics(oof, _labels_train(labels))
    return rounded(summary)


# --------------------------------------------------------------------------- B11-B16, B21
def _maxp_sql(src: str) -> str:
    return f"(SELECT run, row_id, MAX(p) AS maxp FROM {src} GROUP BY run, row_id)"


def _pairs():
    return [(a, b) for i, a in enumerate(RUN_NAMES) for b in RUN_NAMES[i + 1:]]


def _corr_sql(src_wide: str, alias: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS run_a, '{b}' AS run_b, COVAR_POP(\"{a}\", \"{b}\") / (STDDEV_POP(\"{a}\") * STDDEV_POP(\"{b}\")) AS {alias} FROM {src_wide}"
        for a, b in _pairs())


def _wide(src: str, val: str) -> str:
    return "(SELECT row_id, " + ", ".join(f"MAX(CASE WHEN run = '{r}' THEN {val} END) AS \"{r}\"" for r in RUN_NAMES) + f" FROM {src} GROUP BY row_id)"


@register("diag_diversity", f"""{W},
mp AS {_maxp_sql('oof')},
mr AS (SELECT run, row_id, rank() OVER (PARTITION BY run ORDER BY maxp) + (COUNT(*) OVER (PARTITION BY run, maxp) - 1) / 2.0 AS rk FROM mp),
pe AS ({_corr_sql(_wide('mp', 'maxp'), 'pearson')}),
sp AS ({_corr_sql(_wide('mr', 'rk'), 'spearman')})
SELECT run_a, run_b, {R('pearson')} AS pearson, {R('spearman')} AS spearman,
       CASE WHEN pearson < 0.96 THEN 'diverse' WHEN pearson < 0.99 THEN 'marginal' ELSE 'redundant' END AS verdict
FROM pe JOIN sp USING (run_a, run_b)""")
def diag_diversity(spark, sf_dir):
    """Pearson / Spearman of the per-row max probability between runs, with verdict."""
    oof, _, _ = prob_runs(spark, sf_dir)
    return rounded(EV.diversity(oof, RUN_NAMES))


@register("diag_row_spread", f"""{W}, mp AS {_maxp_sql('oof')}
SELECT row_id, {R('STDDEV_POP(maxp)')} AS spread FROM mp GROUP BY row_id""")
def diag_row_spread(spark, sf_dir):
    """Per-row population std of the max probability across runs."""
    oof, _, _ = prob_runs(spark, sf_dir)
    return rounded(EV.row_spread(oof))


@register("diag_disagreement", f"""{W},
pr AS (SELECT run, row_id, arg_min(class, (-p, class)) AS pred FROM oof GROUP BY run, row_id),
d AS (SELECT pr.row_id, MAX(CASE WHEN pr.pred <> r.pred THEN 1 ELSE 0 END) AS dis
      FROM pr JOIN (SELECT row_id, pred FROM pr WHERE run = '{RUN_NAMES[0]}') r USING (row_id) GROUP BY pr.row_id)
SELECT 'all' AS scope, CAST(SUM(dis) AS BIGINT) AS n_disagree, COUNT(*) AS n_rows, {R('AVG(dis)')} AS rate FROM d
UNION ALL
SELECT 'class_' || CAST(l.y AS VARCHAR), CAST(SUM(dis) AS BIGINT), COUNT(*), {R('AVG(dis)')} FROM d JOIN lab l USING (row_id) WHERE l.split = 'train' GROUP BY l.y""")
def diag_disagreement(spark, sf_dir):
    """Rows whose argmax differs from the first run in any run, overall and per class."""
    oof, _, labels = prob_runs(spark, sf_dir)
    overall, by_class = EV.disagreement(oof, _labels_train(labels), RUN_NAMES[0])
    by = by_class.select(F.concat(F.lit("class_"), F.col("y").cast("string")).alias("scope"), "n_disagree", "n_rows", "rate")
    return rounded(overall.select(F.lit("all").alias("scope"), "n_disagree", "n_rows", "rate").unionByName(by))


@register("diag_correlation_shift", f"""{W},
a AS ({_corr_sql(_wide(_maxp_sql('oof'), 'maxp'), 'oof_r')}),
b AS ({_corr_sql(_wide(_maxp_sql('tst'), 'maxp'), 'test_r')})
SELECT run_a, run_b, {R('oof_r')} AS oof_r, {R('test_r')} AS test_r, {R('abs(test_r - oof_r)')} AS delta,
       CASE WHEN abs(test_r - oof_r) > 0.03 THEN 'investigate' ELSE 'ok' END AS flag
FROM a JOIN b USING (run_a, run_b)""")
def diag_correlation_shift(spark, sf_dir):
    """Max-probability correlation between runs on OOF vs test, flag when |delta| > 0.03."""
    oof, tst, _ = prob_runs(spark, sf_dir)
    return rounded(EV.correlation_shift(oof, tst, RUN_NAMES, 0.03))


# --------------------------------------------------------------------------- B19 / B20
@register("diag_calibration", f"""{W},
p0 AS (SELECT run, row_id, p FROM oof WHERE class = 0),
e AS (SELECT run, quantile_cont(p, [{", ".join(str(i / 10) for i in range(1, 10))}]) AS edges FROM p0 GROUP BY run),
b AS (SELECT p0.run, p0.p, l.y, {" + ".join(f"CASE WHEN e.edges[{i}] < p0.p THEN 1 ELSE 0 END" for i in range(1, 10))} AS bin
      FROM p0 JOIN e USING (run) JOIN lab l ON l.row_id = p0.row_id AND l.split = 'train')
SELECT run, CAST(bin AS INTEGER) AS bin, {R('AVG(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END)')} AS frac_pos, {R('AVG(p)')} AS mean_pred, COUNT(*) AS n
FROM b GROUP BY run, bin""")
def diag_calibration(spark, sf_dir):
    """Class-0-vs-rest reliability curve per run on 10 quantile bins (empty bins dropped)."""
    oof, _, labels = prob_runs(spark, sf_dir)
    return rounded(EV.calibration_curve(oof, _labels_train(labels), 0, 10))


@register("diag_oof_test_distance", f"""{W},
a AS (SELECT run, class, p AS va, row_number() OVER (PARTITION BY run, class ORDER BY p) - 1 AS i,
             COUNT(*) OVER (PARTITION BY run, class) AS na FROM oof),
b AS (SELECT run, class, p AS vb, row_number() OVER (PARTITION BY run, class ORDER BY p) - 1 AS j,
             COUNT(*) OVER (PARTITION BY run, class) AS nb FROM tst),
nb AS (SELECT DISTINCT run, class, nb FROM b),
pos AS (SELECT a.run, a.class, va, (CASE WHEN na > 1 THEN i / (na - 1.0) ELSE 0.0 END) * (nb.nb - 1) AS h, nb.nb FROM a JOIN nb USING (run, class)),
pos2 AS (SELECT *, CAST(FLOOR(h) AS BIGINT) AS j0, LEAST(CAST(FLOOR(h) AS BIGINT) + 1, nb - 1) AS j1 FROM pos),
qd AS (SELECT pos2.run, pos2.class, MAX(abs(va - (b0.vb + (b1.vb - b0.vb) * (h - j0)))) AS quantile_distance
       FROM pos2 JOIN b b0 ON b0.run = pos2.run AND b0.class = pos2.class AND b0.j = pos2.j0
                 JOIN b b1 ON b1.run = pos2.run AND b1.class = pos2.class AND b1.j = pos2.j1 GROUP BY ALL),
ua AS (SELECT run, class, p, COUNT(*) AS ca FROM oof GROUP BY ALL),
ub AS (SELECT run, class, p, COUNT(*) AS cb FROM tst GROUP BY ALL),
u AS (SELECT COALESCE(ua.run, ub.run) AS run, COALESCE(ua.class, ub.class) AS class, COALESCE(ua.p, ub.p) AS p,
             COALESCE(ca, 0) AS ca, COALESCE(cb, 0) AS cb FROM ua FULL JOIN ub ON ua.run = ub.run AND ua.class = ub.class AND ua.p = ub.p),
cu AS (SELECT run, class, SUM(ca) OVER w / SUM(ca) OVER (PARTITION BY run, class) AS fa,
                          SUM(cb) OVER w / SUM(cb) OVER (PARTITION BY run, class) AS fb
       FROM u WINDOW w AS (PARTITION BY run, class ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks AS (SELECT run, class, MAX(abs(fa - fb)) AS ks FROM cu GROUP BY ALL)
SELECT run, class, {R('quantile_distance')} AS quantile_distance, {R('ks')} AS ks FROM qd JOIN ks USING (run, class)""")
def diag_oof_test_distance(spark, sf_dir):
    """Per run and class, the matched-quantile distance and the true two-sample KS statistic
    between OOF and test probabilities."""
    oof, tst, _ = prob_runs(spark, sf_dir)
    return rounded(EV.two_sample(oof, tst, "p", ["run", "class"]))


@register("diag_prob_histogram", f"""{W},
rng AS (SELECT run, class, MIN(p) AS lo, MAX(p) AS hi, COUNT(*) AS n FROM oof GROUP BY ALL),
c AS (SELECT o.run, o.class, CASE WHEN hi = lo THEN 0 ELSE LEAST(CAST(FLOOR((p - lo) * 50.0 / (hi - lo)) AS INTEGER), 49) END AS bin, COUNT(*) AS count
      FROM oof o JOIN rng USING (run, class) GROUP BY ALL),
g AS (SELECT run, class, lo, hi, n, CAST(UNNEST(range(0, 50)) AS INTEGER) AS bin FROM rng)
SELECT g.run, g.class, g.bin, COALESCE(c.count, 0) AS count, {R('COALESCE(c.count, 0) / (n * ((hi - lo) / 50.0))')} AS density
FROM g LEFT JOIN c USING (run, class, bin)""")
def diag_prob_histogram(spark, sf_dir):
    """50-bin density histogram of each class probability per run."""
    oof, _, _ = prob_runs(spark, sf_dir)
    return rounded(EV.per_class_hist(oof, 50))


# --------------------------------------------------------------------------- B22 / E13
def _verdict_sql():
    final = f""", mp AS {_maxp_sql('oof')},
pe AS ({_corr_sql(_wide('mp', 'maxp'), 'pearson')}),
bs AS (SELECT * FROM board WHERE note = 'single model' ORDER BY logloss, strategy LIMIT 1),
be AS (SELECT * FROM board WHERE note <> 'single model' ORDER BY logloss, strategy LIMIT 1),
mc AS (SELECT AVG(pearson) AS m FROM pe)
SELECT bs.strategy AS best_single, be.strategy AS best_ensemble, {R('bs.logloss - be.logloss')} AS logloss_gain,
       {R('be.bal_acc - bs.bal_acc')} AS bal_acc_gain, {R('mc.m')} AS mean_pair_corr,
       CASE WHEN bs.logloss - be.logloss > 0.002 THEN 'worthwhile' WHEN bs.logloss - be.logloss > 0 THEN 'marginal' ELSE 'no gain' END AS ensemble_verdict,
       CASE WHEN mc.m > 0.99 THEN 'near-identical' WHEN mc.m > 0.97 THEN 'low diversity' ELSE 'healthy' END AS diversity_verdict
FROM bs, be, mc"""
    return _board_sql(final)


@register("diag_verdict", _verdict_sql())
def diag_verdict(spark, sf_dir):
    """One-row ensemble verdict (log-loss gain thresholds 0.002 / 0, mean pair correlation
    0.99 / 0.97) from the leaderboard and the diversity table."""
    sets = prob_runs(spark, sf_dir)
    board = _leaderboard(spark, sf_dir, sets)
    return rounded(EV.verdict(board, EV.diversity(sets[0], RUN_NAMES)))


@register("enc_decode_argmax", f"""{W}, {EQUAL_SQL.format(src='tst')}
SELECT row_id, CAST(arg_min(class, (-p, class)) AS INTEGER) AS pred_code,
       CASE CAST(arg_min(class, (-p, class)) AS INTEGER) {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES))} END AS pred_label
FROM eq GROUP BY row_id""")
def enc_decode_argmax(spark, sf_dir):
    """First-maximum class of the equal-blend test probabilities, decoded to its label."""
    _, tst, _ = prob_runs(spark, sf_dir)
    eq = BL.collect_probs(BL.blend_equal(tst), keep=("row_id",))
    dictionary = spark.createDataFrame([(i, c) for i, c in enumerate(CLASSES)], "code int, label string")
    return decode_argmax(eq, dictionary, "probs").select("row_id", "pred_code", "pred_label")
