"""M9: Shapley values of class probabilities by feature-order prefixes.

For a row x, a background row z and an order of the features, the model is asked at every prefix: features up to there from
x, the others from z.  What the prediction gains when a feature joins is that feature's contribution for this draw; over a draw the
contributions add up to f(x) - f(z), so their means over the draws add up exactly to f(x) minus the mean of the background
rows drawn.  Orders and background rows are drawn by hashes of the row's id, or enumerated in full where there are few features.

A prediction counts for the feature that has just joined and against the next one, so contributions are one sum per (row, class,
feature), combined before the shuffle; no window and no group of evaluations is ever put together.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.operators.cv import CVResult, predict_probs
from tabspark.operators.profile import seeded_sample
from tabspark.session import BROADCAST_MAX_ROWS, materialise_small


def _background(train: DataFrame, features: Sequence[str], rows: int, seed: int) -> tuple[DataFrame, int]:
    """(number, z) of a seeded sample of ``rows`` rows: a stated, small size."""
    picked = seeded_sample(train, rows, seed).select("row_id", F.array(*[F.col(c).cast("double") for c in features]).alias("z"))
    listed = picked.agg(F.array_sort(F.collect_list(F.struct("row_id", "z"))).alias("s"))  # ``rows`` rows at most
    return materialise_small(listed.select(F.posexplode("s").alias("number", "s")).select(F.col("number").cast("long").alias("number"), "s.z"))


def shapley_values(result: CVResult, frame: DataFrame, features: Sequence[str], sample: int = 100, background: int = 20, draws: int = 16,
                   seed: int = 7, enumerate_orders: bool = False) -> DataFrame:
    """Per sampled held-out row of every fold, class and feature: run, fold, row_id, class, feature, contribution, prediction, base.

    ``frame`` has row_id, fold and the features; ``sample`` rows of each fold are explained by the model that has not seen them,
    against ``background`` rows of the folds that it has.  ``prediction - base`` is the sum of a row's contributions.
    ``enumerate_orders`` asks at every order with every background row (for a handful of features) in place of ``draws`` draws."""
    features, m = list(features), len(features)
    out = None
    for fold, model in sorted(result.models.items()):
        z, n_z = _background(frame.where(F.col("fold") != fold), features, background, seed)
        x = seeded_sample(frame.where(F.col("fold") == fold), sample, seed).select("row_id", F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
        if enumerate_orders:
            orders = F.array(*[F.array(*[F.lit(k) for k in o]) for o in itertools.permutations(range(m))])
            drawn = x.withColumn("order", F.explode(orders)).withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_z - 1).cast("long"))))
        else:
            drawn = x.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
            keys = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.struct(F.xxhash64(F.lit(seed), "row_id", "draw", k).alias("h"), k.alias("k")))
            drawn = drawn.withColumn("order", F.transform(F.array_sort(keys), lambda s: s["k"])).withColumn("number", F.pmod(F.xxhash64(F.lit(seed + 1), "row_id", "draw"), F.lit(n_z)))
        drawn = drawn.join(F.broadcast(z) if n_z <= BROADCAST_MAX_ROWS else z, "number")
        asked = drawn.select("row_id", "order", "x", "z", F.explode(F.sequence(F.lit(0), F.lit(m))).alias("prefix"))
        hybrid = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.when(F.array_position("order", k) <= F.col("prefix"), F.get("x", k)).otherwise(F.get("z", k)))
        scored = predict_probs(model, result.kind, asked.select("row_id", "order", "prefix", array_to_vector(hybrid).alias("features")), result.n_classes)
        point = lambda feature, sign, kind: F.struct(feature.cast("int").alias("feature"), F.lit(float(sign)).alias("sign"), F.lit(kind).alias("kind"))
        # joined: counts for the last feature of the prefix; about to join: against the next; whole rows of x and of z besides
        joins = F.array_compact(F.array(
            F.when(F.col("prefix") > 0, point(F.get("order", F.col("prefix") - 1), 1, "gain")),
            F.when(F.col("prefix") < m, point(F.get("order", F.col("prefix")), -1, "gain")),
            F.when(F.col("prefix") == 0, point(F.lit(-1), 1, "base")),
            F.when(F.col("prefix") == m, point(F.lit(-2), 1, "prediction")),
        ))
        each = scored.select("row_id", F.posexplode("probs").alias("class", "p"), joins.alias("joins")).select("row_id", "class", "p", F.explode("joins").alias("j"))
        sums = each.groupBy("row_id", "class", "j.feature").agg(F.sum(F.col("p") * F.col("j.sign")).alias("total"))
        n_draws = F.lit(float(len(list(itertools.permutations(range(m)))) * n_z if enumerate_orders else draws))
        whole = sums.groupBy("row_id", "class").agg(
            *[(F.sum(F.when(F.col("feature") == k, F.col("total"))) / n_draws).alias(n) for k, n in ((-1, "base"), (-2, "prediction"))],
            F.collect_list(F.when(F.col("feature") >= 0, F.struct("feature", (F.col("total") / n_draws).alias("contribution")))).alias("parts"),  # a row's features
        )
        names = F.array(*[F.lit(c) for c in features])
        own = whole.select(F.lit(result.run).alias("run"), F.lit(fold).alias("fold"), "row_id", "class", "prediction", "base", F.explode("parts").alias("s"))
        own = own.select("run", "fold", "row_id", "class", F.get(names, F.col("s.feature")).alias("feature"), "s.contribution", "prediction", "base")
        out = own if out is None else out.unionByName(own)
    return out


def shapley_wide(values: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row a (run, fold, row_id, class), a column a feature."""
    keys = ["run", "fold", "row_id", "class", "prediction", "base"]
    return values.groupBy(*keys).pivot("feature", list(features)).agg(F.first("contribution"))


def mean_attribution(values: DataFrame) -> DataFrame:
    """Mean absolute contribution of each feature per run and class, over the rows of all folds."""
    return values.groupBy("run", "class", "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.count("*").alias("n_rows"))
