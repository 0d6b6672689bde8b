"""Exact (and approximate) grouped quantiles that stay bounded per task.

``F.percentile`` keeps every distinct value of a group in one aggregation buffer, so a
hot group (a third of a 100 TB table) cannot be finished by one task.  This module finds the
exact order statistics by distributed bucket refinement, the same way at every size:

1. one aggregate gives the count and the finite range per group (and how many values are
   infinite); every requested probability becomes two target ranks (``floor(h)`` and
   ``floor(h)+1`` with ``h = (n-1) q``: linear interpolation, as pandas/numpy/``quantile_cont``);
2. each pass counts the rows of every unresolved bracket in ``buckets`` equal-width buckets
   (map-side partial aggregation, output = brackets x buckets; targets with the same bracket
   share it) and narrows it to the exact ``[min, max]`` of the bucket that holds the rank.  The ends of a
   bracket fall into different buckets, so every pass makes progress and no limit of passes is needed;
3. once a bracket holds at most ``finish_rows`` rows (or one distinct value) its values are
   grouped to ``(value, count)`` and the rank is read off a cumulative sum.

Per-task memory is bounded by ``buckets`` and ``finish_rows``, never by group size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.operators.joins import join_fitted
from tabspark.session import cut_lineage, materialise_small

def _clean_values(df: DataFrame, value: str, group_cols: Sequence[str]) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(*group_cols, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))


def group_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    group_cols: Sequence[str] = (),
    exact: bool = True,
    accuracy: int = 10_000,
    buckets: int = 1024,
    finish_rows: int = 100_000,
) -> DataFrame:
    """Quantiles of ``value`` per group: columns ``*group_cols, q, value`` (NULL/NaN skipped; infinite
    values sort first and last; a NULL group is a group).

    ``exact=False`` uses the mergeable ``percentile_approx`` sketch (one pass, rank error 1/accuracy).
    """
    group_cols = list(group_cols)
    probs = [float(p) for p in probs]
    base = _clean_values(df, value, group_cols)
    if not exact:
        q_arr = F.array(*[F.lit(p) for p in probs])
        out = base.groupBy(*group_cols).agg(F.percentile_approx("__v", q_arr, accuracy).alias("__vals"))
        return out.select(*group_cols, F.posexplode("__vals").alias("__i", "value")).select(
            *group_cols, q_arr[F.col("__i")].alias("q"), "value"
        )
    # one key column whatever the groups are: joins on it are equi-joins, with NULL groups kept
    key = F.to_json(F.struct(*group_cols)) if group_cols else F.lit("")
    values = base.select(key.alias("__g"), "__v").persist(StorageLevel.MEMORY_AND_DISK)
    groups = base.groupBy(*group_cols).agg(F.count("*").alias("__n")).where("__n > 0").select(key.alias("__g"), *group_cols)
    groups, n_groups = materialise_small(groups)
    found = _refine(values, probs, buckets, finish_rows)
    out = join_fitted(found, groups, "__g", n_groups).select(*group_cols, "q", "value")
    out, _ = materialise_small(out)  # groups x probabilities rows
    groups.unpersist()
    values.unpersist()
    return out


def _refine(values: DataFrame, probs: Sequence[float], buckets: int, finish_rows: int) -> DataFrame:
    v = F.col("__v")
    inf = float("inf")
    finite = (v > -inf) & (v < inf)
    stats = values.groupBy("__g").agg(
        F.count("*").alias("__n"), F.count_if(v == -inf).alias("__low"), F.count_if(v == inf).alias("__high"),
        F.min(F.when(finite, v)).alias("__lo"), F.max(F.when(finite, v)).alias("__hi"),
    )
    h = (F.col("__n") - 1).cast("double") * F.col("__q")
    rank, inner = F.col("__rank"), F.col("__n") - F.col("__low") - F.col("__high")
    below_all, above_all = rank < F.col("__low"), rank >= F.col("__n") - F.col("__high")

    def zone(low, high, middle):
        return F.when(below_all, low).when(above_all, high).otherwise(middle)

    targets = (
        stats.withColumn("__q", F.explode(F.array(*[F.lit(p) for p in probs])))
        .withColumn("__which", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("__frac", h - F.floor(h))
        .withColumn("__rank", F.least(F.floor(h).cast("bigint") + F.col("__which"), F.col("__n") - 1))
        .select(
            "__g", "__q", "__which", "__frac", "__rank",
            zone(F.lit(-inf), F.lit(inf), F.col("__lo")).alias("__lo"), zone(F.lit(-inf), F.lit(inf), F.col("__hi")).alias("__hi"),
            zone(F.lit(0).cast("long"), F.col("__n") - F.col("__high"), F.col("__low")).alias("__below"),
            zone(F.col("__low"), F.col("__high"), inner).alias("__cnt"),
        )
    )
    targets, _ = materialise_small(targets)
    bracket = ["__g", "__lo", "__hi"]
    done = (F.col("__cnt") <= finish_rows) | (F.col("__lo") == F.col("__hi"))

    def rows_of(t: DataFrame) -> DataFrame:
        """The values inside the distinct brackets of the targets ``t``."""
        own, n = materialise_small(t.select(*bracket).distinct())
        inside = join_fitted(values, own, "__g", n)
        return inside.where((v >= F.col("__lo")) & (v <= F.col("__hi")))

    def at_rank(counted: DataFrame, t: DataFrame, order: str) -> DataFrame:
        """For each target the counted row that holds its rank; ``__upto``: rows of the bracket up to there."""
        w = Window.partitionBy(*bracket).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = counted.withColumn("__upto", F.sum("__c").over(w))
        before = F.col("__below") + F.col("__upto") - F.col("__c")
        return upto.join(t, bracket).where((before <= rank) & (rank < F.col("__below") + F.col("__upto")))

    while not targets.where(~done).isEmpty():
        active = targets.where(~done)
        # halves, so that the width of the whole range of doubles is a number
        width = (F.col("__hi") / 2 - F.col("__lo") / 2) / F.lit(float(buckets))
        even = F.least(F.floor((v / 2 - F.col("__lo") / 2) / width).cast("int"), F.lit(buckets - 1))
        place = F.when(width > 0, even).otherwise(F.when(v > F.col("__lo"), F.lit(1)).otherwise(F.lit(0)))
        counted = rows_of(active).select(*bracket, place.alias("__b"), "__v").groupBy(*bracket, "__b").agg(
            F.count("*").alias("__c"), F.min("__v").alias("__blo"), F.max("__v").alias("__bhi"))
        narrowed = at_rank(counted, active, "__b").select(
            "__g", "__q", "__which", "__frac", "__rank", F.col("__blo").alias("__lo"), F.col("__bhi").alias("__hi"),
            (F.col("__below") + F.col("__upto") - F.col("__c")).alias("__below"), F.col("__c").alias("__cnt"))
        targets = cut_lineage(targets.where(done).unionByName(narrowed))
    counted = rows_of(targets).groupBy(*bracket, "__v").agg(F.count("*").alias("__c"))
    out = at_rank(counted, targets, "__v").groupBy("__g", "__q").agg(
        F.max(F.when(F.col("__which") == 0, v)).alias("__v0"),
        F.max(F.when(F.col("__which") == 1, v)).alias("__v1"),
        F.max("__frac").alias("__frac"),
    )
    between = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.col("__frac")
    return out.select("__g", F.col("__q").alias("q"), F.when(F.col("__frac") == 0, F.col("__v0")).when(F.col("__v0") == F.col("__v1"), F.col("__v0")).otherwise(between).alias("value"))


def quantile_row(df: DataFrame, value: str, probs: Sequence[float], exact: bool = True, **kw) -> list[float]:
    """Global quantiles of one column as a list (a fit statistic: one small row to the driver)."""
    rows = group_quantiles(df, value, probs, (), exact=exact, **kw).collect()
    by_q = {r["q"]: r["value"] for r in rows}
    return [by_q.get(float(p)) for p in probs]
