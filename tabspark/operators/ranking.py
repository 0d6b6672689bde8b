"""Positions in a total order with one exchange of rows, and no single-partition window.

``rank()`` over an unpartitioned (or coarsely partitioned) window moves the whole group into one task, and a range
partitioning has to be frozen before its totals can be used.  Here each row gets an order-preserving *code*:

1. one aggregate finds approximate quantiles of the first order column; they are literals, so every later use agrees,
   and how well they divide the rows matters for balance only;
2. the code is the bucket between two of them.  A value that spans several quantiles (ties that hold a share of the
   rows) has a bucket to itself, divided by quantiles of the second order column;
3. the histogram of codes is a small partial aggregate, and its prefix sums tell how much lies before each code;
4. each prefix sum joins its code's rows as one more row in front, so a window over ``(group, code)`` counts on from
   there: the rows are exchanged once, by group and code, without a checkpoint or a join.

The input is read three times (quantiles, histogram, rows), so it must give the same rows each time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.session import materialise_small

MAX_BUCKETS = 2048
PREFIX_BYTES = 6  # of a string that its number holds


def order_keys(df: DataFrame, order_cols: Sequence[str]) -> list[tuple[Column, T.DataType]]:
    """The columns, and the fields of structs among them, in the order in which they decide."""
    out = []
    for name in order_cols:
        parts = [(F.col(name), df.schema[name].dataType)]
        while any(isinstance(kind, T.StructType) for _, kind in parts):
            parts = [p for c, kind in parts for p in ([(c[f.name], f.dataType) for f in kind] if isinstance(kind, T.StructType) else [(c, kind)])]
        out += parts
    return out


def order_number(c: Column, kind: T.DataType) -> Column:
    """A double that never falls as the column rises (equal doubles may stand for different values); NULL stays NULL."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        lead = F.rpad(F.hex(F.substring(c.cast("binary"), 1, PREFIX_BYTES)), 2 * PREFIX_BYTES, "0")
        return F.conv(lead, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one value


def _quantiles(df: DataFrame, number: str, buckets: int, where: Column | None = None) -> list[float]:
    finite = F.col(number).isNotNull() & (F.abs(number) < float("inf"))  # NaN is above infinity
    asked = F.percentile_approx(F.when(finite if where is None else finite & where, F.col(number)), [k / buckets for k in range(1, buckets)], 10 * buckets)
    return list(df.agg(asked.alias("q")).first()["q"] or [])


def _bucketed(df: DataFrame, number: str, out: str, bounds: Sequence[float]) -> DataFrame:
    """Integer buckets in order: NULL 0, then 1 and on, NaN last."""
    bounds = sorted(set(bounds))
    if bounds:
        splits = [-float("inf"), *bounds, float("inf")]
        df = Bucketizer(splits=splits, inputCol=number, outputCol=out, handleInvalid="keep").transform(df)
        own = F.col(out).cast("int") + 1
    else:
        own = F.lit(1)
    return df.withColumn(out, F.when(F.col(number).isNull(), 0).when(F.isnan(number), len(bounds) + 2).otherwise(own))


def with_codes(df: DataFrame, order_cols: Sequence[str], buckets: int, measured: DataFrame | None = None) -> DataFrame:
    """``df`` with ``__code``, a bucket in the order of ``order_cols``, and ``__tied``: all rows of the code have the same first
    column.  ``measured``: a table with that column whose quantiles divide it, in place of ``df`` itself."""
    (first, kind), *more = order_keys(df, order_cols)
    d = df.withColumn("__key_number", order_number(first, kind))
    source = d if measured is None else measured.withColumn("__key_number", order_number(*order_keys(measured, order_cols)[0]))
    bounds = _quantiles(source, "__key_number", buckets)
    tied_values = sorted({b for b, c in zip(bounds, bounds[1:]) if b == c})
    d = _bucketed(d, "__key_number", "__key_bucket", bounds)
    special = F.col("__key_number").isNull() | F.isnan("__key_number")
    # a string's number is only a prefix of it
    whole = not isinstance(kind, (T.StringType, T.BinaryType, T.LongType, T.DecimalType, T.TimestampType, T.TimestampNTZType))
    tied = special | F.col("__key_number").isin(tied_values) if tied_values else special
    within, width = F.lit(0), 2
    if more and tied_values and whole:
        d = d.withColumn("__next_number", order_number(*more[0]))
        finer = sorted(set(_quantiles(d, "__next_number", buckets, F.col("__key_number").isin(tied_values))))
        d = _bucketed(d, "__next_number", "__next_bucket", finer)
        within, width = F.col("__next_bucket"), len(finer) + 4
    place = F.when(tied, within).otherwise(F.lit(width - 1))  # the tied value is the least of its bucket
    code = F.col("__key_bucket").cast("long") * width + place
    return d.withColumns({"__code": code, "__tied": F.coalesce(tied & F.lit(whole) | F.col("__key_number").isNull(), F.lit(False))}).drop("__key_number", "__next_number", "__key_bucket", "__next_bucket")


def bucket_count(df: DataFrame, num_partitions: int | None = None) -> int:
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(MAX_BUCKETS, 4 * n))


def running_totals(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], weights: Sequence[str] | Mapping[str, Column], num_partitions: int | None = None, keep_code: bool = False) -> DataFrame:
    """Add ``__before_<weight>`` (and with ``keep_code`` the bucket, ``__code``) for each weight column: its total over the rows of the same group with a strictly smaller
    order key.  Rows must be unique on ``group_cols + order_cols`` (pre-aggregate duplicates into the weights).
    Weights can be given as expressions over the columns, by name: these are worked out on both sides of the exchange, not sent through it."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    given = dict(weights) if isinstance(weights, Mapping) else {w: F.col(w) for w in weights}
    own = {f"__before_{w}": c.cast("long") for w, c in given.items()}
    d = with_codes(df, order_cols, bucket_count(df, num_partitions))
    upto = Window.partitionBy(*group_cols).orderBy("__code").rowsBetween(Window.unboundedPreceding, -1)
    histogram = d.withColumns(own).groupBy(*group_cols, "__code").agg(*(F.sum(s).alias(s) for s in own))
    fronts = histogram.select(*group_cols, "__code", F.array(*(F.coalesce(F.sum(s).over(upto), F.lit(0)) for s in own)).alias("__sums"), F.lit(True).alias("__front"))
    rows = d.withColumn("__front", F.lit(False)).unionByName(fronts, allowMissingColumns=True)
    rows = rows.repartition(*group_cols, "__code")  # the exchange that the window needs, before its sums are columns
    rows = rows.withColumns({s: F.when(F.col("__front"), F.col("__sums")[i]).otherwise(c) for i, (s, c) in enumerate(own.items())}).drop("__sums")
    local = Window.partitionBy(*group_cols, "__code").orderBy(F.desc("__front"), *order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({s: F.sum(s).over(local) - F.col(s) for s in own})
    return out.where("NOT __front").drop("__tied", "__front", *([] if keep_code else ["__code"]))


def count_before(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    weight: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``__before``: total weight (or number) of rows in the same group with a strictly smaller order key.

    Rows must be unique on ``group_cols + order_cols`` (pre-aggregate duplicates into ``weight``)."""
    d = df.withColumn("__w", F.col(weight).cast("long") if weight else F.lit(1).cast("long"))
    return running_totals(d, group_cols, order_cols, ["__w"], num_partitions).withColumnRenamed("__before___w", "__before").drop("__w")


def average_rank(df: DataFrame, group_cols: Sequence[str], value: str, out: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Average rank (1-based, ties share the mean position) of ``value`` within each group, as
    ``scipy.stats.rankdata(method='average')``.  NULL values have no rank and do not count.

    Rows whose value has a code to itself (ties that hold a share of the rows) read their rank off the histogram and stay where
    they are; the others are exchanged once, by group and code, and ranked there."""
    group_cols = list(group_cols)
    coded = with_codes(df.where(F.col(value).isNotNull()), [value], bucket_count(df, num_partitions))
    upto = Window.partitionBy(*group_cols).orderBy("__code").rowsBetween(Window.unboundedPreceding, -1)
    histogram = coded.groupBy(*group_cols, "__code", "__tied").agg(F.count("*").alias("__n"))
    histogram = histogram.select(*group_cols, "__code", "__tied", "__n", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__offset"))

    fronts = histogram.where("NOT __tied").select(*group_cols, "__code", "__offset", F.lit(True).alias("__front"))
    rows = coded.where("NOT __tied").withColumns({"__offset": F.lit(None).cast("long"), "__front": F.lit(False)})
    rows = rows.unionByName(fronts, allowMissingColumns=True)
    order = Window.partitionBy(*group_cols, "__code").orderBy(F.desc("__front"), value)
    smaller = F.first("__offset").over(order) + F.rank().over(order) - 2  # the front row is one of them
    peers = F.count("*").over(order) - 1 + F.first("__offset").over(order)  # rows up to the last equal one
    ranked = rows.withColumn(out, (smaller + peers + 1) / 2.0).where("NOT __front").drop("__front", "__offset", "__code", "__tied")

    held, n = materialise_small(histogram.where("__tied").select(*group_cols, "__code", (F.col("__offset") + (F.col("__n") + 1) / 2.0).alias(out)))
    tied = coded.where("__tied")
    keys = {g: f"__key{k}" for k, g in enumerate(group_cols)}
    both = F.lit(True)
    for g, k in keys.items():
        held = held.withColumnRenamed(g, k)
        both = both & tied[g].eqNullSafe(held[k])
    held = held.withColumnRenamed("__code", "__held")
    tied = tied.join(F.broadcast(held) if n <= MAX_BUCKETS * 64 else held, both & (F.col("__code") == F.col("__held")))
    none = df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    return ranked.unionByName(tied.drop("__held", "__code", "__tied", *keys.values())).unionByName(none)


def dense_index(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], out: str = "index") -> DataFrame:
    """0-based position of each (unique) row in ``order_cols`` order within its group."""
    return count_before(df, group_cols, order_cols).withColumnRenamed("__before", out)
