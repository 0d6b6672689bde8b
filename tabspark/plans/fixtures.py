"""Stand-in inputs over the driver tables (schemas in FIXTURES.md).

These only shape rows of the given tables into the schemas the operators expect; the
operators do all of the work.  Every builder reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.session import cut_lineage, read_table

# Fixed values of the train_like fixture.
TRAIN_LIKE_TARGET = "y"
TRAIN_LIKE_CATS = ["o_orderpriority", "c_mktsegment"]
TRAIN_LIKE_NUMS = ["o_totalprice", "c_acctbal", "sum_qty", "avg_disc", "n_items", "alpha", "delta"]
TEST_SPLIT_FROM = "2000-01-01"  # time-based holdout: orders on/after this date form the test frame


def train_like(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None, materialise: bool = False) -> DataFrame:
    """orders LEFT JOIN customer LEFT JOIN per-order lineitem aggregates, with a ``split`` column.

    ``y`` (o_orderstatus) is kept on test rows too so that held-out metrics can be computed;
    operators that fit never read test rows.  ``orders`` may be a streaming DataFrame of the
    orders table (stream-static joins).  With ``materialise`` a batch result is written once as
    a checkpointed table (the prepared dataset several fits then scan) instead of re-running
    the joins per fit; single-pass queries leave it lazy.
    """
    orders = (orders if orders is not None else read_table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("row_id"),
        "o_custkey",
        F.col("o_orderstatus").alias("y"),
        "o_totalprice",
        "o_orderpriority",
        "o_orderdate",
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    items = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.avg("l_discount").alias("avg_disc"),
            F.count("*").cast("double").alias("n_items"),
        )
    )
    df = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(
        items, orders.row_id == items.l_orderkey, "left"
    )
    out = df.select(
        "row_id",
        F.when(F.col("o_orderdate") >= F.lit(TEST_SPLIT_FROM).cast("timestamp"), F.lit("test"))
        .otherwise(F.lit("train"))
        .alias("split"),
        "y",
        "o_orderpriority",
        "c_mktsegment",
        "o_totalprice",
        "c_acctbal",
        "sum_qty",
        "avg_disc",
        "n_items",
        (F.col("o_custkey") % 360).cast("double").alias("alpha"),
        ((F.col("o_custkey") % 180) - 90).cast("double").alias("delta"),
    )
    if materialise and not out.isStreaming:
        out = cut_lineage(out)
    return out


def train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = train_like(spark, sf_dir)
    return df.where(F.col("split") == "train").drop("split"), df.where(F.col("split") == "test").drop("split")


def skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), "event_type", "value", "user_id"
    )


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("row_id"), "quality", "toxic", "lang", "source", F.col("n_chars").cast("double").alias("n_chars")
    )


def part_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), "p_brand", "p_type", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"
    )


# SQL of the same fixtures, for the DuckDB oracle.
TRAIN_LIKE_SQL = f"""
SELECT o.o_orderkey AS row_id,
       CASE WHEN o.o_orderdate >= TIMESTAMP '{TEST_SPLIT_FROM}' THEN 'test' ELSE 'train' END AS split,
       o.o_orderstatus AS y, o.o_orderpriority, c.c_mktsegment, o.o_totalprice, c.c_acctbal,
       li.sum_qty, li.avg_disc, li.n_items,
       CAST(o.o_custkey % 360 AS DOUBLE) AS alpha,
       CAST((o.o_custkey % 180) - 90 AS DOUBLE) AS delta
FROM orders o
LEFT JOIN (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer) c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS sum_qty, AVG(l_discount) AS avg_disc,
                  CAST(COUNT(*) AS DOUBLE) AS n_items
           FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey
"""

SKEWED_SQL = "SELECT event_id AS row_id, event_type, value, user_id FROM events"

BINARY_SQL = """
SELECT l.doc_id AS row_id, l.quality, l.toxic, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS n_chars
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

PART_LIKE_SQL = """
SELECT p_partkey AS row_id, p_brand, p_type, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part
"""
