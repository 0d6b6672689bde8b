"""Session helpers: building a local session for tests and finding the shared checkpoint folder.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it.  A folder is chosen here only when that setting
is unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Row-count bound under which a fitted lookup table (category statistics, fold
# statistics, dictionaries) is broadcast.  Fitted tables are materialised at fit
# time, so their row count is known exactly before the join is planned.
BROADCAST_MAX_ROWS = 2_000_000


def local_session(app: str = "tabspark", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TABSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a scratch one only when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        # on a cluster the folder must be shared by all executors: never a machine-local one
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...)")
    path = tempfile.mkdtemp(prefix="tabspark-ckpt-")  # local mode (tests): one machine
    sc.setCheckpointDir(path)
    return path


# --------------------------------------------------------------------------- lifetimes
_scopes: ContextVar[tuple[list[Callable[[], object]], ...]] = ContextVar("scopes", default=())


@contextmanager
def temporary() -> Iterator[None]:
    """A lifetime for what operators keep outside the plan: caches, checkpoints and written tables made inside
    end with the block, whether or not all went well.

    Results that read them must be collected or written before the block ends::

        with temporary():
            rows = stratified_folds(df, "y").toPandas()

    Blocks nest; outside of any block, such data lives as long as the application."""
    own: list[Callable[[], object]] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        errors = []
        for end in reversed(own):
            try:
                end()
            except Exception as e:  # the others end all the same
                errors.append(e)
        if errors:
            raise errors[0]


def at_end(end: Callable[[], object], outlives: bool = False) -> None:
    """Have ``end`` called when the innermost block ends, or with ``outlives`` the one around it."""
    scopes = _scopes.get()[: -1 if outlives else None]
    if scopes:
        scopes[-1].append(end)


def delete_path(spark: SparkSession, uri: str) -> None:
    """A file or folder of this library, deleted through the file system that Spark uses for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cached(df: DataFrame) -> DataFrame:
    """``df`` persisted until the innermost block ends."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    at_end(df.unpersist)
    return df


def _own_path(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared checkpoint folder, deleted when the innermost block ends."""
    uri = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    at_end(lambda: delete_path(spark, uri))
    return uri


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder (survives executor loss) and read back, as columns: later
    plans start at the files and read only what they need of them.  The files go when the innermost block ends."""
    spark = df.sparkSession
    path = _own_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROWS_PER_BUCKET = 50_000


def spread(spark: SparkSession, rows: int) -> int:
    """Number of partitions for so many rows: it grows with them, so that a task's share does not."""
    return max(min(spark.sparkContext.defaultParallelism, rows // 10_000 + 1), -(-rows // ROWS_PER_BUCKET))


def cut_by_key(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``cut_lineage`` for a table of about ``rows`` keys that is grouped and joined by ``key`` over and over: written in
    buckets of that key, so these need no exchange, and none of their tasks gets more as the table grows."""
    spark = df.sparkSession
    path, name = _own_path(spark, "keyed"), f"keyed_{uuid.uuid4().hex}"
    n = spread(spark, rows)
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name, format="parquet")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files are outside the warehouse and stay; the plan knows them and their buckets
    return out


def materialise_small(df: DataFrame) -> tuple[DataFrame, int]:
    """A fitted statistics table (one aggregate over the training data): cached with its exact
    row count.  Its lineage is a single deterministic aggregate, so a lost block is simply
    recomputed; long or non-deterministic lineages use ``cut_lineage`` instead.  The cache goes when the innermost
    block ends."""
    df = cached(df)
    return df, df.count()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
