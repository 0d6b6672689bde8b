"""Shared-folder helpers: every file an operator leaves for later jobs goes below ``spark.checkpoint.dir``.

Tables are written with Spark (task commit, safe against lost executors).  Raw files are written
by tasks under attempt-unique names; the rows a task returns name its file, and only rows that
Spark committed are read afterwards, so files of failed attempts are never looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.session import at_end, delete_path, ensure_checkpoint_dir, temporary

ARROW_ROWS = 2000  # rows in one Arrow batch handed to a Python task


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder known, and Arrow batches of at most ``ARROW_ROWS`` rows (whole texts are wide)."""
    ensure_checkpoint_dir(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to new folders inside is deleted at the end, whether or not all went well, but for tables saved with
    ``outlives``, which belong to the block outside.  Lazy results of the inside must be saved so before they leave."""
    with temporary():
        yield


def shared_folder(spark: SparkSession, kind: str, outlives: bool = False) -> str:
    """A new folder name below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    uri = f"{base}/{kind}-{uuid.uuid4().hex}"
    at_end(lambda: delete_path(spark, uri), outlives)
    return uri


def saved(df: DataFrame, kind: str, outlives: bool = False, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends at the files."""
    spark = df.sparkSession
    path = shared_folder(spark, kind, outlives)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when their query ends, rather than when the driver next collects garbage.  For steps
    that are each run once and saved: a DataFrame that runs a second time makes its shuffles anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their exact names, whatever characters are in them."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def fresh(taken: Iterable[str], stem: str) -> str:
    """``stem``, or it and as many underscores as make it a name that is not taken (in any case)."""
    lower = {n.lower() for n in taken}
    while stem.lower() in lower:
        stem += "_"
    return stem


def file_rows(df: DataFrame) -> Column | None:
    """A number for each row, from its file and its place in it, the same whenever the files are read; None if ``df`` is
    anything but a plain read of Parquet files.  The files' part is a hash under a seed that tells all of them apart."""
    try:
        if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
            return None
        place = df.metadataColumn("_metadata")
        of_file = df.select(place["file_path"].alias("path"), place["row_index"].alias("at")).groupBy("path").agg(F.max("at").alias("last"), F.count("*").alias("rows"))
        seeds = range(8)
        whole = F.coalesce(F.bool_and(F.col("rows") == F.col("last") + 1), F.lit(True))  # no file is read twice
        found = of_file.agg(F.count("*").alias("n"), F.max("last").alias("last"), whole.alias("whole")).first()
    except Exception:  # no such column in this source: the caller writes the rows
        return None
    if not found["n"]:
        return F.lit(0).cast("long")
    bits = 2 * int(found["n"]).bit_length() + 2
    if not found["whole"] or bits >= 62 or found["last"] >> 63 - bits:
        return None
    hashed = lambda seed, path: F.xxhash64(F.lit(seed), path).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    kinds = of_file.agg(*(F.count_distinct(hashed(seed, F.col("path"))).alias(f"s{seed}") for seed in seeds)).first()
    good = [seed for seed in seeds if kinds[f"s{seed}"] == found["n"]]
    if not good:
        return None
    return F.shiftleft(hashed(good[0], place["file_path"]), 63 - bits).bitwiseOR(place["row_index"])


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """(``df`` with a unique number for each row, its column), so that rows with equal ids or none can be told apart.  A plain read of
    Parquet files is left where it is; anything else is written first, since its rows may come in another order next time."""
    name = fresh(df.columns, "row_number")
    number = file_rows(df)
    if number is not None:
        return df.withColumn(name, number), name
    return saved(df.withColumn(name, F.monotonically_increasing_id()), "numbered", outlives=True), name


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file as Spark names it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, stem: str, suffix: str):
    """(uri, output stream) of a file whose name no other attempt uses."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    system, path = filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, system.open_output_stream(path)


def read_bytes(uri: str) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_stream(path) as f:
        return f.read()
