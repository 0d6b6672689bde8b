"""Applying fitted (stateless) models to a Structured Streaming source.

Every fitted ``Model`` of the library is a projection plus joins with small static
fitted tables, so the same ``transform`` works on a streaming DataFrame: rows arriving
later are encoded with the statistics fitted on the batch training data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tabspark.operators.base import Model


def stream_table(spark: SparkSession, folder: str, name: str, max_files_per_trigger: int = 1) -> DataFrame:
    """A parquet table of ``folder``, one file or a directory of part files, as a file stream
    (schema taken from the batch read)."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # the glob matches the table itself, file or directory, so either is read as the stream's input
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(f"{folder.rstrip('/')}/{name}.parque[t]")


def apply_models(df: DataFrame, models: Sequence[Model]) -> DataFrame:
    for m in models:
        df = m.transform(df)
    return df


def run_available(stream: DataFrame, sink_path: str, checkpoint_path: str, timeout_s: float | None = None) -> DataFrame:
    """Process everything available now into a parquet sink (exactly-once via the checkpoint), then
    return the sink as a batch DataFrame.  A stream runs as long as it takes unless ``timeout_s`` is given."""
    q = (stream.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint_path)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination() if timeout_s is None else q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return stream.sparkSession.read.parquet(sink_path)
