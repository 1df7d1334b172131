"""Incremental runs: what has arrived in a folder since the last run is processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, form: str = "parquet", max_files: int = 1000) -> DataFrame:
    """Reads all new files of `source` in batches of `max_files`, writes transform(rows) to `out`, and ends; the table so far.

    The checkpoint takes the place of a log of finished files: a run that was broken off goes on where it stopped, and no file counts twice."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(form).load(source)
    result = transform(rows)
    result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def run_batches(spark: SparkSession, source: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, form: str = "parquet", max_files: int = 1000) -> None:
    """The same with a function of each batch and its number, for flat tables by name."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(form).load(source)
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
