"""The operation log as a stream: debounced edits, windowed counts, and a log that each batch is added to once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.sources.staging import Files


def timed(events: DataFrame) -> DataFrame:
    """The event time as a TIMESTAMP, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def debounced(edits: DataFrame, key: str, value: str, order: str, quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Of edits that follow each other within the quiet time, the last is written. Rows (key, start, end, value, edits).

    Works on a batch and, in append mode, on a stream; an edit exactly the quiet time after another joins it.
    """
    kept = edits.withWatermark("ts", late) if edits.isStreaming else edits
    return (
        kept.groupBy(key, F.session_window("ts", quiet).alias("w"))
        .agg(F.max_by(value, F.struct("ts", order)).alias(value), F.count("*").alias("edits"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), value, "edits")
    )


def window_counts(events: DataFrame, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value for each kind and window."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def appended(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: adds a batch to a log, in a folder of its own.

    A batch is written aside and gets its folder by one rename, so it is in the log whole or not at all; one whose folder is there
    is a replay after a failure, and is passed over. A batch of no rows has a folder, too.
    """

    def add(batch: DataFrame, number: int) -> None:
        files = Files(batch.sparkSession, folder)
        name = f"batch={number:012d}"
        if files.exists(name):
            return
        aside = f"_aside/{name}"
        files.delete(aside)  # of an attempt that broke off
        batch.write.parquet(f"{folder}/{aside}")
        files.move(aside, name)

    return add


def logged(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all batches of a log, with their batch."""
    if not any(n.startswith("batch=") for n in Files(spark, folder).names()):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(folder)
