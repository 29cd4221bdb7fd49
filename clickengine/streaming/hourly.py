"""Counts per key and hour kept up to date from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.counts import hour_counts
from .trainer import triggered


def start_hour_increments(
    events: DataFrame, keys: list[str], ts: str, path: str, checkpoint: str,
    seconds: float | None = 5,
) -> StreamingQuery:
    """Count each micro-batch on its own and write it under ``path/batch=<id>``.

    Needs no state and loses no late row: the counts of an hour are the sum over the
    batches that saw it. A batch that comes again replaces its own folder.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        timed = batch.withColumn(ts, F.col(ts).cast("timestamp"))
        hour_counts(timed, keys, ts).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return triggered(writer, seconds).start()


def read_hour_increments(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, window_start, window_end, n) summed over batches."""
    return spark.read.parquet(path).groupBy(*keys, "window_start", "window_end").agg(
        F.sum("n").alias("n")
    )


def windowed_counts(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Streaming (keys, window_start, window_end, n) with running totals.

    Spark holds the open windows as state and closes a window once the stream has moved
    ``late`` past it; a row that comes later than that is not counted.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return hour_counts(timed, keys, ts)


def start_windowed_counts(
    counts: DataFrame, path: str, checkpoint: str, seconds: float | None = 5
) -> StreamingQuery:
    """Write the totals that each batch changed under ``path/batch=<id>``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = (
        counts.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint)
    )
    return triggered(writer, seconds).start()


def read_windowed_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, window_start, window_end, n): the last total written for each."""
    return spark.read.parquet(path).groupBy(*keys, "window_start", "window_end").agg(
        F.max_by("n", "batch").alias("n")
    )


def previous_hour_lookup(counts: DataFrame, keys: list[str], ts: str, name: str) -> DataFrame:
    """Counts keyed by the hour after, to be joined to that hour's rows."""
    return counts.select(*keys, F.col("window_end").alias(ts), F.col("n").alias(name))
