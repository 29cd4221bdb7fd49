"""Streaming sources; each yields text in a ``value`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_text(
    spark: SparkSession, servers: str, topics: list[str], starting: str = "latest", **options
) -> DataFrame:
    """(value, example_id, seq) of Kafka records. Needs the Kafka connector on the class path.

    Topic, partition and offset make the id. Offsets are kept in the query's checkpoint,
    not committed to Kafka.
    """
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", starting)
    )
    return reader.options(**options).load().select(
        F.col("value").cast("string").alias("value"),
        F.concat_ws("-", "topic", "partition", "offset").alias("example_id"),
        F.col("offset").alias("seq"),
    )


def socket_text(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_text(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def file_parquet(
    spark: SparkSession, folder: str, name: str = "*", files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; ``name`` selects files by pattern."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)
