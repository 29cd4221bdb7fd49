"""Reading and writing click logs as CSV and hour-partitioned Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.times import day_range

# The columns of the public click log, in file order.
LABELLED_COLUMNS = [
    "id", "click", "hour", "C1", "banner_pos", "site_id", "site_domain", "site_category",
    "app_id", "app_domain", "app_category", "device_id", "device_ip", "device_model",
    "device_type", "device_conn_type", "C14", "C15", "C16", "C17", "C18", "C19", "C20", "C21",
]
UNLABELLED_COLUMNS = [c for c in LABELLED_COLUMNS if c != "click"]


def log_schema(labelled: bool = True) -> StructType:
    names = LABELLED_COLUMNS if labelled else UNLABELLED_COLUMNS
    return StructType([StructField(n, StringType()) for n in names])


def read_log_csv(
    spark: SparkSession, path: str, labelled: bool = True, partitions: int | None = None
) -> DataFrame:
    """A header CSV, plain or gzipped, as strings with ``click`` and ``split``.

    A gzip file is read by one task, so ask for ``partitions`` to spread what follows.
    Unlabelled rows get a null click and are told apart by ``split``.
    """
    df = spark.read.schema(log_schema(labelled)).csv(path, header=True)
    if not labelled:
        df = df.withColumn("click", F.lit(None).cast("string"))
    df = df.select(*LABELLED_COLUMNS, F.lit("train" if labelled else "score").alias("split"))
    return df.repartition(partitions) if partitions else df


def spread_out(scan: DataFrame, row_id: str) -> DataFrame:
    """Deal the rows of a scan of fewer splits than there are cores, by a hash of their id.

    One gzip file, or a Parquet file of one row group (of whose splits one has all rows), is one task, and so would
    be all that follows it up to the first shuffle. A scan of more splits is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, row_id)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def read_hour(spark: SparkSession, path: str, hour: int | str) -> DataFrame:
    """One hour partition; the ``hour`` column stays and other partitions are not listed for data."""
    return spark.read.parquet(path).where(F.col("hour") == int(hour))


def read_day(spark: SparkSession, path: str, day: int | str) -> DataFrame:
    return spark.read.parquet(path).where(day_range(day))


def local_rows(spark: SparkSession, rows: list, schema: str | StructType) -> DataFrame:
    """A small local sequence as a DataFrame."""
    return spark.createDataFrame(rows, schema)


def union_aligned(tables: list[DataFrame]) -> DataFrame:
    """All tables under each other, matched by column name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_by_hour(df: DataFrame, path: str, partition: str = "hour", mode: str = "errorifexists"):
    """Hour-partitioned Parquet, one file per ordinary hour.

    The rebalance hint brings an hour's rows together and lets Spark split an hour that is
    too large for one task.
    """
    df.hint("rebalance", partition).write.mode(mode).partitionBy(partition).parquet(path)


def replace_hours(df: DataFrame, path: str, partition: str = "hour") -> None:
    """Add the hours of ``df`` to a table; an hour that is there already is replaced.

    A rerun therefore does not duplicate rows.
    """
    (
        df.hint("rebalance", partition).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    )
