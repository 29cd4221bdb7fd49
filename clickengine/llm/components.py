"""Connected components of a table of links, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder


# An intermediate table is written by a quarter of the shuffle's partitions, or by so many tasks per core
# where that is more. Many small files cost more than they hold.
FILES_PER_CORE = 8


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there.

    A task writes several partitions of the shuffle before it, one after another, into one file.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    cores = spark.sparkContext.defaultParallelism
    tasks = max(FILES_PER_CORE * cores, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    df.coalesce(tasks).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its smallest node.

    Each round gives a node the smallest label among its neighbours and then that label's own
    label, until nothing changes. Rows are only ever grouped by node.
    """
    both = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where(F.col("a") != F.col("b")).distinct(), "links",
    )
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(
            F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("component").alias("further"))
        step = stored(step.join(jump, "m").select("node", "old", F.least("m", "further").alias("component")), "labels")
        changed = step.where(F.col("old") != F.col("component")).limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
