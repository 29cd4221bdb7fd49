"""Dense row numbers and windows over one global order, without a single-task sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_folder

# monotonically_increasing_id puts the partition number above this bit.
_PARTITION_SHIFT = 33
# Windows a block is long: one row in so many is there twice.
BLOCK_SIZES = 16


def with_dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``order`` (which must tell all rows apart).

    Rows are range-partitioned, sorted and written with their place, so that both uses below
    see the same partitions; keep only columns that are used later. A row's number is its place in its
    partition plus the rows of the partitions before it; that running sum covers one row per partition.
    """
    path = new_folder(df.sparkSession, "ordered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "__id", F.monotonically_increasing_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    part = F.shiftright("__id", _PARTITION_SHIFT)
    placed = ranged.withColumn("__part", part).withColumn(
        "__place", F.col("__id") - F.shiftleft("__part", _PARTITION_SHIFT)
    )
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start")
    )
    # One row per partition of the range shuffle: a few thousand at most.
    return (
        placed.join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__start") + F.col("__place"))
        .drop("__id", "__part", "__place", "__start")
    )


def rolling_sums(
    indexed: DataFrame, size: int, sums: dict[str, Column], idx: str = "idx", by: list[str] | None = None
) -> DataFrame:
    """Sum each expression over the last ``size`` rows up to and including the row.

    ``idx`` must be dense, within each group of ``by`` if given. Rows are cut into blocks of ``BLOCK_SIZES`` times ``size``; the last
    ``size`` rows of a block also visit the next one, which then holds every window that ends in it.
    The sum is a running total minus the running total ``size`` rows earlier.
    """
    length = size * BLOCK_SIZES
    block = F.floor(F.col(idx) / length)
    visits = F.when(F.col(idx) % length >= length - size, F.array(block, block + 1)).otherwise(F.array(block))
    rows = indexed.select("*", *[c.alias(f"__{k}") for k, c in sums.items()]).withColumn(
        "__block", F.explode(visits)
    )
    in_order = Window.partitionBy(*(by or []), "__block").orderBy(idx)
    up_to_here = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.select(
        *indexed.columns, "__block", *[F.sum(f"__{k}").over(up_to_here).alias(k) for k in sums]
    )
    rolled = totals.select(
        *indexed.columns, "__block",
        *[(F.col(k) - F.coalesce(F.lag(k, size).over(in_order), F.lit(0))).alias(k) for k in sums],
    )
    return rolled.where(F.col("__block") == block).drop("__block")


def every_k(
    indexed: DataFrame, k: int, aggregate: Callable[[DataFrame, list[str]], DataFrame],
    idx: str = "idx",
) -> DataFrame:
    """One report per ``k`` consecutive rows; ``aggregate`` gets the rows and the group column."""
    return aggregate(indexed.withColumn("report", F.floor(F.col(idx) / k)), ["report"])
