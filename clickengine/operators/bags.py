"""Per-key bags of items: as counts and as a signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag_runs(df: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, n): the whole bag, combined before the shuffle.

    A row per key and item, so a bag of any size has the same form.
    """
    return df.where(F.col(item).isNotNull()).groupBy(key, item).agg(F.count(F.lit(1)).alias("n"))


def bag_set(df: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item): the distinct items of each key."""
    return df.where(F.col(item).isNotNull()).select(key, item).distinct()


def set_signature(items: DataFrame, key: str, item_hash: Column, name: str = "bag_id") -> DataFrame:
    """One long per key that is equal for equal sets of (key, item).

    The exclusive or of the item hashes combines before the shuffle and needs constant
    room, so it can stand for the set of a key that holds any share of the data.
    """
    return items.groupBy(key).agg(F.bit_xor(item_hash).alias(name))
