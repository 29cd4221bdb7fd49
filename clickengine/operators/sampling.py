"""Row samples and fixed shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import text_hash

_STEPS = 1_000_000


def bernoulli(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Each row with probability ``fraction``; the rows drawn depend on the partitioning."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def by_hash(df: DataFrame, key_hash: Column, fraction: float) -> DataFrame:
    """Rows whose key hash falls in the first ``fraction`` of the range: the same every time."""
    limit = int(round(fraction * _STEPS))
    return df.where(F.pmod(key_hash, F.lit(_STEPS).cast("bigint")) < limit)


def with_shard(
    df: DataFrame, key: str, shards: int, name: str = "shard", method: str = "xxhash64"
) -> DataFrame:
    """A shard number per row that depends on the row's key alone."""
    number = F.xxhash64(key) if method == "xxhash64" else text_hash(F.col(key).cast("string"), method)
    return df.withColumn(name, F.pmod(number, F.lit(shards).cast("bigint")).cast("int"))
