"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is heavy when it holds more than HEAVY_ROWS rows and more than HEAVY_SHARE of
# all rows. The share bounds the number of heavy keys by 1 / HEAVY_SHARE at any data
# size, which is what makes the list of them safe to broadcast.
HEAVY_ROWS = 1_000_000
HEAVY_SHARE = 0.0001
# Keys are counted on one row in SAMPLE_EVERY, told by a hash of the row's id, so both
# sides of the join see the same heavy keys. Which keys are sliced changes no result.
SAMPLE_EVERY = 64
# A stored lookup is broadcast up to this many rows and this many bytes of text.
BROADCAST_ROWS = 500_000
BROADCAST_TEXT = 32 << 20


def heavy_keys(
    counts: DataFrame, on: list[str], n: str = "n", heavy_rows: int = HEAVY_ROWS,
    heavy_share: float = HEAVY_SHARE, scale: int = 1,
) -> DataFrame:
    """Heavy keys of a (keys, n) table with the number of slices each is to be cut into.

    ``scale`` is how many rows each counted row stands for.
    """
    total = counts.agg(F.sum(n))
    rows = F.col(n) * F.lit(scale)
    return counts.where(
        (rows > F.lit(heavy_rows)) & (F.col(n) > total.scalar() * F.lit(heavy_share))
    ).select(*on, F.ceil(rows / F.lit(heavy_rows)).cast("bigint").alias("__slices"))


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread: list[str | Column],
    how: str = "left",
    counts: DataFrame | None = None,
    heavy_rows: int = HEAVY_ROWS,
    heavy_share: float = HEAVY_SHARE,
    sample_every: int = SAMPLE_EVERY,
) -> DataFrame:
    """Join ``lookup`` (one row per key) to ``rows``, cutting heavy keys into slices.

    Rows of a heavy key are dealt over its slices by a hash of ``spread`` (columns that
    tell rows apart, so a recomputed task deals them alike), and the one lookup row of
    that key is repeated per slice. Other keys keep a single slice. ``counts`` may hand
    in (keys, n) when the number of rows per key is already known; otherwise keys are
    counted on a sample, which reads the rows' source again but little else.
    """
    deal = F.xxhash64(*spread)
    scale = 1
    # Keys are cleared of nulls up front, as the join would do, so that the counts and
    # their total come out as one plan and Spark computes them once.
    if counts is None:
        some = rows.where(F.pmod(deal, F.lit(sample_every).cast("bigint")) == 0)
        counts = some.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
        scale = sample_every
    else:
        counts = counts.dropna(subset=on)
    heavy = F.broadcast(heavy_keys(counts, on, "n", heavy_rows, heavy_share, scale))
    null_key = F.lit(False)
    for key in on:
        null_key = null_key | F.col(key).isNull()
    # A null key never matches, so its rows may go anywhere. Slices are dealt by another
    # hash than the sample.
    dealt = F.xxhash64(deal, F.lit(1))
    slice_no = F.when(null_key, dealt).otherwise(
        F.pmod(dealt, F.coalesce("__slices", F.lit(1).cast("bigint")))
    )
    left = rows.join(heavy, on, "left").withColumn("__slice", slice_no).drop("__slices")
    last = F.coalesce("__slices", F.lit(1).cast("bigint")) - F.lit(1).cast("bigint")
    right = (
        lookup.join(heavy, on, "left")
        .withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .drop("__slices")
    )
    return left.join(right, [*on, "__slice"], how).drop("__slice")


def fits_broadcast(lookup: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Measure a stored table: few enough rows, and little enough text in them."""
    texts = [F.octet_length(f.name) for f in lookup.schema.fields if f.dataType.typeName() == "string"]
    text = sum((F.coalesce(F.sum(t), F.lit(0)) for t in texts), F.lit(0))
    rows, size = lookup.agg(F.count(F.lit(1)), text).first()
    return rows <= max_rows and size <= BROADCAST_TEXT


def attach_stored(
    rows: DataFrame, lookup: DataFrame, on: list[str], spread: list[str | Column],
    how: str = "left", max_rows: int = BROADCAST_ROWS, **heavy,
) -> DataFrame:
    """``attach`` for a lookup that lies in storage and is therefore cheap to measure.

    While the lookup is small the rows are not shuffled at all; beyond that, ``attach``.
    """
    if fits_broadcast(lookup, max_rows):
        return rows.join(F.broadcast(lookup), on, how)
    return attach(rows, lookup, on, spread, how, **heavy)


def attach_counted(
    rows: DataFrame, lookup: DataFrame, on: list[str], spread: list[str | Column], counts: DataFrame,
    max_rows: int = BROADCAST_ROWS, max_text: int = BROADCAST_TEXT, **heavy,
) -> DataFrame:
    """Inner ``attach`` for a lookup whose keys lie in storage with their numbers of rows, as ``counts`` (keys, n).

    Of a larger lookup the keys with the most rows are broadcast, as many as ``max_rows`` and ``max_text`` allow, so
    that only the rows of the others are shuffled.
    """
    texts = [F.octet_length(c) for c in on if counts.schema[c].dataType.typeName() == "string"]
    text = sum((F.sum(F.coalesce(t, F.lit(0))) for t in texts), F.lit(0))
    # A line per power of two, so that the driver sees some sixty.
    by_size = counts.groupBy(F.floor(F.log2(F.col("n"))).alias("power")).agg(F.count(F.lit(1)), text)
    sizes = sorted(by_size.collect(), reverse=True)
    least, keys, size = None, 0, 0
    for power, many, letters in sizes:
        keys, size = keys + many, size + letters
        if keys > max_rows or size > max_text:
            break
        least = power
    else:
        return rows.join(F.broadcast(lookup), on)
    common = F.floor(F.log2(F.col("n"))) >= F.lit(least)
    often = counts.where(common).select(*on) if least is not None else counts.limit(0).select(*on)
    others = counts.where(~common) if least is not None else counts
    near = rows.join(F.broadcast(lookup.join(F.broadcast(often), on)), on)
    rest = rows.join(F.broadcast(often), on, "left_anti")
    far = attach(rest, lookup.join(F.broadcast(often), on, "left_anti"), on, spread, "inner", counts=others, **heavy)
    return near.unionByName(far.select(near.columns))
