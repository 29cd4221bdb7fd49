"""Leaving out rare features: by total count, from the k-th sighting on, or by a sketch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .counts import count_by
from .skew import attach, attach_counted


def keep_frequent(
    rows: DataFrame, at_least: int, spread: list[str], feature: str = "feature", **heavy
) -> DataFrame:
    """Rows of features that occur at least ``at_least`` times in all of ``rows``."""
    counts = frequent_counts(rows, at_least, feature)
    return attach_counted(rows, counts.select(feature), [feature], spread, counts, **heavy)


def frequent_counts(rows: DataFrame, at_least: int, feature: str) -> DataFrame:
    """(feature, n) of those that occur at least ``at_least`` times, stored."""
    known = rows.where(F.col(feature).isNotNull())
    return stored(count_by(known, [feature]).where(F.col("n") >= at_least), "frequent")


def keep_after_sightings(
    rows: DataFrame, at_least: int, order: list[str], feature: str = "feature", **heavy
) -> DataFrame:
    """Rows from each feature's ``at_least``-th sighting on, in ``order``.

    Only the k-th sighting is looked for. Spark cuts each task's share to k rows per
    feature before the shuffle, so a feature with most of the rows costs no more than
    another. The rows are then compared with the place of their feature's k-th sighting.
    """
    kth = kth_sighting(rows.where(F.col(feature).isNotNull()), at_least, order, feature)
    seen = attach_counted(rows, kth, [feature], order, frequent_counts(rows, at_least, feature), **heavy)
    return seen.where(F.struct(*order) >= F.col("__from")).drop("__from")


def kth_sighting(rows: DataFrame, k: int, order: list[str], feature: str) -> DataFrame:
    """(feature, __from): the place in ``order`` of each feature's k-th row."""
    by_feature = Window.partitionBy(feature).orderBy(*order)
    ranked = rows.select(feature, *order).withColumn("__rank", F.row_number().over(by_feature))
    return ranked.where(F.col("__rank") == k).select(feature, F.struct(*order).alias("__from"))


def thin_examples(examples: DataFrame, at_least: int, progressive: bool = True, **heavy) -> DataFrame:
    """Examples (example_id, seq, label, features, ...) without the rare features of the batch.

    A feature stays from its ``at_least``-th sighting on, or, if not ``progressive``,
    wherever it has that many sightings in the whole batch. An example keeps its row when
    all its features go.
    """
    others = [c for c in examples.columns if c != "features"]
    rows = examples.select(*others, F.explode_outer("features").alias("feature", "value"))
    known = rows.where(F.col("feature").isNotNull())
    if progressive:
        kept = kth_sighting(known, at_least, ["seq", "example_id"], "feature")
        stays = F.struct("seq", "example_id") >= F.col("__from")
    else:
        kept = count_by(known, ["feature"]).where(F.col("n") >= at_least).select("feature", "n")
        stays = F.col("n").isNotNull()
    marked = attach(rows, kept, ["feature"], ["example_id"], **heavy)
    # The list holds at most what the example's own row held before.
    entry = F.when(stays, F.struct("feature", "value"))
    return marked.groupBy(*others).agg(F.map_from_entries(F.collect_list(entry)).alias("features"))


def hash_pair(feature: Column) -> tuple[Column, Column]:
    return F.xxhash64(feature), F.xxhash64(feature, F.lit(1))


def sketch_size(total: int, over: float, miss: float = 0.01) -> tuple[int, int]:
    """(depth, width) of a count-min sketch of ``total`` sightings whose counts exceed the
    true ones by more than ``over`` with a probability of at most ``miss``."""
    return max(1, math.ceil(math.log(1 / miss))), max(1, math.ceil(math.e * total / over))


def _cells(features: DataFrame, feature: str, depth: int, width: int, hashes) -> DataFrame:
    """``features`` with a row per ``cell`` that the feature falls in, one in each of ``depth`` rows.

    All rows of the sketch derive from two hashes: the i-th is the first plus i times the second.
    """
    wide = F.lit(width).cast("bigint")
    first, second = hashes(F.col(feature))
    hashed = features.withColumn("__h1", F.pmod(first, wide)).withColumn("__h2", F.pmod(second, wide))
    row = F.explode_outer(F.sequence(F.lit(0).cast("bigint"), F.lit(depth - 1).cast("bigint")))
    cell = F.col("__row") * wide + (F.col("__h1") + F.col("__h2") * F.col("__row")) % wide
    return hashed.withColumn("__row", row).withColumn("cell", cell).drop("__h1", "__h2", "__row")


def count_min_table(
    rows: DataFrame, feature: str, depth: int, width: int, hashes=hash_pair
) -> DataFrame:
    """(cell, n): a count-min sketch of at most ``depth * width`` rows. Sightings are added up
    per feature before they reach the cells."""
    counts = count_by(rows.where(F.col(feature).isNotNull()), [feature], "__n")
    return _cells(counts, feature, depth, width, hashes).groupBy("cell").agg(F.sum("__n").alias("n"))


def count_min_estimate(
    features: DataFrame, table: DataFrame, feature: str, depth: int, width: int, hashes=hash_pair,
    name: str = "estimate",
) -> DataFrame:
    """(feature, estimate) of distinct features: the sketch's count, never below the true one.

    The sketch is joined as the table it is, whatever its size.
    """
    cells = _cells(features.select(feature).where(F.col(feature).isNotNull()).distinct(), feature, depth, width, hashes)
    return cells.join(table, "cell", "left").groupBy(feature).agg(F.min(F.coalesce("n", F.lit(0))).alias(name))


def keep_frequent_approx(
    rows: DataFrame, at_least: int, spread: list[str], feature: str = "feature",
    over: float | None = None, miss: float = 0.01, hashes=hash_pair, **heavy,
) -> DataFrame:
    """Rows whose feature's sketch count reaches ``at_least``.

    No frequent feature goes; a rarer one stays with a probability of at most ``miss`` if it is
    ``over`` (half of ``at_least`` by default) sightings short. The sketch grows with the rows.
    """
    total = rows.where(F.col(feature).isNotNull()).count()
    depth, width = sketch_size(total, at_least / 2 if over is None else over, miss)
    table = count_min_table(rows, feature, depth, width, hashes)
    estimated = count_min_estimate(rows, table, feature, depth, width, hashes, "__estimate")
    frequent = stored(estimated.where(F.col("__estimate") >= at_least).withColumnRenamed("__estimate", "n"), "frequent")
    return attach_counted(rows, frequent.select(feature), [feature], spread, frequent, **heavy)
