"""Model state as a table: one row per feature, optionally per further model keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logistic import counted_n

# w: published weight; z, n: FTRL sums; p_count, n_count: labelled sightings;
# g_sum: summed gradient, kept for reports only.
STATE_COLUMNS = ["w", "z", "n", "p_count", "n_count", "g_sum"]


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)).alias(name)


def empty_state(spark: SparkSession, keys: dict[str, str] | None = None) -> DataFrame:
    """A state without rows; ``keys`` names further key columns and their types."""
    fields = [f"{k} {t}" for k, t in (keys or {}).items()]
    fields += ["feature bigint", *[f"{c} double" for c in STATE_COLUMNS]]
    return spark.createDataFrame([], ", ".join(fields))


def seeded_state(given: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A starting state from any of the state columns; the others start at zero.

    Without ``n`` the squared-gradient sum is seeded from the label counts, if given.
    """
    keys = keys or []
    have = set(given.columns)
    filled = given.select(
        *keys, "feature",
        *[_or_zero(c) if c in have else F.lit(0.0).alias(c) for c in STATE_COLUMNS],
    )
    if "n" not in have:
        filled = filled.withColumn("n", counted_n(F.col("p_count"), F.col("n_count")))
    return filled


def upsert(state: DataFrame, update: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of ``update`` replace rows of ``state``; a weight updated to zero stays zero."""
    on = [*(keys or []), "feature"]
    columns = [c for c in state.columns if c not in on]
    fresh = update.select(*on, F.struct(*columns).alias("__new"))
    old = state.select(*on, F.struct(*columns).alias("__old"))
    return old.join(fresh, on, "full_outer").select(
        *on, *[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c)
               for c in columns]
    )


def label_counts(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(feature, p_count, n_count): examples with label 1 and 0 that show the feature."""
    label = F.col("label").cast("double")
    return rows.where(F.col("feature").isNotNull()).groupBy(*(keys or []), "feature").agg(
        F.sum(label).alias("p_count"), F.sum(1.0 - label).alias("n_count")
    )


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add two count tables, each column to its own."""
    on = [*(keys or []), "feature"]
    both = old.select(*on, "p_count", "n_count").unionByName(new.select(*on, "p_count", "n_count"))
    return both.groupBy(*on).agg(
        F.sum("p_count").alias("p_count"), F.sum("n_count").alias("n_count")
    )


def average_shards(state: DataFrame, trained: DataFrame, shards: int) -> DataFrame:
    """Merge per-shard results (shard, feature, w, z, p_new, n_new, g_new) into the state.

    w and z are averaged, label counts added. A shard that did not see a feature still
    holds the state's old value and counts with it; a feature new to the state is
    averaged over the shards that saw it.
    """
    summed = trained.groupBy("feature").agg(
        F.sum("w").alias("__w"), F.sum("z").alias("__z"), F.count(F.lit(1)).alias("__seen"),
        F.sum("p_new").alias("__p"), F.sum("n_new").alias("__n"), F.sum("g_new").alias("__g"),
    )
    old = state.select("feature", *STATE_COLUMNS, F.lit(True).alias("__known"))
    known = F.col("__known").isNotNull()
    seen = F.coalesce("__seen", F.lit(0))
    holders = F.when(known, F.lit(shards)).otherwise(seen)

    def mean(column: str, total: str) -> Column:
        kept = F.coalesce(F.col(column), F.lit(0.0)) * F.when(known, F.lit(shards) - seen).otherwise(0)
        return ((F.coalesce(F.col(total), F.lit(0.0)) + kept) / holders).alias(column)

    def added(column: str, more: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0.0)) + F.coalesce(F.col(more), F.lit(0.0))

    p, n = added("p_count", "__p"), added("n_count", "__n")
    return old.join(summed, "feature", "full_outer").select(
        "feature", mean("w", "__w"), mean("z", "__z"),
        F.when(seen > 0, counted_n(p, n)).otherwise(F.col("n")).alias("n"),
        p.alias("p_count"), n.alias("n_count"), added("g_sum", "__g").alias("g_sum"),
    )


def published(state: DataFrame) -> DataFrame:
    """The model as scored with: features of non-zero weight."""
    return state.where(F.col("w") != 0.0).select(
        *[c for c in state.columns if c not in STATE_COLUMNS], "w"
    )


def weight_of(state: DataFrame, features: list[int]) -> DataFrame:
    return state.where(F.col("feature").isin(features)).select("feature", "w")


def nonzero_count(state: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return state.groupBy(*(keys or [])).agg(
        F.count_if(F.col("w") != 0.0).alias("nonzero")
    )
