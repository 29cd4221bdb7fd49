"""The whole way from log files to a score file, as jobs over stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logistic import FtrlConfig
from ..functions.times import day_range
from ..operators.frequency import thin_examples
from ..operators.sampling import by_hash
from ..operators.topics import with_default_topics
from ..session import scratch
from ..sources import logs
from ..sources.examples import write_scores
from ..sources.store import StateStore
from . import feature_sets as sets
from . import prepare
from .scoring import score
from .training import Step, batches_of, chosen, ordered_batches, sharded, train_series


@dataclass(frozen=True)
class Recipe:
    """How one kind of model is trained: features, rates, which hours, which rows."""

    features: Callable[..., Column]
    config: FtrlConfig
    sample: float = 0.3
    skip: int = 0  # leading hours, or trailing ones if negative
    take: int | None = None  # leading hours, or trailing ones if negative
    min_sightings: int | None = None


# The settings each kind of model is trained with.
RECIPES = {
    "topic": Recipe(sets.topic_features, FtrlConfig(alpha=10, beta=1, l1=5)),
    "rate": Recipe(sets.rate_features, FtrlConfig(alpha=5, beta=1, l1=4), skip=24),
    "count": Recipe(sets.count_features, FtrlConfig(alpha=5, beta=1, l1=2.5), skip=24),
    "bag": Recipe(sets.bag_features, FtrlConfig(alpha=5, beta=1, l1=1.5), skip=-24, take=-48,
                  min_sightings=10),
}
CATEGORY_CONFIG = FtrlConfig(alpha=10, beta=1, l1=2)
CATEGORY_ROWS = 1_000_000
SHARDS = 8


def ingest(spark: SparkSession, csv: str, path: str, labelled: bool = True,
           partitions: int | None = None) -> None:
    """A CSV log as Parquet by hour."""
    logs.write_by_hour(logs.read_log_csv(spark, csv, labelled, partitions), path)


def _logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    return prepare.clean_log([logs.read_table(spark, p) for p in paths])


def build_bag_table(spark: SparkSession, paths: list[str], out: str, **heavy) -> None:
    """Labelled and unlabelled logs together, with bags and lagged counts."""
    with scratch(spark):
        logs.replace_hours(prepare.prepare_log(_logs(spark, paths), **heavy), out)


def build_count_table(spark: SparkSession, paths: list[str], out: str, **heavy) -> None:
    """Logs with the counts of the previous day that has log."""
    with scratch(spark):
        logs.replace_hours(prepare.prepare_with_day_counts(_logs(spark, paths), **heavy), out)


def build_rate_table(spark: SparkSession, paths: list[str], out: str, **heavy) -> None:
    """Logs with past click rates."""
    with scratch(spark):
        logs.replace_hours(prepare.prepare_with_rates(_logs(spark, paths), **heavy), out)


def build_topic_tables(
    spark: SparkSession, paths: list[str], day: int | str, topics_out: str, out: str, **settings
) -> None:
    """User topics learned from one day, and the logs of users that have topics."""
    log = _logs(spark, paths)
    with scratch(spark):
        logs.write_table(prepare.user_topics(log.where(day_range(day)), **settings), topics_out, "overwrite")
    logs.replace_hours(prepare.prepare_with_topics(log, logs.read_table(spark, topics_out)), out)


def train_by_hour(
    spark: SparkSession, path: str, model: str, recipe: Recipe, step: Step = sharded(SHARDS),
    method: str = "xxhash64", keep: int | None = None,
) -> StateStore:
    """One model version per hour of a prepared table; hours learned before are left out.

    Hours are listed from the table's partitions, of which those without a labelled row at
    the end are not counted.
    """
    whole = logs.read_table(spark, path)
    table = whole.where(F.col("click").isNotNull())
    listed = ordered_batches(whole, "hour")
    while listed and table.where(F.col("hour") == F.lit(listed[-1])).isEmpty():
        listed.pop()
    hours = chosen(listed, recipe.skip, recipe.take)
    sampled = by_hash(table, F.xxhash64("id"), recipe.sample) if recipe.sample < 1 else table
    examples = sets.to_examples(sampled, recipe.features(method), carry=["hour"])
    k = recipe.min_sightings
    store = StateStore(spark, model, keep)
    train_series(store, examples, "hour", recipe.config, step, hours,
                 thin=None if k is None else lambda batch: thin_examples(batch, k),
                 source=path, partitioned=True)
    return store


def train_by_rows(
    spark: SparkSession, path: str, topics: str, model: str, config: FtrlConfig = CATEGORY_CONFIG,
    rows: int = CATEGORY_ROWS, step: Step = sharded(SHARDS), method: str = "xxhash64",
) -> StateStore:
    """One model version per ``rows`` rows of a log, in order of hour and id.

    Every call learns from all rows of the log it is given.
    """
    log = prepare.clean_log([logs.read_table(spark, path)])
    wide = with_default_topics(log, logs.read_table(spark, topics), ["id"])
    examples = sets.to_examples(wide, sets.category_features(method), carry=["hour"])
    ordered = examples.withColumn("seq", F.struct(F.col("hour").cast("int"), F.col("example_id")))
    store = StateStore(spark, model)
    with scratch(spark):
        train_series(store, batches_of(ordered, rows), "batch", config, step)
    return store


def score_day(
    spark: SparkSession, path: str, day: int | str, model: str, features: Callable[..., Column],
    out: str, header: bool = False, method: str = "xxhash64",
) -> None:
    """Score one day of a prepared table with the latest model and write the score file."""
    examples = sets.to_examples(logs.read_day(spark, path, day), features(method)).drop("label")
    state = StateStore(spark, model).load()
    write_scores(score(examples, state, stored=True), out, header)
