"""Training over an ordered series of batches, with validation before each step."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logistic import FtrlConfig
from ..operators.metrics import evaluate
from ..operators.ordering import with_dense_index
from ..operators.sampling import by_hash
from ..operators.shards import shard_step
from ..operators.state import empty_state
from ..operators.steps import ftrl_step, margin_rows, scored_rows, step_from_rows, validate
from ..session import new_folder, remove_folder
from ..sources.store import StateStore

Step = Callable[[DataFrame, DataFrame, FtrlConfig], DataFrame]
# Tasks that write a batch; Spark may merge small ones.
FILES = 64


def minibatch(state: DataFrame, batch: DataFrame, config: FtrlConfig) -> DataFrame:
    """One exact step over the batch; the state comes from the store."""
    return ftrl_step(state, batch, config, stored=True)


def counted_minibatch(state: DataFrame, batch: DataFrame, config: FtrlConfig) -> DataFrame:
    """One step with the squared-gradient sums estimated from label counts."""
    return ftrl_step(state, batch, config, counted=True, stored=True)


# Steps that can start from the rows that validation has made, and whether they count.
FROM_ROWS = {minibatch: False, counted_minibatch: True}


def sharded(shards: int, method: str = "xxhash64") -> Step:
    """In-order training per shard, averaged. The model depends on the number of shards, which
    is therefore given, kept in ``meta``, and the same for any amount of data."""

    def step(state: DataFrame, batch: DataFrame, config: FtrlConfig) -> DataFrame:
        return shard_step(state, batch, config, shards, stored=True, method=method)

    step.settings = {"shards": shards}
    return step


def train_batch(
    store: StateStore, batch: DataFrame, config: FtrlConfig, step: Step = minibatch,
    sample_ratio: float = 1.0, start: DataFrame | None = None,
    source: str | None = None, batch_name: str | None = None,
) -> None:
    """Validate a batch with the last model, train on it, and store state and metrics.

    The new version is the one after the latest. A batch that the store has learned from
    already, told by its source and name, is left alone, so it may be delivered twice.
    Without a source a batch is always new.
    """
    if source is None:
        source = uuid.uuid4().hex
    before = store.latest()
    version = (before or 0) + 1
    batch_name = str(version) if batch_name is None else batch_name
    if store.learned(source, batch_name):
        return
    spark = batch.sparkSession
    state = store.slice_for(batch, before) if before is not None else start
    if state is None:
        state = empty_state(spark)
    # One join with the state serves validating and learning where the step allows it.
    shared = step in FROM_ROWS
    kept = (margin_rows(batch, state, config, stored=True) if shared else batch).persist()
    try:
        sample = kept if sample_ratio >= 1.0 else by_hash(kept, F.xxhash64("example_id"), sample_ratio)
        scored = scored_rows(sample) if shared else validate(sample, state, stored=True)
        metrics = evaluate(scored).withColumn("batch", F.lit(batch_name))
        store.save_metrics(version, metrics)
        after = step_from_rows(state, kept, config, FROM_ROWS[step]) if shared else step(state, kept, config)
        store.save_changes(version, state, after, source, batch_name, steps=version,
                           **{"shards": 0, **getattr(step, "settings", {})}, **asdict(config))
    finally:
        kept.unpersist()


def ordered_batches(
    examples: DataFrame, column: str, skip: int = 0, take: int | None = None
) -> list:
    """The values of the batch column in ascending order, one per training step to come."""
    values = [r[0] for r in examples.select(column).distinct().orderBy(column).collect()]
    return chosen(values, skip, take)


def chosen(values: list, skip: int = 0, take: int | None = None) -> list:
    """A negative ``skip`` leaves out the last batches, a negative ``take`` keeps the last."""
    values = values[skip:] if skip >= 0 else values[:skip]
    if take is None:
        return values
    return values[:take] if take >= 0 else values[take:]


def batches_of(examples: DataFrame, rows: int) -> DataFrame:
    """Add ``batch``: consecutive examples in order of ``seq``, ``rows`` to a batch."""
    indexed = with_dense_index(examples, ["seq", "example_id"], "__idx")
    return indexed.withColumn("batch", F.floor(F.col("__idx") / rows)).drop("__idx")


def train_series(
    store: StateStore, examples: DataFrame, column: str, config: FtrlConfig,
    step: Step = minibatch, batches: Iterable | None = None, sample_ratio: float = 1.0,
    start: DataFrame | None = None, thin: Callable[[DataFrame], DataFrame] | None = None,
    source: str | None = None, partitioned: bool = False,
) -> None:
    """One model version per value of ``column``, in order.

    Batches are told by ``source`` and value: a call with the source of an earlier one leaves out
    what was learned then and learns the rest. Without a source all batches are new. Each
    batch reads only its own rows: ``partitioned`` says that the examples come from a table
    partitioned by the column, others are first written so. ``thin`` may drop features of a batch.
    """
    source = uuid.uuid4().hex if source is None else source
    folder = None
    if not partitioned:
        spark = examples.sparkSession
        folder = new_folder(spark, "examples")
        examples.repartition(F.col(column), F.pmod(F.xxhash64("example_id"), F.lit(FILES))).write.partitionBy(
            column).parquet(folder)
        examples = spark.read.schema(examples.schema).parquet(folder)
    try:
        for value in ordered_batches(examples, column) if batches is None else batches:
            if store.learned(source, str(value)):
                continue
            batch = examples.where(F.col(column) == F.lit(value))
            if thin is not None:
                batch = thin(batch)
            train_batch(store, batch, config, step, sample_ratio, start, source, str(value))
    finally:
        if folder is not None:
            remove_folder(examples.sparkSession, folder)


def summary(store: StateStore) -> DataFrame:
    """Loss, accuracy, auc and size of the model per version."""
    steps = store.meta().select("version", "nonzero")
    return store.metrics().join(steps, "version").select(
        "version", "batch", "rows", "loss", "accuracy", "auc", "nonzero"
    )


def summary_line() -> Column:
    """The report of one batch as text. Fixed wording, as published reports read it."""
    return F.format_string(
        "loss : %.5f,  accuracy : %.5f,  AUC : %.5f,  Non-zero Coef : %d,  Sample Count : %d",
        "loss", "accuracy", "auc", "nonzero", "rows",
    )
