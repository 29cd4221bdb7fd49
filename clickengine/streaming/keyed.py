"""One running model per key, kept in a versioned state table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.logistic import FtrlConfig
from ..operators.inorder import EXACT
from ..operators.sampling import with_shard
from ..operators.shards import train_in_order
from ..operators.skew import attach
from ..operators.state import empty_state, upsert
from ..sources.store import StateStore
from .trainer import triggered


def keyed_step(
    state: DataFrame, examples: DataFrame, key: str, config: FtrlConfig, shards: int,
    key_type: str = "string", method: str = "xxhash64", stored: bool = False,
) -> DataFrame:
    """The state (shard, key, feature, ...) after each key's models learned their examples.

    A key's rows are dealt over ``shards`` models, as one key may hold most of the stream, and
    each is folded one after another in order of ``seq``. The state is rows, so neither a
    key's features nor its examples have to fit one place.
    """
    rows = with_shard(examples, "example_id", shards, method=method)
    learned = train_in_order(
        state, rows, config, {"shard": "int", key: key_type}, shards, ["shard", key], EXACT, stored)
    old = state.select("shard", key, "feature", F.col("p_count").alias("__p"), F.col("n_count").alias("__m"),
                       F.col("g_sum").alias("__g"))
    grown = learned.join(old, ["shard", key, "feature"], "left").select(
        "shard", key, "feature", "w", "z", "n",
        (F.coalesce("__p", F.lit(0.0)) + F.col("p_new")).alias("p_count"),
        (F.coalesce("__m", F.lit(0.0)) + F.col("n_new")).alias("n_count"),
        (F.coalesce("__g", F.lit(0.0)) + F.col("g_new")).alias("g_sum"),
    )
    return upsert(state, grown, ["shard", key])


def start_keyed_trainer(
    examples: DataFrame, key: str, store: StateStore, config: FtrlConfig, checkpoint: str,
    shards: int = 8, key_type: str = "string", method: str = "xxhash64", seconds: float | None = 1,
) -> StreamingQuery:
    """Learn from each micro-batch of (``key``, seq, example_id, label, features).

    The state after the batch and the examples of each key in it are stored as a new version; a
    batch that Spark delivers again changes nothing.
    """

    def learn(batch: DataFrame, batch_id: int) -> None:
        if store.learned(checkpoint, str(batch_id)):
            return
        before = store.latest()
        version = (before or 0) + 1
        first = empty_state(store.spark, {"shard": "int", key: key_type})
        state = store.load(before) if before is not None else first
        batch = batch.persist()
        try:
            store.save_metrics(version, batch.groupBy(key).agg(F.count(F.lit(1)).alias("steps")))
            after = keyed_step(state, batch, key, config, shards, key_type, method, stored=before is not None)
            store.save(version, after, checkpoint, str(batch_id), shards=shards)
        finally:
            batch.unpersist()

    writer = examples.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint)
    return triggered(writer, seconds).start()


def merged_models(state: DataFrame, key: str) -> DataFrame:
    """(key, feature, w): the weights of a key's shards, averaged per feature over those that met it."""
    return state.groupBy(key, "feature").agg(F.avg("w").alias("w"))


def model_steps(store: StateStore, key: str) -> DataFrame:
    """(key, steps): examples learned from so far."""
    return store.metrics().groupBy(key).agg(F.sum("steps").alias("steps"))


def published(store: StateStore, key: str) -> DataFrame:
    """(key, feature, w, steps): what a batch publishes."""
    return attach(merged_models(store.load(), key), model_steps(store, key), [key], ["feature"], "inner")
