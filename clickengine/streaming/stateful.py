"""One running model per key, in Spark's own state store: a micro-batch touches its keys and features only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.logistic import FtrlConfig
from ..operators.inorder import EXACT, Models, Rule, counted
from ..operators.sampling import with_shard
from ..operators.skew import attach
from .trainer import triggered

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CELLS = "z double, n double, p double, m double"


class KeyedModel(StatefulProcessor):
    """The model of one (shard, key): a map of feature to cells, and the number of examples learned.

    Cells are fetched when a feature first comes up in a micro-batch and put back once at its end. The examples of one (shard, key) in
    one micro-batch are held to sort them by ``seq``; the rate of the source bounds them.
    """

    def __init__(self, config: FtrlConfig, rule: Rule, key_column: str) -> None:
        self.config, self.rule, self.key_column = config, rule, key_column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "feature bigint", _CELLS)
        self.learned = handle.getValueState("steps", "steps bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        examples = pd.concat(list(rows)).sort_values(["seq", "example_id"], kind="stable")
        before = self.learned.get()[0] if self.learned.exists() else 0
        models = Models([self.config], self.rule, before)
        known: dict[int, tuple] = {}
        for label, ids, values in zip(examples["label"], examples["ids"], examples["vals"]):
            start = np.zeros((4, 1, len(ids)))
            for k, f in enumerate(ids):
                f = int(f)
                if f not in known:
                    found = self.cells.getValue((f,))
                    known[f] = (0.0,) * 4 if found is None else tuple(found)
                start[:, 0, k] = known[f]
            if self.rule.from_counts:
                start[1] = counted(start[2], start[3])
            models.learn(models.slots(np.asarray(ids, np.int64), start), np.asarray(values, float), int(label))
        self.learned.update((models.steps,))
        out = models.rows()
        cells = models.cells[:4, 0, :len(models.slot)]
        for k, f in enumerate(models.slot):
            self.cells.updateValue((f,), tuple(float(x) for x in cells[:, k]))
        yield pd.DataFrame({
            "shard": key[0], self.key_column: key[1], "feature": out["feature"], "w": out["w"], "steps": models.steps})

    def close(self) -> None:
        pass


def keyed_updates(
    examples: DataFrame, key: str, config: FtrlConfig, shards: int = 8, key_type: str = "string", method: str = "xxhash64",
    rule: Rule = EXACT,
) -> DataFrame:
    """Streaming (shard, key, feature, w, steps) of every feature that a micro-batch changed.

    A key's rows are dealt over ``shards`` models, as one key may hold most of the stream.
    """
    use_state_store(examples.sparkSession)
    rows = with_shard(examples, "example_id", shards, method=method).select(
        "shard", F.col(key), "seq", "example_id", "label",
        F.map_keys("features").alias("ids"), F.map_values("features").alias("vals"))
    return rows.groupBy("shard", key).transformWithStateInPandas(
        KeyedModel(config, rule, key), f"shard int, {key} {key_type}, feature bigint, w double, steps bigint", "Update", "None")


def use_state_store(spark: SparkSession) -> None:
    """Map state needs the store that keeps its cells on disk, with changes only in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def start_state_store_trainer(
    examples: DataFrame, key: str, updates: str, config: FtrlConfig, checkpoint: str, shards: int = 8,
    key_type: str = "string", method: str = "xxhash64", seconds: float | None = 1,
) -> StreamingQuery:
    """Learn from each micro-batch of (``key``, seq, example_id, label, features) and write what it changed to ``updates``.

    A batch that Spark delivers again replaces its own folder.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={batch_id}")

    writer = keyed_updates(examples, key, config, shards, key_type, method).writeStream.outputMode("update").foreachBatch(publish)
    return triggered(writer.option("checkpointLocation", checkpoint), seconds).start()


def published(spark: SparkSession, updates: str, key: str) -> DataFrame:
    """(key, feature, w, steps): the newest weight of every shard's feature, averaged over the shards that met it."""
    rows = spark.read.parquet(updates)
    newest = rows.groupBy("shard", key, "feature").agg(F.max_by("w", "batch").alias("w"))
    steps = rows.groupBy("shard", key).agg(F.max("steps").alias("steps")).groupBy(key).agg(F.sum("steps").alias("steps"))
    models = newest.groupBy(key, "feature").agg(F.avg("w").alias("w"))
    return attach(models, steps, [key], ["feature"], "inner")
