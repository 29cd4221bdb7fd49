"""In-order training that scores every example before learning it, with a report every so many examples."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logistic import FtrlConfig
from ..operators.inorder import COUNTED, Rule
from ..operators.metrics import evaluate, reports
from ..operators.sampling import with_shard
from ..operators.shards import learned_and_scored
from ..operators.state import average_shards, empty_state
from ..sources.store import StateStore

EVERY, LAST = 100, 1000


def progressive_shards(
    state: DataFrame, examples: DataFrame, config: FtrlConfig | list[FtrlConfig], shards: int, rule: Rule = COUNTED,
    method: str = "xxhash64", **how,
) -> tuple[DataFrame, DataFrame]:
    """Every shard's learned features, and every example as scored before its shard learned it."""
    rows = with_shard(examples, "example_id", shards, method=method)
    return learned_and_scored(state, rows, config, {"shard": "int"}, shards, rule=rule, **how)


def train_in_order_batch(
    store: StateStore, batch: DataFrame, config: FtrlConfig, shards: int, source: str, batch_name: str,
    every: int = EVERY, last: int = LAST, method: str = "xxhash64", start: DataFrame | None = None,
) -> None:
    """Learn a batch in order of ``seq`` in each shard, average the shards, and store state, metrics and reports.

    Examples are numbered within their shard over all batches. A report at every ``every``-th one covers the last ``last``
    of the shard, those of earlier batches too: a version keeps the last scored rows of every shard. All of it comes from the
    one pass that learns. ``nonzero`` counts the shard's features that the batch touched and those of the state.
    A batch that the store knows already changes nothing.
    """
    if store.learned(source, batch_name):
        return
    before = store.latest()
    version = (before or 0) + 1
    spark = store.spark
    state = store.slice_for(batch, before) if before is not None else empty_state(spark) if start is None else start
    tail = store.rows("tail", before) if before is not None else None
    steps = None if tail is None else tail.groupBy("shard").agg(F.max("step").alias("steps"))
    learned, scored = progressive_shards(
        state, batch, config, shards, method=method, stored=before is not None, steps=steps)
    held = store.nonzero(before) if before is not None else state.agg(F.count_if(F.col("w") != 0.0)).first()[0]
    scored = scored.withColumn("nonzero", F.col("nonzero") + F.lit(held))
    recent = scored if tail is None else scored.unionByName(tail)
    newest = Window.partitionBy("shard").orderBy(F.desc("step"))
    store.save_rows("tail", version, recent.withColumn("__k", F.row_number().over(newest)).where(
        F.col("__k") <= last).drop("__k"))
    first = scored.groupBy("shard").agg(F.min("step").alias("first"))
    found = reports(recent, every, last, ["shard"]).join(F.broadcast(first), "shard").where(F.col("step") >= F.col("first"))
    store.save_rows("reports", version, found.drop("first"))
    store.save_metrics(version, evaluate(scored).withColumn("batch", F.lit(batch_name)))
    store.save_changes(
        version, state, average_shards(state, learned, shards), source, batch_name, steps=version, shards=shards, **asdict(config))


def report_rows(store: StateStore) -> DataFrame:
    """(version, shard, step, rows, loss, accuracy, auc, nonzero) of all batches learned."""
    return store.rows("reports")
