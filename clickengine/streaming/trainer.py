"""Models that learn from a stream, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.logistic import FtrlConfig
from ..plans.progressive import EVERY, LAST, train_in_order_batch
from ..plans.training import Step, minibatch, train_batch
from ..sources.examples import accepted, parse_libsvm, rejected, unwrap_envelope
from ..sources.store import StateStore


def triggered(writer: DataStreamWriter, seconds: float | None) -> DataStreamWriter:
    """A fixed interval, or everything that is there and then stop."""
    if seconds is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{int(seconds * 1000)} milliseconds")


def parse_stream(values: DataFrame) -> DataFrame:
    """Envelope texts of one micro-batch to label, features and validity.

    Equal texts are different examples, so a source without ids gets the row's place in
    the batch, which is the same when the batch is read again.
    """
    if "example_id" not in values.columns:
        values = values.withColumn("example_id", F.monotonically_increasing_id())
    if "seq" not in values.columns:
        values = values.withColumn("seq", F.col("example_id"))
    return parse_libsvm(unwrap_envelope(values))


def start_trainer(
    examples: DataFrame, store: StateStore, config: FtrlConfig, checkpoint: str,
    step: Step = minibatch, sample_ratio: float = 1.0, seconds: float | None = 5,
) -> StreamingQuery:
    """Train on each micro-batch of (example_id, label, features).

    A batch is told by the stream's checkpoint and its id there, so one that Spark delivers
    again after a failure changes nothing, and a new stream goes on from the last version.
    """

    def learn(batch: DataFrame, batch_id: int) -> None:
        train_batch(store, batch, config, step, sample_ratio, source=checkpoint, batch_name=str(batch_id))

    writer = examples.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint)
    return triggered(writer, seconds).start()


def start_in_order_trainer(
    examples: DataFrame, store: StateStore, config: FtrlConfig, checkpoint: str, shards: int = 8,
    every: int = EVERY, last: int = LAST, method: str = "xxhash64", seconds: float | None = 1,
) -> StreamingQuery:
    """Learn each micro-batch of (example_id, seq, label, features) in order of arrival, with a report every ``every`` examples."""

    def learn(batch: DataFrame, batch_id: int) -> None:
        train_in_order_batch(store, batch, config, shards, checkpoint, str(batch_id), every, last, method)

    writer = examples.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint)
    return triggered(writer, seconds).start()


def start_text_trainer(
    values: DataFrame, store: StateStore, rejects: str, config: FtrlConfig, checkpoint: str,
    step: Step = minibatch, sample_ratio: float = 1.0, seconds: float | None = 5,
) -> StreamingQuery:
    """Train on envelope texts; what does not parse goes to the ``rejects`` table."""

    def learn(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_stream(batch).persist()
        try:
            rejected(parsed, ["value"]).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
            train_batch(store, accepted(parsed), config, step, sample_ratio,
                        source=checkpoint, batch_name=str(batch_id))
        finally:
            parsed.unpersist()

    writer = values.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint)
    return triggered(writer, seconds).start()
