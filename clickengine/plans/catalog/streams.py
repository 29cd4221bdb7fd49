"""Queries that read ``events`` as a stream, run it to its end and return what it stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators.skew import attach
from ...session import new_folder
from ...sources.examples import libsvm_line
from ...sources.offsets import ordered_log
from ...sources.store import StateStore
from ...sources.streams import file_parquet
from ...streaming import hourly, keyed, stateful, trainer
from .. import progressive, training
from .base import RAW_SQL, ORACLES, events, query, r6, sql6, sql_ts, text_ts, with_codes
from .models import (
    BATCHES, CONFIG, MD5, REPORT_SQL, SHARDS, STATE_SQL, WITH_EX, batch_sql, chain_sql, in_order_sql, reports_out,
    small_examples, state_out, to_examples,
)

HOURS_SQL = f"""SELECT user_id, {sql_ts("date_trunc('hour', ts)", 'window_start')},
  {sql_ts("date_trunc('hour', ts) + INTERVAL 1 HOUR", 'window_end')}, count(*) AS n
  FROM events GROUP BY user_id, date_trunc('hour', ts)"""


def _resume_sql() -> str:
    last = f"SELECT * FROM ex WHERE batch >= {BATCHES - 1}"
    chain = chain_sql([*[batch_sql(i) for i in range(BATCHES - 1)], last])
    return WITH_EX + chain + f" SELECT {STATE_SQL} FROM s{BATCHES}"


def event_stream(spark, sf_dir):
    return with_codes(file_parquet(spark, sf_dir, "events.parquet"))


def _hours_out(counts):
    return counts.select("user_id", text_ts("window_start"), text_ts("window_end"), "n")


@query("stream_hour_counts", HOURS_SQL)
def stream_hour_counts(spark, sf_dir):
    folder = new_folder(spark, "stream-hours")
    hourly.start_hour_increments(
        event_stream(spark, sf_dir), ["user_id"], "ts", f"{folder}/counts", f"{folder}/checkpoint",
        seconds=None,
    ).awaitTermination()
    return _hours_out(hourly.read_hour_increments(spark, f"{folder}/counts", ["user_id"]))


@query("stream_windowed_counts", HOURS_SQL)
def stream_windowed_counts(spark, sf_dir):
    """The same with running totals in the stream's state, open for a month of log."""
    folder = new_folder(spark, "stream-windows")
    counts = hourly.windowed_counts(event_stream(spark, sf_dir), ["user_id"], "ts", "31 days")
    hourly.start_windowed_counts(
        counts, f"{folder}/counts", f"{folder}/checkpoint", seconds=None
    ).awaitTermination()
    return _hours_out(hourly.read_windowed_counts(spark, f"{folder}/counts", ["user_id"]))


@query("stream_previous_hour", f"""WITH {RAW_SQL}, h AS (SELECT user_id,
    date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour, count(*) AS hour_count FROM raw GROUP BY ALL)
  SELECT event_id, user_id, hour_count FROM (SELECT *, date_trunc('hour', ts) AS hour FROM raw)
  LEFT JOIN h USING (user_id, hour)""")
def stream_previous_hour(spark, sf_dir):
    """Rows joined to the counts a stream has kept of the hour before."""
    folder = new_folder(spark, "stream-previous")
    hourly.start_hour_increments(
        event_stream(spark, sf_dir), ["user_id"], "ts", f"{folder}/counts", f"{folder}/checkpoint",
        seconds=None,
    ).awaitTermination()
    counts = hourly.read_hour_increments(spark, f"{folder}/counts", ["user_id"])
    lookup = hourly.previous_hour_lookup(counts, ["user_id"], "hour", "hour_count")
    now = counts.select("user_id", F.col("window_start").alias("hour"), "n")
    rows = events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    return attach(rows, lookup, ["user_id", "hour"], ["event_id"], counts=now).select(
        "event_id", "user_id", "hour_count"
    )


@query("stream_foreach_batch", ORACLES["ftrl_one_batch"])
def stream_foreach_batch(spark, sf_dir):
    """Events as a stream of examples; one file is one batch, so one step."""
    folder = new_folder(spark, "stream-train")
    store = StateStore(spark, f"{folder}/model")
    trainer.start_trainer(
        to_examples(event_stream(spark, sf_dir)), store, CONFIG, f"{folder}/checkpoint", seconds=None
    ).awaitTermination()
    return state_out(store.load())


@query("stream_envelopes", ORACLES["ftrl_one_batch"])
def stream_envelopes(spark, sf_dir):
    """The same examples sent as LIBSVM lines in JSON envelopes."""
    folder = new_folder(spark, "stream-text")
    lines = to_examples(event_stream(spark, sf_dir)).select(
        "example_id", F.to_json(F.struct(libsvm_line().alias("payload"))).alias("value")
    )
    store = StateStore(spark, f"{folder}/model")
    trainer.start_text_trainer(
        lines, store, f"{folder}/rejects", CONFIG, f"{folder}/checkpoint", seconds=None
    ).awaitTermination()
    return state_out(store.load())


@query("stream_shard_train", ORACLES["shard_train"])
def stream_shard_train(spark, sf_dir):
    """In-order training per shard on each micro-batch, averaged."""
    folder = new_folder(spark, "stream-shards")
    store = StateStore(spark, f"{folder}/model")
    trainer.start_trainer(
        small_examples(event_stream(spark, sf_dir)), store, CONFIG, f"{folder}/checkpoint",
        step=training.sharded(SHARDS, MD5), seconds=None,
    ).awaitTermination()
    return state_out(store.load())


@query("stream_shard_envelopes", ORACLES["shard_train"])
def stream_shard_envelopes(spark, sf_dir):
    """The same examples sent as LIBSVM lines in JSON envelopes."""
    folder = new_folder(spark, "stream-shard-text")
    lines = small_examples(event_stream(spark, sf_dir)).select(
        "example_id", F.to_json(F.struct(libsvm_line().alias("payload"))).alias("value")
    )
    store = StateStore(spark, f"{folder}/model")
    trainer.start_text_trainer(
        lines, store, f"{folder}/rejects", CONFIG, f"{folder}/checkpoint",
        step=training.sharded(SHARDS, MD5), seconds=None,
    ).awaitTermination()
    return state_out(store.load())


@query("stream_keyed_state", f"""WITH RECURSIVE {RAW_SQL}, {in_order_sql(['shard', 'segment'], False)},
  steps AS (SELECT segment, CAST(count(*) AS BIGINT) AS steps FROM small GROUP BY segment)
  SELECT segment, feature, any_value(steps.steps) AS steps, {sql6('avg(w)', 'w')}
  FROM learned JOIN steps USING (segment) GROUP BY segment, feature""")
def stream_keyed_state(spark, sf_dir):
    """One model per segment of codes, folded in order and kept as a state table."""
    folder = new_folder(spark, "stream-keyed")
    store = StateStore(spark, f"{folder}/model")
    keyed.start_keyed_trainer(
        small_examples(event_stream(spark, sf_dir)), "segment", store, CONFIG, f"{folder}/checkpoint", SHARDS,
        method=MD5, seconds=None,
    ).awaitTermination()
    return keyed.published(store, "segment").select("segment", "feature", "steps", r6("w"))


@query("stream_state_store", ORACLES["stream_keyed_state"])
def stream_state_store(spark, sf_dir):
    """The same with the models in the stream's state store."""
    folder = new_folder(spark, "stream-store")
    stateful.start_state_store_trainer(
        small_examples(event_stream(spark, sf_dir)), "segment", f"{folder}/updates", CONFIG, f"{folder}/checkpoint", SHARDS,
        method=MD5, seconds=None,
    ).awaitTermination()
    return stateful.published(spark, f"{folder}/updates", "segment").select("segment", "feature", "steps", r6("w"))


OFFSET_STEP = 4000
STEPS_TOGETHER = 250


@query("stream_offsets", f"""SELECT event_id, user_id, value, CAST((event_id - first) // {OFFSET_STEP} AS INTEGER) AS batch
  FROM events, (SELECT min(event_id) AS first FROM events)""")
def stream_offsets(spark, sf_dir):
    """All events through a source with offsets of its own, so many ids to a step; steps that wait are read together."""
    folder = new_folder(spark, "stream-offsets")
    log = ordered_log(spark, f"{sf_dir}/events.parquet", "event_id", OFFSET_STEP, folder, STEPS_TOGETHER, "batch")
    rows = log.select("event_id", "user_id", "value", "batch")
    running = (
        rows.writeStream.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/rows/run={k}"))
        .option("checkpointLocation", f"{folder}/checkpoint").start()
    )
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(f"{folder}/rows").select("event_id", "user_id", "value", "batch")


@query("stream_report_every_100", REPORT_SQL)
def stream_report_every_100(spark, sf_dir):
    """Events as a stream, each shard in order; a report over its last 1000 examples at every 100th."""
    folder = new_folder(spark, "stream-reports")
    store = StateStore(spark, f"{folder}/model")
    trainer.start_in_order_trainer(
        small_examples(event_stream(spark, sf_dir)), store, CONFIG, f"{folder}/checkpoint", SHARDS, method=MD5, seconds=None,
    ).awaitTermination()
    return reports_out(progressive.report_rows(store))


@query("resume_training", _resume_sql())
def resume_training(spark, sf_dir):
    """Two series on one store, then a stream onto it: no batch is left out."""
    folder = new_folder(spark, "resume")
    store = StateStore(spark, f"{folder}/model", keep=2)
    rows = to_examples(events(spark, sf_dir))
    training.train_series(store, rows.where(F.col("batch") < 2), "batch", CONFIG, source="first")
    training.train_series(store, rows.where(F.col("batch").isin(2, 3)), "batch", CONFIG, source="second")
    stream = to_examples(event_stream(spark, sf_dir)).where(F.col("batch") >= 4)
    trainer.start_trainer(stream, store, CONFIG, f"{folder}/checkpoint", seconds=None).awaitTermination()
    return state_out(store.load())
