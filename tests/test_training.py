import json
import os
import shutil
import subprocess
import sys

import plain
import pytest
from conftest import close, rows_of
from pyspark.sql import functions as F
from test_models import CONFIG, as_dict, clicks, make, plain_dict

from clickengine.operators import state as st
from clickengine.plans import scoring, training
from clickengine.session import shared_root
from clickengine.sources.store import StateStore
from clickengine.sources.streams import file_parquet, file_text
from clickengine.streaming import hourly, keyed, trainer


def batches(rows, size):
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def numbered(spark, rows, size):
    return make(spark, rows).withColumn("batch", F.floor(F.col("seq") / size).cast("int"))


def chain(rows, size):
    state = {}
    for b in batches(rows, size):
        state = plain.batch_step(state, b, CONFIG)
    return state


def test_series_equals_the_chain_of_steps(spark, tmp_path):
    rows = clicks(45)
    store = StateStore(spark, str(tmp_path))
    training.train_series(store, numbered(spark, rows, 20), "batch", CONFIG)
    assert store.latest() == 3
    assert close(as_dict(store.load(), "z", "n", "p_count", "n_count"), plain_dict(chain(rows, 20)))
    report = training.summary(store).orderBy("version").collect()
    assert [(r["batch"], r["rows"]) for r in report] == [("0", 20), ("1", 20), ("2", 5)]
    assert report[0]["loss"] == pytest.approx(0.6931471805599453)  # nothing learned yet
    text = training.summary(store).orderBy("version").select(training.summary_line()).first()[0]
    assert text.startswith("loss : 0.69315,  accuracy : ") and text.endswith("Sample Count : 20")


def test_training_goes_on_where_it_stopped(spark, tmp_path):
    rows = clicks(45)
    examples = numbered(spark, rows, 20)
    store = StateStore(spark, str(tmp_path))
    training.train_series(store, examples, "batch", CONFIG, batches=[0, 1], source="s")
    before = rows_of(store.load(2))
    again = StateStore(spark, str(tmp_path))
    training.train_series(again, examples, "batch", CONFIG, source="s")
    assert again.latest() == 3 and rows_of(again.load(2)) == before
    assert close(as_dict(again.load(), "z", "n", "p_count", "n_count"), plain_dict(chain(rows, 20)))
    settings = again.meta().where("version = 3").first()
    assert (settings["alpha"], settings["l1"], settings["steps"]) == (0.7, 0.3, 3)


def test_a_batch_delivered_twice_changes_nothing(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    batch = make(spark, clicks(20))
    training.train_batch(store, batch, CONFIG, source="s", batch_name="a")
    before = rows_of(store.load())
    training.train_batch(store, batch, CONFIG, source="s", batch_name="a")
    assert store.latest() == 1 and rows_of(store.load()) == before


def test_new_data_is_never_skipped(spark, tmp_path):
    """Series, series and stream on one store learn from all rows, in order."""
    rows = clicks(60)
    store = StateStore(spark, str(tmp_path / "model"), keep=2)
    training.train_series(store, numbered(spark, rows[:20], 10), "batch", CONFIG)
    training.train_series(store, numbered(spark, rows[20:40], 10), "batch", CONFIG)
    folder = str(tmp_path / "in")
    write_parts(spark, folder, numbered(spark, rows[40:], 10), [0, 1])
    stream = file_parquet(spark, folder, "*.parquet", files_per_batch=1)
    trainer.start_trainer(stream, store, CONFIG, str(tmp_path / "cp"), seconds=None).awaitTermination()
    assert store.latest() == 6
    assert close(as_dict(store.load(), "z", "n", "p_count", "n_count"), plain_dict(chain(rows, 10)))
    assert sorted(p.name for p in (tmp_path / "model" / "state").glob("version=*")) == ["version=5", "version=6"]
    assert training.summary(store).count() == 6


def test_shards_are_kept_in_meta(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    training.train_batch(store, make(spark, clicks(10)), CONFIG, training.sharded(3))
    assert store.meta().first()["shards"] == 3


@pytest.mark.parametrize("step", [training.counted_minibatch, training.sharded(3)])
def test_other_steps_learn_from_given_weights(spark, tmp_path, step):
    store = StateStore(spark, str(tmp_path))
    start = st.seeded_state(spark.createDataFrame([(77, 0.5, -2.0)], "feature long, w double, z double"))
    training.train_batch(store, make(spark, clicks(30)), CONFIG, step, start=start)
    got = as_dict(store.load(), "w", "z")
    assert got[77] == (0.5, -2.0) and len(got) == 7


def test_validation_sample(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    training.train_batch(store, make(spark, clicks(400)), CONFIG, sample_ratio=0.25)
    rows = store.metrics().first()["rows"]
    assert 60 < rows < 140
    assert sum(v[0] + v[1] for f, v in as_dict(store.load(), "p_count", "n_count").items() if f == 0) == 400


def test_ordered_batches(spark):
    df = spark.createDataFrame([(h,) for h in (3, 1, 2, 2, 5, 4)], "hour int")
    assert training.ordered_batches(df, "hour") == [1, 2, 3, 4, 5]
    assert training.ordered_batches(df, "hour", skip=2) == [3, 4, 5]
    assert training.ordered_batches(df, "hour", skip=-1, take=-2) == [3, 4]
    assert training.ordered_batches(df, "hour", take=2) == [1, 2]


def test_scores(spark):
    state = st.seeded_state(spark.createDataFrame([(1, 2.0), (2, 0.0), (3, 900.0)], "feature long, w double"))
    rows = make(spark, [(0, {1: 1.0, 2: 5.0}), (0, {3: 1.0}), (0, {3: -1.0})]).drop("label")
    assert rows_of(scoring.score(rows, state)) == [
        (0, pytest.approx(0.8807970779778823)), (1, 0.999999999999), (2, 0.0000000000001)]


def test_cluster_needs_a_shared_folder(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


def write_parts(spark, folder, df, parts):
    """One file per part, in order of time."""
    import time

    for part in parts:
        df.where(F.col("batch") == part).drop("batch").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)


def test_stream_equals_batches_and_survives_a_replay(spark, tmp_path):
    rows = clicks(40)
    folder = str(tmp_path / "in")
    write_parts(spark, folder, numbered(spark, rows, 20), [0, 1])
    store = StateStore(spark, str(tmp_path / "model"))

    def run(checkpoint):
        stream = file_parquet(spark, folder, "*.parquet", files_per_batch=1)
        trainer.start_trainer(stream, store, CONFIG, str(tmp_path / checkpoint), seconds=None).awaitTermination()

    run("a")
    assert store.latest() == 2
    assert close(as_dict(store.load(), "z", "n", "p_count", "n_count"), plain_dict(chain(rows, 20)))
    before = rows_of(store.load())
    shutil.rmtree(tmp_path / "a" / "commits")  # the last batches are delivered once more
    run("a")
    assert store.latest() == 2 and rows_of(store.load()) == before


def test_text_stream_keeps_equal_lines_apart_and_rejects_bad_ones(spark, tmp_path):
    good = json.dumps({"payload": "1 0:1.0 3:2.0"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join([good, good, "{bad", json.dumps({"payload": "z"})]) + "\n")
    store = StateStore(spark, str(tmp_path / "model"))
    trainer.start_text_trainer(
        file_text(spark, str(tmp_path / "in")), store, str(tmp_path / "rejects"), CONFIG,
        str(tmp_path / "checkpoint"), seconds=None).awaitTermination()
    want = plain.batch_step({}, [(1, {0: 1.0, 3: 2.0})] * 2, CONFIG)
    assert close(as_dict(store.load(), "z", "n", "p_count", "n_count"), plain_dict(want))
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 2


def test_text_stream_learns_in_shards(spark, tmp_path):
    lines = [json.dumps({"payload": f"{y} " + " ".join(f"{k}:{v}" for k, v in x.items())}) for y, x in clicks(30)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines) + "\n")
    store = StateStore(spark, str(tmp_path / "model"))
    trainer.start_text_trainer(
        file_text(spark, str(tmp_path / "in")), store, str(tmp_path / "rejects"), CONFIG,
        str(tmp_path / "checkpoint"), step=training.sharded(1), seconds=None).awaitTermination()
    want = plain.sequential({}, clicks(30), CONFIG, True)
    assert close(as_dict(store.load(), "z", "n"), {f: (v["z"], v["n"]) for f, v in want.items()})


@pytest.mark.parametrize("block", ["3", "10000"])
def test_keyed_models_fold_rows_in_order_over_batches(spark, tmp_path, block):
    rows = clicks(40)
    examples = numbered(spark, rows, 20).withColumn("segment", F.concat(F.lit("s"), F.col("seq") % 2))
    folder = str(tmp_path / "in")
    write_parts(spark, folder, examples.orderBy(F.desc("seq")), [0, 1])
    store = StateStore(spark, str(tmp_path / "model"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", block)
    try:
        keyed.start_keyed_trainer(file_parquet(spark, folder, "*.parquet", 1), "segment", store, CONFIG,
                                  str(tmp_path / "cp"), shards=1, seconds=None).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    merged = keyed.merged_models(store.load(), "segment")
    for s in (0, 1):
        want = plain.sequential({}, [r for i, r in enumerate(rows) if i % 2 == s], CONFIG)
        got = as_dict(merged.where(f"segment = 's{s}'"), "w")
        assert close(got, {f: (plain.weight(v["z"], v["n"], CONFIG),) for f, v in want.items()})
    assert rows_of(keyed.model_steps(store, "segment")) == [("s0", 20), ("s1", 20)]


def test_workers_find_the_package_from_another_folder(tmp_path):
    """A driver that knows the package through its own path only."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", entry.queries()["shard_train"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 7" in out.stdout, out.stderr[-2000:]


def events(spark):
    """Hour 1 in two files; a third file holds a row that is two days late."""
    rows = [(0, "u", "2024-01-03 01:10:00"), (0, "u", "2024-01-03 01:50:00"), (0, "v", "2024-01-03 02:00:00"),
            (1, "u", "2024-01-03 01:20:00"), (2, "u", "2024-01-01 01:00:00")]
    return spark.createDataFrame(rows, "batch int, user string, t string").withColumn("ts", F.to_timestamp("t"))


@pytest.mark.parametrize("late", [None, "3 days", "1 hour"])
def test_hourly_counts_over_batches(spark, tmp_path, late):
    folder = str(tmp_path / "in")
    write_parts(spark, folder, events(spark), [0, 1, 2])
    stream = file_parquet(spark, folder, "*.parquet", 1)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    if late is None:
        hourly.start_hour_increments(stream, ["user"], "ts", out, cp, seconds=None).awaitTermination()
        counts = hourly.read_hour_increments(spark, out, ["user"])
    else:
        counts = hourly.windowed_counts(stream, ["user"], "ts", late)
        hourly.start_windowed_counts(counts, out, cp, seconds=None).awaitTermination()
        counts = hourly.read_windowed_counts(spark, out, ["user"])
    got = rows_of(counts, "user", F.date_format("window_start", "dd HH"), "n")
    whole = [("u", "01 01", 1), ("u", "03 01", 3), ("v", "03 02", 1)]
    assert got == (whole[1:] if late == "1 hour" else whole)
    lookup = hourly.previous_hour_lookup(counts, ["user"], "hour", "hour_count")
    assert ("v", "03 03", 1) in rows_of(lookup, "user", F.date_format("hour", "dd HH"), "hour_count")


def test_margins_of_a_batch_shuffle_its_examples_and_not_their_features(spark, tmp_path):
    """With a small stored model: one exchange, below the step from an example to its rows."""
    from clickengine.operators import steps

    rows = make(spark, clicks(30))
    store = StateStore(spark, str(tmp_path))
    training.train_batch(store, rows, CONFIG)
    near = steps.margin_rows(rows, store.load(), CONFIG, stored=True)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Window") < plan.index("Generate") < plan.index("Exchange hashpartitioning(example_id")
    far = steps.margin_rows(rows, store.load(), CONFIG, stored=True, max_rows=0)
    key = lambda r: (r["example_id"], r["feature"] or 0)
    one, other = sorted(near.collect(), key=key), sorted(far.collect(), key=key)
    assert [key(r) for r in one] == [key(r) for r in other]
    assert [r["margin"] for r in one] == pytest.approx([r["margin"] for r in other], abs=1e-12)
