"""Streams that stop and start again: models in Spark's state store, and a log source with its own offsets."""

import plain
import pytest
from conftest import close, rows_of
from pyspark.sql import functions as F
from test_models import CONFIG, clicks, make

from clickengine.plans.training import train_batch
from clickengine.sources.offsets import committed, ordered_log
from clickengine.sources.store import StateStore
from clickengine.sources.streams import file_parquet
from clickengine.streaming.stateful import published, start_state_store_trainer


def written(spark, rows, path, first=0):
    """Examples of two keys as one more file of a log folder."""
    make(spark, rows).withColumn("seq", F.col("seq") + first).withColumn("example_id", F.col("seq")).withColumn(
        "segment", F.when(F.col("seq") % 3 == 0, "a").otherwise("b")).repartition(1).write.mode("append").parquet(path)


def test_models_in_the_state_store_go_on_after_a_restart(spark, tmp_path):
    path, updates, checkpoint = (str(tmp_path / x) for x in ("log", "updates", "checkpoint"))
    rows = clicks(90)
    for a, b in ((0, 40), (40, 45), (45, 90)):
        written(spark, rows[a:b], path, a)
        start_state_store_trainer(
            file_parquet(spark, path), "segment", updates, CONFIG, checkpoint, shards=1, seconds=None).awaitTermination()
    want = {}
    for key in ("a", "b"):
        own = [r for i, r in enumerate(rows) if (i % 3 == 0) == (key == "a")]
        state = plain.sequential({}, own, CONFIG)
        want.update({(key, f): (plain.weight(s["z"], s["n"], CONFIG), len(own)) for f, s in state.items()})
    got = {(r.segment, r.feature): (r.w, r.steps) for r in published(spark, updates, "segment").collect()}
    assert close(got, want)
    # A micro-batch publishes the features it touched and no others.
    touched = {(k, f) for i in range(40, 45) for f in rows[i][1] for k in [("a" if i % 3 == 0 else "b")]}
    second = spark.read.parquet(f"{updates}/batch=1")
    assert {(r.segment, r.feature) for r in second.collect()} == touched


class Stopped(Exception):
    pass


@pytest.mark.parametrize("fails", ["before", "after"])
def test_a_batch_that_was_not_committed_is_learned_once(spark, tmp_path, fails):
    """The stream stops between reading and committing its second batch, before or after that was learned."""
    path, folder = str(tmp_path / "log"), str(tmp_path / "offsets")
    rows = clicks(50)
    written(spark, rows[:30], path)
    written(spark, rows[30:], path, 30)
    store = StateStore(spark, str(tmp_path / "model"))
    runs = []

    def learn(batch, batch_id):
        runs.append((batch_id, sorted(r.seq for r in batch.select("seq").collect())))
        stop = len(runs) == 2
        if stop and fails == "before":
            raise Stopped
        train_batch(store, batch, CONFIG, source="log", batch_name=str(batch_id))
        if stop:
            raise Stopped

    def run():
        log = ordered_log(spark, path, "seq", 20, folder)
        query = log.writeStream.foreachBatch(learn).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="Stopped"):
        run()
    assert committed(folder)["planned"] == 39 and committed(folder).get("done", -1) <= 19
    run()
    run()  # nothing new
    # The second batch came twice, with the same rows.
    first, second, third = (list(range(*r)) for r in ((0, 20), (20, 40), (40, 50)))
    assert [r for _, r in runs] == [first, second, second, third]
    assert store.metrics().agg(F.sum("rows")).first()[0] == 50
    state = {}
    for _, seqs in dict(runs).items():
        state = plain.batch_step(state, [rows[i] for i in seqs], CONFIG)
    assert close({r.feature: (r.z,) for r in store.load().collect()}, {f: (s["z"],) for f, s in state.items()})
    # Rows that come later are read by a reader that starts anew.
    written(spark, rows[:5], path, 200)
    run()
    assert rows_of(store.metrics().where("version > 3"), "rows") == [(5,)]


def test_an_empty_log_has_no_batches(spark, tmp_path):
    path, folder = str(tmp_path / "log"), str(tmp_path / "offsets")
    spark.range(0).selectExpr("id AS seq", "'x' AS text").write.parquet(path)
    seen = []
    query = ordered_log(spark, path, "seq", 10, folder).writeStream.foreachBatch(
        lambda batch, k: seen.append(batch.count())).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == 0


def test_steps_read_together_are_those_read_one_by_one(spark, tmp_path):
    """Also behind gaps within a file and between files, and in a reader that starts anew."""
    path = str(tmp_path / "log")
    for seqs in (range(3, 30), [*range(31, 44), *range(71, 80)], range(82, 150), range(400, 431)):
        spark.createDataFrame([(s,) for s in seqs], "seq long").repartition(1).write.mode("append").parquet(path)

    def run(name, together):
        folder = str(tmp_path / name)
        log = ordered_log(spark, path, "seq", 10, folder, together, "step")
        query = log.writeStream.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/rows/run={k}")).option(
            "checkpointLocation", f"{folder}/checkpoint").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        rows = spark.read.parquet(f"{folder}/rows")
        return rows_of(rows, "seq", "step"), rows.select("run").distinct().count()

    one, many = run("one", 1), run("many", 100)
    assert one[0] == many[0] and len(one[0]) == 148
    assert many[1] <= 4 < one[1]
    spark.range(431, 520).selectExpr("id AS seq").repartition(1).write.mode("append").parquet(path)
    assert run("one", 1)[0] == run("many", 100)[0]
