"""State as a base plus deltas: same content as a whole state, work in proportion to what a batch touches."""

import os

import pytest
from conftest import rows_of
from test_models import CONFIG, clicks, make

from clickengine.operators.state import empty_state, seeded_state
from clickengine.operators.steps import ftrl_step
from clickengine.plans.training import sharded, train_batch
from clickengine.sources.deltas import DeltaStore
from clickengine.sources.store import StateStore


def batches(spark):
    """Five batches with features of their own and shared ones."""
    for k in range(5):
        yield make(spark, [(y, {**x, 100 + k: 1.0, 200 + k // 2: 0.5}) for y, x in clicks(20 + k)])


def trained(spark, store, step=None):
    for k, batch in enumerate(batches(spark)):
        train_batch(store, batch, CONFIG, *([step] if step else []), source="log", batch_name=str(k))
    return store


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    return trained(spark, StateStore(spark, str(tmp_path_factory.mktemp("whole"))))


def same(a, b):
    left, right = ({r.feature: tuple(r)[1:] for r in df.select("feature", "w", "z", "n", "p_count", "n_count", "g_sum").collect()}
                   for df in (a, b))
    assert left.keys() == right.keys()
    assert all(abs(x - y) < 1e-9 for f in left for x, y in zip(left[f], right[f]))


@pytest.mark.parametrize("every", [2, 100])
def test_every_version_equals_the_whole_state(spark, tmp_path, whole, every):
    store = trained(spark, DeltaStore(spark, str(tmp_path / "m"), buckets=4, compact_every=every, compact_share=100))
    assert rows_of(store.meta(), "version", "nonzero", "features") == [
        (v, whole.nonzero(v), whole.load(v).count()) for v in range(1, 6)]
    for v in range(1, 6):
        same(store.load(v), whole.load(v))
    # A batch that was learned changes nothing.
    train_batch(store, next(batches(spark)), CONFIG, source="log", batch_name="0")
    assert store.latest() == 5


def test_a_batch_writes_the_features_it_touches(spark, tmp_path):
    store = trained(spark, DeltaStore(spark, str(tmp_path / "m"), buckets=4, compact_share=100))
    touched = [len({f for _, x in b.select("label", "features").collect() for f in x}) for b in batches(spark)]
    assert [r.written for r in store.meta().orderBy("version").collect()] == touched
    for k in range(2, 6):
        assert spark.read.parquet(str(tmp_path / "m" / "delta" / f"version={k}")).count() == touched[k - 1]
    assert not os.path.exists(tmp_path / "m" / "slice" / "version=5")


def test_deltas_that_grow_large_become_a_base(spark, tmp_path):
    store = trained(spark, DeltaStore(spark, str(tmp_path / "m"), buckets=4, compact_share=0.9))
    assert len(os.listdir(tmp_path / "m" / "bases")) > 2


def test_shard_training_works_on_a_slice(spark, tmp_path, tmp_path_factory):
    step = sharded(2)
    a = trained(spark, StateStore(spark, str(tmp_path_factory.mktemp("a"))), step)
    b = trained(spark, DeltaStore(spark, str(tmp_path / "m"), buckets=4, compact_every=2), step)
    same(a.load(), b.load())


def test_kept_versions_stay_loadable_in_a_new_session(spark, tmp_path, whole):
    root = str(tmp_path / "m")
    trained(spark, DeltaStore(spark, root, keep=2, buckets=4, compact_every=2, compact_share=100))
    for table in spark.catalog.listTables():
        if table.name.startswith("state_"):
            spark.sql(f"DROP TABLE {table.name}")
    store = DeltaStore(spark, root, keep=2)
    assert store.buckets == 4
    for v in (4, 5):
        same(store.load(v), whole.load(v))
    assert sorted(os.listdir(os.path.join(root, "base"))) == ["version=3", "version=5"]
    assert sorted(x for x in os.listdir(os.path.join(root, "delta"))) in (["version=4", "version=5"], ["version=4"])


def test_the_state_is_neither_shuffled_nor_sorted(spark, tmp_path):
    store = trained(spark, DeltaStore(spark, str(tmp_path / "m"), buckets=4, compact_share=100))
    found = store.rows_of(spark.range(0, 400, 3).selectExpr("id AS feature"))
    got = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # The one exchange and the one sort are those of the features asked for.
    assert plan.count("Exchange") == 1 and plan.count("Sort [") + plan.count("Sort (") == 1
    assert plan.count("SortMergeJoin") == 5 and plan.count("Bucketed: true") == 5
    want = {r.feature: tuple(r) for r in store.load().collect()}
    assert {tuple(r) for r in got} == {want[f] for f in range(0, 400, 3) if f in want}
    merged = store.load()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in merged


def test_a_start_and_an_empty_batch(spark, tmp_path):
    start = seeded_state(spark.createDataFrame([(0, 0.5, 1.0), (999, 2.0, 3.0)], "feature long, z double, n double"))
    store = DeltaStore(spark, str(tmp_path / "m"), buckets=4)
    first, second = list(batches(spark))[:2]
    train_batch(store, first, CONFIG, start=start, source="log", batch_name="0")
    train_batch(store, second.limit(0), CONFIG, source="log", batch_name="1")
    same(store.load(), ftrl_step(start, first, CONFIG))
    assert store.rows_of(spark.range(5000, 5003).selectExpr("id AS feature")).count() == 0
    assert DeltaStore(spark, str(tmp_path / "none"), buckets=4).rows_of(spark.range(3).selectExpr("id AS feature")).count() == 0
    assert empty_state(spark).columns == store.load().columns
