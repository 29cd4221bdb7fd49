"""In-order training with a score of every example before it is learned, against plain Python."""

import math
from dataclasses import replace

import numpy as np
import plain
import pytest
from conftest import close, rows_of
from pyspark.sql import functions as F
from test_models import clicks, make

from clickengine.functions.logistic import FtrlConfig
from clickengine.operators import metrics, shards, state as st
from clickengine.operators.inorder import COUNTED, DESCENT, EXACT, Models
from clickengine.operators.shards import learned_and_scored, train_in_order
from clickengine.plans.progressive import progressive_shards, report_rows, train_in_order_batch
from clickengine.sources.store import StateStore

CONFIG = FtrlConfig(alpha=0.7, beta=1.0, l1=0.3, l2=0.1)
OTHERS = [CONFIG, FtrlConfig(alpha=0.2, beta=2.0, l1=0.0, l2=0.5), FtrlConfig(alpha=1.0, beta=1.0, l1=0.1, sigma_sign=1)]


def by_hand(rows, config, use_counts, state=None):
    """(state, [(label, prob, loss, nonzero)]) with every row scored before it is learned."""
    state, out = dict(state or {}), []

    def size():
        return sum(plain.weight(s["z"], s["n"], config) != 0 for s in state.values())

    at_start = size()
    for y, x in rows:
        p = plain.prob(sum(plain.weight(state[f]["z"], state[f]["n"], config) * v for f, v in x.items() if f in state))
        state = plain.sequential(state, [(y, x)], config, use_counts)
        out.append((y, p, -y * math.log(p) - (1 - y) * math.log(1 - p), size() - at_start))
    return state, out


@pytest.mark.parametrize("rule, use_counts", [(EXACT, False), (COUNTED, True)])
def test_rows_are_scored_before_they_are_learned(spark, rule, use_counts):
    rows = clicks(70) + [(1, {}), (0, {0: 1.0, 77: 2.0})]
    learned, scored = progressive_shards(st.empty_state(spark), make(spark, rows).repartition(5), CONFIG, 1, rule)
    state, want = by_hand(rows, CONFIG, use_counts)
    got = {r.example_id: (r.label, r.prob, r.loss, r.nonzero) for r in scored.collect()}
    assert close(got, dict(enumerate(want)))
    assert [r.step for r in scored.orderBy("seq").collect()] == list(range(1, len(rows) + 1))
    assert close({r.feature: (r.z, r.n) for r in learned.collect()}, {f: (s["z"], s["n"]) for f, s in state.items()})


def test_models_side_by_side_equal_models_alone(spark):
    rows = make(spark, clicks(90))
    first, later = rows.where("seq < 40"), rows.where("seq >= 40")
    empty = st.empty_state(spark, {"config_id": "bigint"})
    learned, scored = learned_and_scored(empty, first.selectExpr("0 AS shard", "*"), OTHERS, {"shard": "int"}, 1, rule=EXACT)
    state = st.seeded_state(learned.selectExpr("config_id", "feature", "z", "n", "p_new p_count", "n_new n_count"), ["config_id"])
    again, more = learned_and_scored(state, later.selectExpr("0 AS shard", "*"), OTHERS, {"shard": "int"}, 1, rule=EXACT)
    for k, config in enumerate(OTHERS):
        want, probs = by_hand(clicks(90), config, False)
        got = {r.feature: (r.w, r.z, r.n) for r in again.where(f"config_id = {k}").collect()}
        assert close(got, {f: (plain.weight(s["z"], s["n"], config), s["z"], s["n"]) for f, s in want.items()})
        each = {r.example_id: (r.prob,) for r in scored.unionByName(more).where(f"config_id = {k}").collect()}
        assert close(each, {i: (p[1],) for i, p in enumerate(probs)})


def test_descent_moves_by_the_root_of_the_step(spark):
    rows = clicks(40)
    w = {}
    for t, (y, x) in enumerate(rows, start=1):
        d = plain.prob(sum(w.get(f, 0.0) * v for f, v in x.items())) - y
        for f, v in x.items():
            w[f] = w.get(f, 0.0) - d * v / math.sqrt(t)
    learned = train_in_order(st.empty_state(spark), make(spark, rows).selectExpr("0 AS shard", "*"), CONFIG, {"shard": "int"}, 1, rule=DESCENT)
    assert close({r.feature: (r.w,) for r in learned.collect()}, {f: (v,) for f, v in w.items()})


def reports_by_hand(scored, every, last):
    out = {}
    for i in range(every, len(scored) + 1, every):
        window = scored[max(0, i - last):i]
        out[i] = (len(window), *plain.metrics([s[:3] for s in window]))
    return out


@pytest.mark.parametrize("every, last", [(10, 50), (7, 50), (10, 10)])
def test_reports_cover_the_last_rows_of_all_batches(spark, tmp_path, every, last):
    rows = clicks(130)
    examples = make(spark, rows)
    store = StateStore(spark, str(tmp_path / "model"))
    state, want = {}, []
    for name, (a, b) in {"a": (0, 33), "b": (33, 38), "c": (38, 130)}.items():
        batch = examples.where(f"seq >= {a} AND seq < {b}")
        for _ in range(2):  # the second delivery changes nothing
            train_in_order_batch(store, batch, CONFIG, 1, "log", name, every, last)
        state, scored = by_hand(rows[a:b], CONFIG, True, state)
        want += scored
    got = {r.step: (r.rows, r.loss, r.accuracy, r.auc) for r in report_rows(store).collect()}
    assert close(got, reports_by_hand(want, every, last))
    assert store.latest() == 3
    assert rows_of(store.metrics(), "version", "rows") == [(1, 33), (2, 5), (3, 92)]
    sizes = {r.step: r.nonzero for r in report_rows(store).collect()}
    ends = (33, 38, 130)
    grown = {i: want[i - 1][3] + sum(want[e - 1][3] for e in ends if e < i) for i in sizes}
    assert sizes == grown
    final = {r.feature: (r.z,) for r in store.load().collect()}
    assert close(final, {f: (s["z"],) for f, s in state.items()})


def test_reports_of_shards_are_their_own(spark):
    examples = make(spark, clicks(300))
    _, scored = progressive_shards(st.empty_state(spark), examples, CONFIG, 3)
    got = metrics.reports(scored, 20, 40, ["shard"])
    rows = {}
    for r in scored.orderBy("shard", "step").collect():
        rows.setdefault(r.shard, []).append((r.label, r.prob, r.loss))
    want = {(k, i): v for k, s in rows.items() for i, v in reports_by_hand(s, 20, 40).items()}
    assert close({(r.shard, r.step): (r.rows, r.loss, r.accuracy, r.auc) for r in got.collect()}, want)


@pytest.mark.parametrize("rule", [EXACT, COUNTED, DESCENT])
@pytest.mark.parametrize("configs", [[CONFIG], [CONFIG, replace(CONFIG, l1=0.0), replace(CONFIG, sigma_sign=1)]])
def test_few_features_learn_as_arrays_of_them_do(rule, configs):
    rng = np.random.default_rng(3)
    one, other = Models(configs, rule), Models(configs, rule)
    assert one.few
    other.few = 0
    for i in range(600):
        ids = rng.integers(0, 40, rng.integers(0, 9)) if i % 50 else np.arange(100)
        values = rng.normal(size=len(ids)) * rng.choice([0.1, 1, 50, 900], p=[0.5, 0.4, 0.09, 0.01])
        start = rng.normal(size=(4, len(configs), len(ids))) ** 2
        margins = [m.learn(m.slots(ids, start), values, i % 2, True) for m in (one, other)]
        assert margins[0] == pytest.approx(margins[1], rel=1e-6, abs=1e-6)
    for k, v in one.rows().items():
        assert v == pytest.approx(other.rows()[k], rel=1e-6, abs=1e-6)
    assert (one.nonzero == other.nonzero).all() and one.steps == other.steps == 600


def test_no_empty_cells_are_sorted(spark):
    """Examples of which the state has no feature carry no cells; the others all of theirs."""
    rows = make(spark, clicks(30)).withColumn("shard", F.lit(0))
    seen = []

    def spied(*how):
        run = in_order(*how)

        def look(frames):
            for frame in frames:
                if frame["z"].notna().any():
                    raise AssertionError("cells of an empty state")
                yield from run(iter([frame]))
        return look

    in_order, shards._in_order = shards._in_order, spied
    try:
        seen = shards.train_in_order(st.empty_state(spark), rows, CONFIG, {"shard": "int"}, 1).collect()
    finally:
        shards._in_order = in_order
    assert seen
    some = spark.createDataFrame([(seen[0]["feature"], 0.0, 0.7, 0.2, 1.0, 2.0, 0.0)], st.empty_state(spark).schema)
    moved = shards.train_in_order(some, rows, CONFIG, {"shard": "int"}, 1).collect()
    assert {r["feature"] for r in moved} == {r["feature"] for r in seen}
    assert {r["feature"]: r["z"] for r in moved} != {r["feature"]: r["z"] for r in seen}
