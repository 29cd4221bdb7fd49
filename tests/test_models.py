import math
from dataclasses import replace

import plain
import pytest
from conftest import close, rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from clickengine.functions import logistic as L
from clickengine.operators import metrics, state as st, steps
from clickengine.operators.shards import partition_keys, shard_step, train_shards

CONFIG = L.FtrlConfig(alpha=0.7, beta=1.0, l1=0.3, l2=0.1)


def make(spark, rows):
    """(label, features) pairs as examples, numbered in order."""
    return spark.createDataFrame(
        [(i, i, y, {int(k): float(v) for k, v in x.items()}) for i, (y, x) in enumerate(rows)],
        "example_id long, seq long, label int, features map<long,double>",
    )


def clicks(n=60):
    """Feature 0 is in every example, 1..4 in some, label follows 1 and 2."""
    out = []
    for i in range(n):
        x = {0: 1.0, 1 + i % 4: 1.0 + (i % 3) / 2}
        if i % 5 == 0:
            x[9] = -0.5
        out.append((int(i % 4 in (0, 1) and i % 7 != 0), x))
    return out


def as_dict(state, *columns):
    return {r["feature"]: tuple(r[c] for c in columns) for r in state.collect()}


def plain_dict(state):
    return {f: (s["z"], s["n"], s["p"], s["m"]) for f, s in state.items()}


def one_value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_soft_threshold_edges(spark):
    rates = replace(CONFIG, l1=2.0).columns()
    w = lambda z: one_value(spark, L.weight(F.lit(z), F.lit(4.0), rates))
    assert w(2.0) == w(-2.0) == w(0.0) == 0.0
    assert w(3.0) == pytest.approx(-1 / (3 / 0.7 + 0.1))
    assert w(-3.0) == -w(3.0)


def test_probability_is_clipped_at_both_ends(spark):
    p = lambda m: one_value(spark, L.clipped(L.sigmoid(F.lit(m))))
    assert p(800.0) == 0.999999999999 and p(-800.0) == 0.0000000000001 and p(0.0) == 0.5
    assert one_value(spark, L.log_loss(F.lit(1), L.clipped(L.sigmoid(F.lit(-800.0))))) == -math.log(1e-13)


def test_three_examples_by_hand(spark):
    """alpha 1, beta 1, no penalties: p = 0.5 for the first example, so g = -0.5 x."""
    c = L.FtrlConfig(alpha=1.0, beta=1.0)
    s = st.empty_state(spark)
    s = steps.ftrl_step(s, make(spark, [(1, {1: 1.0})]), c)
    assert close(as_dict(s, "z", "n", "w"), {1: (-0.5, 0.25, 0.5 / 1.5)})
    s = steps.ftrl_step(s, make(spark, [(0, {2: 2.0})]), c)
    assert close(as_dict(s, "z", "n", "w"), {1: (-0.5, 0.25, 1 / 3), 2: (1.0, 1.0, -0.5)})
    p = 1 / (1 + math.exp(-(1 / 3 - 0.5)))
    g = p - 1
    s = steps.ftrl_step(s, make(spark, [(1, {1: 1.0, 2: 1.0})]), c)
    z1 = -0.5 + g - (math.sqrt(0.25 + g * g) - 0.5) / 3
    z2 = 1.0 + g + (math.sqrt(1 + g * g) - 1.0) * 0.5
    got = as_dict(s, "z", "n", "g_sum")
    assert close(got, {1: (z1, 0.25 + g * g, -0.5 + g), 2: (z2, 1 + g * g, 1.0 + g)})


@pytest.mark.parametrize("counted", [False, True])
@pytest.mark.parametrize("sign", [-1, 1])
def test_batches_equal_the_plain_update(spark, heavy, counted, sign):
    c = replace(CONFIG, sigma_sign=sign)
    rows = clicks()
    want = plain.batch_step(plain.batch_step({}, rows[:25], c, counted), rows[25:], c, counted)
    first = steps.ftrl_step(st.empty_state(spark), make(spark, rows[:25]), c, counted=counted, **heavy)
    for how in (heavy, {"stored": True}):
        second = steps.ftrl_step(first, make(spark, rows[25:]), c, counted=counted, **how)
        assert close(as_dict(second, "z", "n", "p_count", "n_count"), plain_dict(want))


def test_square_of_the_batch_gradient(spark):
    """Both kinds agree on one example; on many equal ones the second does not overshoot."""
    rows = [(1, {1: 1.0})] * 400
    weights = {}
    for kind in ("example", "batch"):
        c = L.FtrlConfig(alpha=1.0, square=kind)
        one = steps.ftrl_step(st.empty_state(spark), make(spark, rows[:1]), c)
        many = steps.ftrl_step(st.empty_state(spark), make(spark, rows), c)
        weights[kind] = as_dict(one, "w")[1][0], as_dict(many, "w")[1][0]
    assert weights["example"][0] == weights["batch"][0] == pytest.approx(1 / 3)
    assert weights["example"][1] == pytest.approx(200 / 11)
    assert weights["batch"][1] == pytest.approx(200 / 201)


def test_batches_of_one_are_the_sequential_update(spark):
    rows = clicks(6)
    s = st.empty_state(spark)
    for row in rows:
        s = spark.createDataFrame(steps.ftrl_step(s, make(spark, [row]), CONFIG).collect(), s.schema)
    want = plain.sequential({}, rows, CONFIG)
    assert close(as_dict(s, "z", "n", "p_count", "n_count"), plain_dict(want))


def test_example_without_features_scores_half(spark):
    out = steps.predict(make(spark, [(1, {}), (0, {3: 1.0})]), st.empty_state(spark), carry=["label"])
    assert rows_of(out, "example_id", "margin", "prob", "predicted") == [(0, 0.0, 0.5, 1), (1, 0.0, 0.5, 1)]


def test_grid_equals_models_trained_alone(spark):
    grid = [CONFIG, replace(CONFIG, alpha=0.1, l1=0.0), replace(CONFIG, beta=3.0, sigma_sign=1, square="batch")]
    rows = make(spark, clicks())
    both = st.empty_state(spark, {"config_id": "bigint"})
    for _ in range(2):
        both = steps.ftrl_step(both, rows, grid)
    for i, c in enumerate(grid):
        alone = st.empty_state(spark)
        for _ in range(2):
            alone = steps.ftrl_step(alone, make(spark, clicks()), c)
        assert close(as_dict(both.where(f"config_id = {i}"), "w", "z", "n"), as_dict(alone, "w", "z", "n"))


def test_ogd_and_plain_gradient(spark):
    rows = clicks(20)
    w = steps.ogd_step(st.empty_state(spark), make(spark, rows), 4)
    g = {}
    for y, x in rows:
        for f, v in x.items():
            g[f] = g.get(f, 0.0) + (0.5 - y) * v
    assert close(as_dict(w, "w"), {f: (-v / 2,) for f, v in g.items()})
    again = steps.gradient_descent_step(w, make(spark, []), 1.0)
    assert close(as_dict(again, "w"), as_dict(w, "w"))


def test_zero_overwrites_and_publishing_drops_it(spark):
    def state(rows):
        return st.seeded_state(spark.createDataFrame(rows, "feature long, w double, z double"))

    merged = st.upsert(state([(1, 0.5, 1.0), (2, 0.7, 1.0)]), state([(1, 0.0, 0.1), (3, 0.2, 0.0)]))
    assert as_dict(merged, "w") == {1: (0.0,), 2: (0.7,), 3: (0.2,)}
    assert as_dict(st.published(merged), "w") == {2: (0.7,), 3: (0.2,)}
    assert st.nonzero_count(merged).first()[0] == 2
    assert rows_of(st.weight_of(merged, [2])) == [(2, 0.7)]


def test_seeded_rates(spark):
    given_state = spark.createDataFrame([(1, 3.0, 1.0), (2, 2.0, 0.0)], "feature long, p_count double, n_count double")
    assert as_dict(st.seeded_state(given_state), "n", "z") == {1: (0.75, 0.0), 2: (0.0, 0.0)}


def test_merged_counts_stay_in_their_columns(spark):
    def counts(rows):
        return spark.createDataFrame(rows, "feature long, p_count double, n_count double")

    merged = st.merge_counts(counts([(1, 1.0, 2.0), (2, 5.0, 0.0)]), counts([(1, 10.0, 20.0)]))
    assert as_dict(merged, "p_count", "n_count") == {1: (11.0, 22.0), 2: (5.0, 0.0)}


def test_average_of_shards(spark):
    """Feature 1 known, seen by one of four shards; 2 new, seen by two; 3 known, seen by none."""
    state = st.seeded_state(spark.createDataFrame(
        [(1, 1.0, 4.0, 1.0, 1.0), (3, 2.0, 3.0, 2.0, 2.0)],
        "feature long, w double, z double, p_count double, n_count double"))
    trained = spark.createDataFrame(
        [(0, 1, 5.0, 8.0, 1.0, 0.0, 0.5), (0, 2, 1.0, 2.0, 1.0, 0.0, 0.0), (1, 2, 3.0, 4.0, 0.0, 1.0, 0.0)],
        "shard int, feature long, w double, z double, p_new double, n_new double, g_new double")
    merged = st.average_shards(state, trained, 4)
    got = as_dict(merged, "w", "z", "p_count", "n_count", "n")
    assert close(got, {1: (2.0, 5.0, 2.0, 1.0, 2 / 3), 2: (2.0, 3.0, 1.0, 1.0, 0.5), 3: (2.0, 3.0, 2.0, 2.0, 1.0)})


def shards_by_hand(spark, state, rows, shards):
    """The shard of each example from Spark's hash, the rest in plain Python."""
    numbers = [r[0] for r in make(spark, rows).orderBy("seq").select(
        F.pmod(F.xxhash64("example_id"), F.lit(shards))).collect()]
    results = []
    for s in range(shards):
        mine = [r for r, k in zip(rows, numbers) if k == s]
        seen = {f for _, x in mine for f in x}
        start = {f: {**v, "n": plain.counted(v["p"], v["m"])} for f, v in state.items() if f in seen}
        results.append({f: v for f, v in plain.sequential(start, mine, CONFIG, True).items() if f in seen})
    return results


def test_shards_equal_plain_sequential_training(spark, heavy):
    rows, shards = clicks(80), 3
    empty = st.empty_state(spark)
    first = shard_step(empty, make(spark, rows), CONFIG, shards, **heavy)
    by_hand = shards_by_hand(spark, {}, rows, shards)
    want = {}
    for f in {f for r in by_hand for f in r}:
        have = [r[f] for r in by_hand if f in r]
        want[f] = (sum(plain.weight(s["z"], s["n"], CONFIG) for s in have) / len(have),
                   sum(s["z"] for s in have) / len(have),
                   sum(s["p"] for s in have), sum(s["m"] for s in have))
    assert close(as_dict(first, "w", "z", "p_count", "n_count"), want)

    start = {f: {"z": v[1], "n": plain.counted(v[2], v[3]), "p": v[2], "m": v[3]} for f, v in want.items()}
    later = [(y, {**x, 50: 1.0}) for y, x in rows[:30]]
    second = train_shards(first, make(spark, later), CONFIG, shards)
    got = {(r["shard"], r["feature"]): (r["w"], r["z"]) for r in second.collect()}
    again = shards_by_hand(spark, start, later, shards)
    assert close(got, {(s, f): (plain.weight(v["z"], v["n"], CONFIG), v["z"])
                       for s, r in enumerate(again) for f, v in r.items()})


def test_result_does_not_depend_on_the_order_rows_arrive_in(spark):
    rows = make(spark, clicks(50))
    a = train_shards(st.empty_state(spark), rows.orderBy("seq"), CONFIG, 4)
    b = train_shards(st.empty_state(spark), rows.orderBy(F.desc("seq")).repartition(7), CONFIG, 4)
    assert rows_of(a) == rows_of(b)


def test_every_shard_has_a_task_of_its_own(spark):
    keys = partition_keys(spark, 8)
    parts = spark.createDataFrame([(k,) for k in keys], "k long").repartition(8, "k").select(F.spark_partition_id())
    assert sorted(r[0] for r in parts.collect()) == list(range(8))


@pytest.mark.parametrize("block", ["10", "10000"])
def test_order_does_not_depend_on_the_blocks_rows_come_in(spark, block):
    rows = clicks(200)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", block)
    try:
        got = as_dict(train_shards(st.empty_state(spark), make(spark, rows).orderBy(F.desc("seq")), CONFIG, 1), "z")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = plain.sequential({}, rows, CONFIG, True)
    assert close(got, {f: (v["z"],) for f, v in want.items()})


scored_rows = hs.lists(hs.tuples(hs.integers(0, 1), hs.floats(0.001, 0.999), hs.floats(0, 5)),
                       min_size=1, max_size=30)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(scored_rows)
def test_metrics(spark, scored):
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(scored)],
                               "example_id int, label int, prob double, loss double")
    got = metrics.evaluate(df).first()
    assert got["rows"] == len(scored)
    assert (got["loss"], got["accuracy"], got["auc"]) == pytest.approx(plain.metrics(scored))


def test_metrics_of_one_class_and_of_nothing(spark):
    schema = "example_id int, label int, prob double, loss double"
    one = metrics.evaluate(spark.createDataFrame([(1, 1, 0.9, 0.1), (2, 1, 0.2, 1.6)], schema)).first()
    assert one["auc"] == 0.0 and one["accuracy"] == 0.5
    none = metrics.evaluate(spark.createDataFrame([], schema)).first()
    assert (none["rows"], none["loss"], none["accuracy"], none["auc"]) == (0, None, None, 0.0)


def test_rolling_metrics_equal_the_last_rows(spark):
    scored = [(i % 3 % 2, (i * 37 % 100) / 100, (i * 11 % 13) / 10) for i in range(45)]
    df = spark.createDataFrame([(i, i, *s) for i, s in enumerate(scored)],
                               "idx long, example_id long, label int, prob double, loss double")
    for r in metrics.rolling_metrics(df, 10).collect():
        want = plain.metrics(scored[max(0, r["idx"] - 9): r["idx"] + 1])
        assert (r["loss"], r["accuracy"], r["auc"]) == pytest.approx(want)


def test_documents_are_dealt_evenly_before_their_words_are_hashed(spark, tmp_path):
    from clickengine.plans.catalog import QUERIES

    docs = [(i, " ".join(f"w{j % 7}" for j in range(i % 5))) for i in range(40)] + [(None, "w1"), (41, None), (3, "w1 w2")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 40, 2)], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    lines = QUERIES["score_submission"](spark, str(tmp_path))
    assert lines._jdf.queryExecution().executedPlan().toString().count("REBALANCE_PARTITIONS") == 1
    ids = [row[0].split(",")[0] for row in lines.collect()]
    assert set(ids) >= {str(i) for i in range(1, 40, 2)}
