from conftest import rows_of
from pyspark.sql import functions as F
from test_sources import line

from clickengine.functions import binning, identity, times
from clickengine.functions.times import with_time_columns
from clickengine.operators import bags, topics
from clickengine.operators.counts import past_rate
from clickengine.plans import feature_sets as sets
from clickengine.plans import prepare
from clickengine.sources.logs import LABELLED_COLUMNS


def raw(spark, rows):
    """Raw log rows from a few given columns."""
    base = dict(zip(LABELLED_COLUMNS, line(0).split(",")))
    return spark.createDataFrame([tuple({**base, **r}[c] for c in LABELLED_COLUMNS) for r in rows],
                                 ", ".join(f"{c} string" for c in LABELLED_COLUMNS))


def test_identity(spark):
    log = identity.with_identity(raw(spark, [
        {"id": "1", "device_id": "a99f214a", "device_ip": "ip", "device_model": "m", "app_id": "ecad2386",
         "site_id": "s", "site_domain": "sd", "site_category": "sc"},
        {"id": "2", "device_id": "d", "app_id": "a", "app_domain": "ad", "app_category": "ac"}]))
    assert rows_of(log, "id", "user_id", "pub_id", "pub_domain", "pub_category") == [
        ("1", "ipm", "s", "sd", "sc"), ("2", "d", "a", "ad", "ac")]
    assert not set(identity.IDENTITY_SOURCES) & set(log.columns)


def test_composite_key_tells_neighbours_apart(spark):
    df = spark.createDataFrame([("1", "23"), ("12", "3"), ("1", None)], "a string, b string")
    assert len({r[0] for r in df.select(identity.composite_key(["a", "b"])).collect()}) == 3


def test_times(spark):
    df = spark.createDataFrame([("14102123",), ("bad",)], "hour string")
    got = df.select(F.date_format(times.packed_timestamp("hour"), "yyyy-MM-dd HH:mm:ss"),
                    times.packed_date("hour").cast("string"), times.weekday(times.packed_date("hour")),
                    times.hour_of_day(times.packed_timestamp("hour")))
    assert rows_of(got) == [("2014-10-21 23:00:00", "2014-10-21", 2, "23"), (None, None, None, None)]


def test_bins(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (19,), (20,)], "n int")
    assert [r[0] for r in df.orderBy("n").select(binning.log_bin("n")).collect()] == [0, 0, 1, 2, 3]
    rule = binning.heavy_user(F.lit("me"), "n", 20)
    assert [r[0] for r in df.orderBy("n").select(rule).collect()] == ["0", "1", "2", "19", "me"]


def small_log(spark):
    rows = [{"id": str(i), "click": str(i % 2), "device_id": f"d{i % 3}", "hour": f"1410{21 + i // 8}{i % 4:02d}",
             "app_id": f"a{i % 2}", "C14": str(i % 3), "C17": str(i % 2)} for i in range(24)]
    return identity.with_identity(raw(spark, rows))


def test_prepared_log_does_not_depend_on_slicing(spark, heavy):
    plain, sliced = prepare.prepare_log(small_log(spark)), prepare.prepare_log(small_log(spark), **heavy)
    assert plain.count() == 24 and rows_of(plain) == rows_of(sliced, *plain.columns)
    columns = ["id", *prepare.COUNTED_KEYS.values(), "user_count", "user_hour_count"]
    whole = rows_of(prepare.prepare_with_day_counts(small_log(spark)), *columns)
    counted = prepare.prepare_with_day_counts(small_log(spark), **heavy)
    assert len(whole) == 16 and rows_of(counted, *columns) == whole


def test_feature_sets_stay_in_their_ranges(spark):
    log = prepare.prepare_log(small_log(spark))
    bag = sets.to_examples(log, sets.bag_features())
    row = bag.orderBy("seq").first()
    assert (row["example_id"], row["label"]) == ("0", 0)
    spaces = sorted(k // 1000000 for k in row["features"])
    assert spaces == [0, 0, 1, 2, 3, 4, 4] and set(row["features"].values()) == {1.0}
    counted = prepare.prepare_with_day_counts(small_log(spark))
    keys = counted.select(F.explode(F.map_keys(sets.count_features()))).distinct()
    assert keys.agg(F.max("col")).first()[0] < 600000


def test_topics(spark):
    log = small_log(spark)
    shares = topics.user_topics(log, item="C14", num_features=64, iterations=2)
    rows = shares.collect()
    assert len(rows) == 3 and all(abs(sum(r["topics"]) - 1) < 1e-6 and len(r["topics"]) == 10 for r in rows)
    some = shares.where("user_id <> 'd0'")
    assert topics.with_topics(log, some, ["id"]).count() == 16
    filled = topics.with_default_topics(log, some, ["id"])
    assert filled.count() == 24
    assert filled.where("user_id = 'd0'").first()["topics"] == [0.0] * 10
    wide = prepare.prepare_with_topics(log, shares)
    assert sets.to_examples(wide, sets.topic_features()).count() == 24


def test_term_counts_are_one_row_per_user_and_bucket(spark):
    runs = bags.bag_runs(small_log(spark), "user_id", "C14")
    counts = topics.term_counts(runs, "user_id", "C14", num_features=2)
    assert counts.agg(F.sum("n")).first()[0] == 24 and counts.count() <= 6
    vectors = topics.term_vectors(counts, "user_id", num_features=2).collect()
    assert sum(v["features"].toArray().sum() for v in vectors) == 24


def test_a_row_without_hour_keeps_its_bag(spark):
    rows = [{"id": "1", "device_id": "d", "hour": "14102100", "app_id": "a", "click": "0", "C14": "1", "C17": "1"},
            {"id": "2", "device_id": "d", "hour": "junk", "app_id": "a", "click": "0", "C14": "1", "C17": "1"}]
    got = prepare.prepare_log(identity.with_identity(raw(spark, rows))).orderBy("id").collect()
    assert got[0]["bag_id"] == got[1]["bag_id"] is not None and got[1]["hour_count"] is None


def test_a_stored_topic_model_gives_the_same_shares(spark, tmp_path):
    log = small_log(spark)
    path = str(tmp_path / "topics")
    shares = topics.user_topics(log, item="C14", num_features=64, iterations=3, k=3, model_path=path)
    again = topics.topics_of(log, path, item="C14")
    for a, b in zip(shares.orderBy("user_id").collect(), again.orderBy("user_id").collect(), strict=True):
        assert a.user_id == b.user_id and all(abs(x - y) < 1e-9 for x, y in zip(a.topics, b.topics, strict=True))


def test_users_of_disjoint_vocabularies_have_topics_apart(spark):
    rows = [(f"u{u}", f"w{u % 2}-{(u * 7 + i * i) % 9}") for u in range(60) for i in range(25)]
    log = spark.createDataFrame(rows, "user_id string, item string")
    tf = topics.term_vectors(topics.term_counts(bags.bag_runs(log, "user_id", "item"), "user_id", "item", 1024), "user_id", 1024)
    few, many = (topics.fit_topics(tf, 2, n) for n in (1, 40))
    # The bound on the likelihood of the data grows with the iterations.
    assert many.logLikelihood(tf) > few.logLikelihood(tf)
    largest = {r.user_id: max(range(2), key=lambda k: r.topics[k]) for r in topics.topic_shares(many, tf, "user_id").collect()}
    sides = [{largest[f"u{u}"] for u in range(60) if u % 2 == side} for side in range(2)]
    assert all(len(s) == 1 for s in sides) and len(set.union(*sides)) == 2


def test_vectors_are_sparse_and_whole(spark):
    counts = spark.createDataFrame([("a", 5, 2), ("a", 1, 3), ("b", 7, 1)], "user_id string, bucket long, n long")
    got = {r.user_id: r.features for r in topics.term_vectors(counts, "user_id", 16).collect()}
    assert got["a"].size == 16 and got["a"].indices.tolist() == [1, 5] and got["a"].values.tolist() == [3.0, 2.0]
    assert got["b"].indices.tolist() == [7]


def test_rates_of_all_keys_come_from_one_scan(spark):
    log = small_log(spark)
    wide = prepare.prepare_with_rates(log)
    timed = with_time_columns(log)
    for key, name in prepare.RATED_KEYS.items():
        alone = {(r[key], r["dt"]): r[name] for r in past_rate(timed, [key], "dt", "click", name).collect()}
        assert all(r[name] == alone[r[key], r["dt"]] for r in wide.collect())
    plan = prepare.rate_history(timed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_feature_sets_deal_their_rows_anew(spark):
    """A row becomes many, so it does not matter in which tasks the rows before were."""
    from clickengine.operators import features as feat
    from clickengine.plans.catalog.features import _set_rows

    log = spark.range(50).coalesce(1).selectExpr("CAST(id AS STRING) AS id", "CAST(id AS DOUBLE) AS x")
    found = _set_rows(log, feat.as_map([feat.numbered(5, F.col("x")), feat.numbered(6, F.col("x"))]))
    assert "REBALANCE_PARTITIONS" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((int(r["id"]), r["feature"], r["value"]) for r in found.collect()) == [
        (i, f, float(i)) for i in range(50) for f in (5, 6)]


def test_topics_are_rounded_before_they_become_many_features(spark, tmp_path):
    """Ten roundings a row, not one for each of the exploded features."""
    from clickengine.plans.catalog.features import topic_feature_set

    spark.range(40).selectExpr(
        "id AS event_id", "TIMESTAMP '2014-10-21 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts", "id % 6 AS user_id", "'view' AS event_type",
        "id * 1.7D AS value", "concat('{\"k\": ', id, '}') AS props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(2).selectExpr(
        "id AS vec_id", "transform(sequence(0, 19), i -> CAST((i + id) / 7 AS FLOAT)) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    made = topic_feature_set(spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") == 1 and "round(value" not in plan and "conv(" not in plan
    rows = made.collect()
    assert len({r["id"] for r in rows}) == 40 and all(r["value"] == round(r["value"], 6) for r in rows)
    assert {r["value"] for r in rows} > {0.0, 1.0}
