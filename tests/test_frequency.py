from conftest import rows_of
from pyspark.sql import functions as F

from clickengine.operators import frequency


def sightings(spark):
    """Feature 1 seen twice, 2 three times, 3 four times, 9 a hundred times."""
    times = {1: 2, 2: 3, 3: 4, 9: 100}
    rows = [(f, i * 10 + f) for f, n in times.items() for i in range(n)]
    return spark.createDataFrame(rows, "feature long, seq long").orderBy(F.xxhash64("seq"))


def count(df):
    return dict(rows_of(df.groupBy("feature").count()))


def test_total_count_edge(spark, heavy):
    for how in ({}, heavy):
        assert count(frequency.keep_frequent(sightings(spark), 3, ["seq"], **how)) == {2: 3, 3: 4, 9: 100}


def test_from_the_kth_sighting_on(spark, heavy):
    for how in ({}, heavy):
        kept = frequency.keep_after_sightings(sightings(spark), 3, ["seq"], **how)
        assert count(kept) == {2: 1, 3: 2, 9: 98}
        assert kept.agg(F.min("seq")).first()[0] == 22


def test_kth_sighting_is_cut_before_the_shuffle(spark):
    plan = frequency.keep_after_sightings(sightings(spark), 3, ["seq"])
    text = plan._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_sketch_never_counts_too_little(spark):
    rows = sightings(spark)
    table = frequency.count_min_table(rows, "feature", depth=3, width=4)
    assert table.count() <= 12
    low = dict(rows_of(frequency.count_min_estimate(rows, table, "feature", depth=3, width=4)))
    assert all(low[f] >= n for f, n in {1: 2, 2: 3, 3: 4, 9: 100}.items())


def test_sketch_grows_with_the_rows_and_filters(spark, heavy):
    assert frequency.sketch_size(1000, 5) == (5, 544) and frequency.sketch_size(2000, 5)[1] == 1088
    for how in ({}, heavy):
        assert count(frequency.keep_frequent_approx(sightings(spark), 3, ["seq"], **how)) == {2: 3, 3: 4, 9: 100}


def test_rows_of_frequent_features_are_not_shuffled(spark):
    for kept in (frequency.keep_frequent(sightings(spark), 3, ["seq"]),
                 frequency.keep_after_sightings(sightings(spark), 3, ["seq"])):
        assert "SortMergeJoin" not in kept._jdf.queryExecution().sparkPlan().toString()


def test_documents_are_dealt_evenly_before_their_words(spark, tmp_path):
    from clickengine.plans.catalog.features import tokens

    spark.createDataFrame([(1, "a b\na"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = tokens(spark, str(tmp_path))
    assert "REBALANCE_PARTITIONS" in words._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, words.collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "a")]


def test_a_vocabulary_too_large_to_broadcast_keeps_the_same_rows(spark, heavy):
    rows = sightings(spark).withColumn("feature", F.concat(F.lit("w"), F.col("feature").cast("string"))).unionByName(
        spark.createDataFrame([(None, 5), (None, 6), (None, 7)], "feature string, seq long"))
    for limit in ({"max_rows": 0}, {"max_rows": 1}, {"max_rows": 2}, {"max_text": 2}, {}):
        for how in ({}, heavy):
            assert count(frequency.keep_frequent(rows, 3, ["seq"], **limit, **how)) == {"w2": 3, "w3": 4, "w9": 100}
            kept = frequency.keep_after_sightings(rows, 3, ["seq"], **limit, **how)
            assert count(kept) == {"w2": 1, "w3": 2, "w9": 98}
