from conftest import rows_of
from pyspark.sql import functions as F

from clickengine.operators import counts, skew


def skewed(spark):
    """Half of 200 rows share key 0; key 7 and the null key have no match."""
    return spark.range(200).select(
        "id",
        F.when(F.col("id") % 2 == 0, F.lit(0)).when(F.col("id") % 19 == 1, F.lit(None))
        .otherwise(F.col("id") % 8).cast("int").alias("key"),
    )


def lookup(spark):
    return spark.createDataFrame([(k, f"v{k}") for k in range(7)], "key int, v string")


def test_sliced_join_equals_plain_join(spark, heavy):
    for how in ("left", "inner"):
        plain = skewed(spark).join(lookup(spark), "key", how).select("id", "key", "v")
        sliced = skew.attach(skewed(spark), lookup(spark), ["key"], ["id"], how, **heavy)
        assert rows_of(sliced, "id", "key", "v") == rows_of(plain)


def test_heavy_key_is_cut_into_slices(spark):
    n = skewed(spark).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    assert rows_of(skew.heavy_keys(n, ["key"], heavy_rows=50, heavy_share=0.1)) == [(0, 2)]


def test_heavy_keys_are_bounded_by_share(spark):
    n = spark.range(1000).select((F.col("id") % 100).alias("key")).groupBy("key").count()
    heavy = skew.heavy_keys(n, ["key"], "count", heavy_rows=0, heavy_share=0.05)
    assert heavy.count() == 0  # a hundred equal keys hold one percent each


def test_stored_lookup_is_broadcast_only_while_small(spark):
    rows, small = skewed(spark), lookup(spark)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    few = skew.attach_stored(rows, small, ["key"], ["id"])
    many = skew.attach_stored(rows, small, ["key"], ["id"], max_rows=3)
    assert "__slice" not in plan(few) and "__slice" in plan(many)
    assert rows_of(few, "id", "v") == rows_of(many, "id", "v")


def test_lagged_counts_do_not_depend_on_slicing(spark, heavy):
    log = spark.range(300).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 11)).alias("user_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") / 25) * 3600).alias("date_time"),
    ).withColumn("dt", F.to_date("date_time"))
    for fn in (counts.with_previous_hour, counts.with_previous_day):
        assert rows_of(fn(log, ["user_id"], ["id"])) == rows_of(fn(log, ["user_id"], ["id"], **heavy))
