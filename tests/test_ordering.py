from conftest import rows_of
from pyspark.sql import functions as F

from clickengine.operators import metrics
from clickengine.operators.ordering import every_k, rolling_sums, with_dense_index


def sparse(spark, n=53):
    """Rows whose order numbers have gaps and arrive shuffled."""
    return spark.range(n).select(
        (F.col("id") * F.col("id") * 3).alias("seq"), (F.col("id") % 5).cast("double").alias("v")
    ).orderBy(F.xxhash64("seq"))


def test_dense_index(spark):
    got = [r for r in rows_of(with_dense_index(sparse(spark), ["seq"]), "idx", "seq")]
    assert sorted(got) == [(i, i * i * 3) for i in range(53)]


def test_rolling_sums(spark):
    rolled = rolling_sums(with_dense_index(sparse(spark), ["seq"]), 7, {"total": F.col("v")})
    values = [float(i % 5) for i in range(53)]
    want = [(i, sum(values[max(0, i - 6): i + 1])) for i in range(53)]
    assert sorted(rows_of(rolled, "idx", "total")) == want


def test_every_k(spark):
    rows = with_dense_index(sparse(spark), ["seq"])
    report = every_k(rows, 10, lambda df, by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    assert rows_of(report) == [(i, 10) for i in range(5)] + [(5, 3)]


def test_rolling_metrics_need_no_single_task(spark):
    scored = spark.range(40).select(
        F.col("id").alias("idx"), F.col("id").alias("example_id"), (F.col("id") % 2).alias("label"),
        F.lit(0.4).alias("prob"), F.lit(0.1).alias("loss"))
    plan = metrics.rolling_metrics(scored, 10)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
