import datetime as dt

from conftest import rows_of
from pyspark.sql import functions as F

from clickengine.operators import counts
from clickengine.plans import prepare

D = dt.date


def days(spark):
    """User a on the 1st (twice), 2nd and 4th; nobody on the 3rd."""
    rows = [(1, "a", D(2024, 1, 1)), (2, "a", D(2024, 1, 1)), (3, "a", D(2024, 1, 2)),
            (4, "a", D(2024, 1, 4)), (5, "b", D(2024, 1, 4))]
    return spark.createDataFrame(rows, "id int, user_id string, dt date")


def test_calendar_and_available_day_differ_over_a_gap(spark, heavy):
    calendar = counts.with_previous_day(days(spark), ["user_id"], ["id"], **heavy)
    assert rows_of(calendar, "id", "day_count") == [(1, None), (2, None), (3, 2), (4, None), (5, None)]
    for how in ({}, {"stored": True}, heavy):
        available = counts.with_previous_available(days(spark), ["user_id"], ["id"], "dt", "n", **how)
        assert rows_of(available, "id", "n") == [(1, None), (2, None), (3, 2), (4, 1), (5, None)]


def test_past_rate_leaves_out_the_day_itself(spark):
    rows = days(spark).withColumn("click", (F.col("id") % 2).cast("string"))
    rates = counts.past_rate(rows, ["user_id"], "dt", "click")
    assert rows_of(rates, "user_id", F.col("dt").cast("string"), "past_rows", "rate") == [
        ("a", "2024-01-01", None, None), ("a", "2024-01-02", 2, 0.5),
        ("a", "2024-01-04", 3, 2 / 3), ("b", "2024-01-04", None, None)]


def log(spark):
    hours = ["24010122", "24010123", "24010123", "24010200", "24010223"]
    return spark.createDataFrame([(str(i), "u", h) for i, h in enumerate(hours)],
                                 "id string, user_id string, hour string")


def test_user_history_equals_the_separate_joins(spark):
    from clickengine.functions.times import with_time_columns

    rows = with_time_columns(log(spark))
    both = counts.user_history(rows, "user_id")
    got = rows.join(both, ["user_id", "date_time"])
    one = counts.with_previous_hour(rows, ["user_id"], ["id"])
    other = counts.with_previous_day(rows, ["user_id"], ["id"])
    assert rows_of(got, "id", "hour_count") == rows_of(one, "id", "hour_count")
    assert rows_of(got, "id", "day_count") == rows_of(other, "id", "day_count")
    assert rows_of(got, "id", "hour_count", "day_count") == [
        ("0", None, None), ("1", 1, None), ("2", 1, None), ("3", 2, 3), ("4", None, 3)]


def test_user_day_history(spark):
    rows = log(spark).select("id", "user_id", F.substring("hour", 1, 6).alias("d"),
                             F.substring("hour", 7, 2).alias("h"),
                             *[F.lit("x").alias(k) for k in prepare.COUNTED_KEYS])
    history = prepare.day_history(rows)
    keyed = history.where("kind = 'C14'")
    assert rows_of(keyed, "key", "d", "n", "before") == [("x", "240101", 3, None), ("x", "240102", 2, 3)]
    assert rows_of(history.where("kind = 'user_id'"), "d", "h", "n", "before", "before_hour") == [
        ("240101", "22", 1, None, None), ("240101", "23", 2, None, None),
        ("240102", "00", 1, 3, None), ("240102", "23", 1, 3, 2)]
