"""Counts per key, and counts of an earlier period joined to the rows of a later one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import attach, attach_stored


def count_by(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def hour_counts(df: DataFrame, keys: list[str], ts: str = "date_time") -> DataFrame:
    """Rows per key and hour window: ``window_start``, ``window_end``, ``n``."""
    counts = df.groupBy(*keys, F.window(ts, "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select(
        *keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"
    )


def with_previous_hour(
    df: DataFrame, keys: list[str], spread: list[str], ts: str = "date_time",
    name: str = "hour_count", **heavy,
) -> DataFrame:
    """Add the number of rows of the same key in the hour before; null when there were none.

    ``ts`` must be the start of the hour, so it is the window's start already. The counts
    of an hour serve twice: shifted by one window they are the lookup, unshifted they
    tell which (key, hour) is heavy.
    """
    counts = count_by(df, [*keys, ts])
    lookup = counts.select(
        *keys, (F.col(ts) + F.expr("INTERVAL 1 HOUR")).alias(ts), F.col("n").alias(name)
    )
    return attach(df, lookup, [*keys, ts], spread, counts=counts, **heavy)


def with_previous_day(
    df: DataFrame, keys: list[str], spread: list[str], dt: str = "dt",
    name: str = "day_count", **heavy,
) -> DataFrame:
    """Add the number of rows of the same key on the calendar day before, or null."""
    counts = count_by(df, [*keys, dt])
    lookup = counts.select(*keys, F.date_add(dt, 1).alias(dt), F.col("n").alias(name))
    return attach(df, lookup, [*keys, dt], spread, counts=counts, **heavy)


def user_history(df: DataFrame, key: str, ts: str = "date_time") -> DataFrame:
    """(key, ts, hour_count, day_count): the key's rows in the hour and on the day before.

    Both counts come from one table of rows per key and hour, through frames that reach
    exactly one hour or one day back, so a log needs a single join to get both. A key's
    window holds one row per hour of log, however many rows the key has.
    """
    hourly = df.dropna(subset=[key, ts]).groupBy(key, ts).agg(F.count(F.lit(1)).alias("n"))
    numbered = hourly.withColumn("__hour", F.floor(F.unix_timestamp(ts) / 3600)).withColumn(
        "__day", F.floor(F.unix_timestamp(ts) / 86400)
    )
    def back(step: str):
        return Window.partitionBy(key).orderBy(step).rangeBetween(-1, -1)

    return numbered.select(
        key, ts, "n",
        F.sum("n").over(back("__hour")).alias("hour_count"),
        F.sum("n").over(back("__day")).alias("day_count"),
    )


def available_periods(df: DataFrame, period: str) -> DataFrame:
    """(period, previous, following, rank) of the periods that have rows, in order.

    One row per calendar day or hour, whatever the number of log rows; a hundred years of
    hours are under a million rows. That is why the window may be global and the table
    may be broadcast; ``period`` must be such a column.
    """
    order = Window.orderBy(period)
    return df.select(period).distinct().select(
        period,
        F.lag(period).over(order).alias("previous"),
        F.lead(period).over(order).alias("following"),
        F.row_number().over(order).alias("rank"),
    )


def with_previous_available(
    df: DataFrame, keys: list[str], spread: list[str], period: str, name: str,
    extra: list[str] | None = None, stored: bool = False, **heavy,
) -> DataFrame:
    """Add the key's row count in the last period that had any rows at all.

    Unlike the calendar lag, a day without log does not break the chain. ``extra`` are
    further key columns (such as the hour of day). Rows of the first period get null.
    ``stored`` materialises the counts first, so that a short table can be measured and
    broadcast instead of shuffling the rows.
    """
    on = [*keys, *(extra or [])]
    counts = count_by(df, [*on, period])
    following = available_periods(df, period).where(F.col("following").isNotNull()).select(
        period, "following"
    )
    lookup = counts.join(F.broadcast(following), period).select(
        *on, F.col("following").alias(period), F.col("n").alias(name)
    )
    if stored:
        return attach_stored(df, cut_lineage(lookup), [*on, period], spread, counts=counts, **heavy)
    return attach(df, lookup, [*on, period], spread, counts=counts, **heavy)


def past_rate(df: DataFrame, keys: list[str], dt: str, label: str, name: str = "rate") -> DataFrame:
    """Mean label per key over all days before ``dt``; null on the key's first day.

    Days are summed first, so the window sees one row per key and day.
    """
    daily = df.groupBy(*keys, dt).agg(
        F.sum(F.col(label).cast("bigint")).alias("__pos"), F.count(F.lit(1)).alias("__all")
    )
    before = Window.partitionBy(*keys).orderBy(dt).rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(
        *keys, dt,
        F.sum("__all").over(before).alias("past_rows"),
        F.try_divide(
            F.sum("__pos").over(before).cast("double"), F.sum("__all").over(before).cast("double")
        ).alias(name),
    )


def distinct_sorted(df: DataFrame, column: str, prefix: int | None = None) -> DataFrame:
    """Distinct values in ascending order, optionally of the first ``prefix`` characters."""
    value = F.col(column)
    if prefix is not None:
        value = F.substring(value.cast("string"), 1, prefix)
    return df.select(value.alias(column)).distinct().orderBy(column)
