"""Time columns of logs whose hour is packed as ``yyMMddHH``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def packed_year(hour: str | Column) -> Column:
    return F.concat(F.lit("20"), F.substring(_text(hour), 1, 2))


def packed_month(hour: str | Column) -> Column:
    return F.substring(_text(hour), 3, 2)


def packed_day(hour: str | Column) -> Column:
    return F.substring(_text(hour), 5, 2)


def packed_hour_of_day(hour: str | Column) -> Column:
    return F.substring(_text(hour), 7, 2)


def packed_timestamp(hour: str | Column) -> Column:
    """The start of the packed hour; null when the text is no time.

    Built from numbers: parsing text with a pattern costs several times as much.
    """
    year, month, day, of_day = (
        part(hour).try_cast("int")
        for part in (packed_year, packed_month, packed_day, packed_hour_of_day)
    )
    zero = F.lit(0)
    return F.try_make_timestamp(year, month, day, of_day, zero, zero.cast("decimal(16,6)"))


def packed_date(hour: str | Column) -> Column:
    return packed_timestamp(hour).cast("date")


def hour_of_day(ts: str | Column) -> Column:
    """Two-digit hour of a timestamp."""
    return F.date_format(ts, "HH")


def weekday(date: str | Column) -> Column:
    """Day of week counted from 0 for Sunday."""
    return F.dayofweek(date) - F.lit(1)


def with_time_columns(log: DataFrame) -> DataFrame:
    """``date_time`` and ``dt`` from the packed ``hour``."""
    return log.withColumn("date_time", packed_timestamp("hour")).withColumn(
        "dt", F.col("date_time").cast("date")
    )


def day_range(day: int | str) -> Column:
    """All hours of one packed day, as a range on the partition column so that scans prune."""
    first = int(day) * 100
    return F.col("hour").between(first, first + 23)
