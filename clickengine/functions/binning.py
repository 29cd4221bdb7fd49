"""Counts turned into categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_if_null(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(0))


def log_bin(count: str | Column) -> Column:
    """Whole part of ``ln(count + 1)``."""
    return F.floor(F.log1p(count)).cast("bigint")


def heavy_user(user: str | Column, count: str | Column, limit: int) -> Column:
    """The user's own id once the count reaches ``limit``, else the count as text."""
    user = F.col(user) if isinstance(user, str) else user
    count = F.col(count) if isinstance(count, str) else count
    return F.when(count >= limit, user.cast("string")).otherwise(count.cast("string"))
