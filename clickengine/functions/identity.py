"""Who saw the ad and where: user and publisher identity of a raw log row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the public click log.
UNKNOWN_DEVICE = "a99f214a"
NOT_AN_APP = "ecad2386"
IDENTITY_SOURCES = [
    "app_id", "site_id", "app_domain", "site_domain", "app_category", "site_category",
    "device_id", "device_ip", "device_model",
]
IMPRESSION_PARTS = [
    "banner_pos", "device_type", "device_conn_type",
    "C14", "C15", "C16", "C17", "C18", "C19", "C20", "C21",
]


def user_identity() -> Column:
    """The device, or ip and model together where the device is unknown."""
    return F.when(
        F.col("device_id") == UNKNOWN_DEVICE, F.concat("device_ip", "device_model")
    ).otherwise(F.col("device_id"))


def publisher(part: str) -> Column:
    """``part`` (id, domain, category) of the site, or of the app when the row is an app's."""
    return F.when(F.col("app_id") == NOT_AN_APP, F.col(f"site_{part}")).otherwise(
        F.col(f"app_{part}")
    )


def with_identity(log: DataFrame, drop_sources: bool = True) -> DataFrame:
    out = log.select(
        "*",
        user_identity().alias("user_id"),
        publisher("id").alias("pub_id"),
        publisher("domain").alias("pub_domain"),
        publisher("category").alias("pub_category"),
    )
    return out.drop(*IDENTITY_SOURCES) if drop_sources else out


def composite_key(parts: list[str] = IMPRESSION_PARTS, separator: str = "|") -> Column:
    """One key from several columns. The separator keeps (1, 23) and (12, 3) apart."""
    return F.concat_ws(separator, *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
