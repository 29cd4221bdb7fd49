"""The feature sets that training uses, each as one map column.

Every set is a function of a prepared log; training and scoring call the same function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import heavy_user, log_bin, zero_if_null
from ..functions.hashing import Namespace
from ..functions.times import hour_of_day, packed_date, packed_hour_of_day, weekday
from ..operators.features import (
    as_map, crossed_tag, crossed_values, indicators, named_values, prefixed, vector_entries,
)
from ..operators.topics import TOPICS

# Text prefixes of categorical features.
AD_PREFIXES = {
    "C1": "c1-", "banner_pos": "bp-", "device_type": "dt-", "device_conn_type": "dc-",
    "C15": "c15-", "C16": "c16-", "C18": "c18-", "C19": "c19-", "C20": "c20-", "C21": "c21-",
}
CREATIVE_PREFIXES = {"C14": "c14-", "C17": "c17-"}
PUBLISHER_PREFIXES = {"pub_id": "pId-", "pub_category": "pc-"}
DOMAIN_PREFIX = {"pub_domain": "pd-"}

# Bucket ranges (size, offset) of each set's feature groups.
WHOLE_RANGE = Namespace("all", 2147483647)
TOPIC_SPACES = {
    "topic": Namespace("topic", 100, 0),
    "category": Namespace("category", 1000, 100),
    "cross": Namespace("cross", 500, 1100),
}
RATE_SPACES = {
    "rate": Namespace("rate", 100, 0),
    "user": Namespace("user", 100000, 100),
    "category": Namespace("category", 100000, 110000),
    "cross": Namespace("cross", 100000, 210000),
}
COUNT_SPACES = {
    "user": Namespace("user", 100000, 0),
    "ad": Namespace("ad", 100000, 100000),
    "category": Namespace("category", 100000, 200000),
    "user_hour": Namespace("user_hour", 100000, 300000),
    "ad_hour": Namespace("ad_hour", 100000, 400000),
    "hour": Namespace("hour", 100000, 500000),
}
BAG_SPACES = {
    "user": Namespace("user", 1000000, 0),
    "pub": Namespace("pub", 1000000, 1000000),
    "impression": Namespace("impression", 1000000, 2000000),
    "hour": Namespace("hour", 1000000, 3000000),
    "user_hour": Namespace("user_hour", 1000000, 4000000),
}
# Counts from which a user is a feature of their own.
HEAVY_DAY = 500
HEAVY_HOUR = 30


def category_features(method: str = "xxhash64") -> Column:
    """Day, hour, publisher, ad and topic features over the whole id range."""
    day = F.concat(F.lit("d-"), weekday(packed_date("hour")).cast("string"))
    hour = F.concat(F.lit("h-"), packed_hour_of_day("hour"))
    texts = [day, hour, *prefixed(AD_PREFIXES), *prefixed(CREATIVE_PREFIXES),
             *prefixed(PUBLISHER_PREFIXES), *prefixed(DOMAIN_PREFIX)]
    return as_map(
        indicators(texts, WHOLE_RANGE, method),
        vector_entries("topics", TOPICS, WHOLE_RANGE, method=method),
    )


def topic_features(method: str = "xxhash64") -> Column:
    """User topics, categories, and topics crossed with publisher and ad."""
    topics = vector_entries("topics", TOPICS, TOPIC_SPACES["topic"], method=method)
    texts = (prefixed(AD_PREFIXES) + prefixed(CREATIVE_PREFIXES) + prefixed(PUBLISHER_PREFIXES))
    crossed = prefixed(PUBLISHER_PREFIXES) + prefixed(CREATIVE_PREFIXES) + prefixed({"C21": "c21-"})
    return as_map(
        topics,
        indicators(texts, TOPIC_SPACES["category"], method),
        crossed_values(topics, crossed, TOPIC_SPACES["cross"], method),
    )


RATE_COLUMNS = ["c14_rate", "c17_rate", "pub_id_rate", "pub_category_rate"]


def rate_features(method: str = "xxhash64") -> Column:
    """Past click rates as numbers, alone and crossed with categories."""
    rates = named_values(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in RATE_COLUMNS}, RATE_SPACES["rate"], method
    )
    texts = prefixed(PUBLISHER_PREFIXES) + prefixed(AD_PREFIXES)
    crossed = prefixed(PUBLISHER_PREFIXES) + prefixed(
        {c: AD_PREFIXES[c] for c in ("C15", "C16", "C18", "C19", "C20", "C21")}
    )
    return as_map(
        rates,
        indicators(prefixed({"user_id": "userId"}), RATE_SPACES["user"], method),
        indicators(texts, RATE_SPACES["category"], method),
        crossed_values(rates, crossed, RATE_SPACES["cross"], method),
    )


def _user_texts(day_count: str, hour_count: str) -> list[Column]:
    day, hour = zero_if_null(day_count), zero_if_null(hour_count)
    return [
        F.concat(F.lit("userIdCtr"), heavy_user("user_id", day, HEAVY_DAY)),
        F.concat(F.lit("userIdHctr"), heavy_user("user_id", hour, HEAVY_HOUR)),
    ]


def count_features(method: str = "xxhash64") -> Column:
    """Binned counts of the previous day, categories, and counts crossed with the hour."""
    users = indicators(_user_texts("user_count", "user_hour_count"), COUNT_SPACES["user"], method)
    bins = [
        F.concat(F.lit(name), log_bin(zero_if_null(name)).cast("string"))
        for name in ("c14_count", "c17_count", "pub_id_count", "pub_category_count")
    ]
    ads = indicators(bins, COUNT_SPACES["ad"], method)
    return as_map(
        users,
        ads,
        indicators(prefixed(AD_PREFIXES), COUNT_SPACES["category"], method),
        crossed_tag(ads, F.col("h"), COUNT_SPACES["ad_hour"], method),
        indicators([F.col("h").cast("string")], COUNT_SPACES["hour"], method),
    )


def bag_features(method: str = "xxhash64") -> Column:
    """User counts, the user's publishers, the impression, the hour, users crossed with hour."""
    h = hour_of_day("date_time")
    users = indicators(_user_texts("day_count", "hour_count"), BAG_SPACES["user"], method)
    return as_map(
        users,
        indicators([F.concat(F.lit("pub"), F.col("bag_id").cast("string"))], BAG_SPACES["pub"], method),
        indicators([F.concat(F.lit("imp"), F.col("impression"))], BAG_SPACES["impression"], method),
        indicators([F.concat(F.lit("hour"), h)], BAG_SPACES["hour"], method),
        crossed_tag(users, h, BAG_SPACES["user_hour"], method),
    )


def to_examples(log: DataFrame, features: Column, carry: list[str] | None = None) -> DataFrame:
    """(example_id, seq, label, features, carry); the log's id gives the order of arrival."""
    return log.select(
        F.col("id").alias("example_id"), F.col("id").cast("bigint").alias("seq"),
        F.col("click").cast("int").alias("label"), features.alias("features"), *(carry or []),
    )
