"""From raw logs to the tables that training reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import text_hash
from ..functions.identity import IMPRESSION_PARTS, composite_key, with_identity
from ..functions.times import packed_hour_of_day, with_time_columns
from ..operators.bags import bag_set, set_signature
from ..operators.counts import available_periods, past_rate, user_history
from ..operators.skew import attach, attach_stored
from ..operators.topics import user_topics, with_topics
from ..session import new_folder
from ..sources.logs import union_aligned


def clean_log(tables: list[DataFrame]) -> DataFrame:
    """All tables as one log with user and publisher identity."""
    return with_identity(union_aligned(tables))


def user_bags(log: DataFrame, method: str = "xxhash64") -> DataFrame:
    """(user_id, bag_id): the set of a user's publishers as a signature.

    The publishers themselves are ``bag_set(log, "user_id", "pub_id")``, a table of its own.
    """
    pairs = bag_set(log, "user_id", "pub_id")
    return set_signature(pairs, "user_id", text_hash(F.col("pub_id"), method))


def prepare_log(log: DataFrame, method: str = "xxhash64", **heavy) -> DataFrame:
    """A cleaned log with impression key, user bag, and previous hour and day counts.

    Bag and counts meet on the user first, on tables of one row per user and hour; the
    log rows themselves are joined once. A row whose hour does not parse has no counts and, as the
    bag is the user's alone, still gets its bag.
    """
    rows = with_time_columns(log).withColumn("impression", composite_key()).drop(*IMPRESSION_PARTS)
    hourly = rows.where(F.col("user_id").isNotNull())
    history = user_history(rows, "user_id")
    no_hour = hourly.where(F.col("date_time").isNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.lit(NO_HOUR).cast("timestamp").alias("date_time"), "n",
        F.lit(None).cast("bigint").alias("hour_count"), F.lit(None).cast("bigint").alias("day_count"),
    )
    lookup = history.unionByName(no_hour).join(user_bags(rows, method), "user_id", "left").withColumnRenamed(
        "date_time", "__hour")
    keyed = rows.withColumn("__hour", F.coalesce("date_time", F.lit(NO_HOUR).cast("timestamp")))
    return attach(
        keyed, lookup.drop("n"), ["user_id", "__hour"], ["id"],
        counts=lookup.select("user_id", "__hour", "n"), **heavy,
    ).drop("__hour")


# Stands for an hour that does not parse, in joins only.
NO_HOUR = "1900-01-01 00:00:00"

# Key columns whose previous-day counts are joined, with the name of the count.
COUNTED_KEYS = {
    "C14": "c14_count", "C17": "c17_count", "pub_id": "pub_id_count",
    "pub_category": "pub_category_count",
}


def day_history(log: DataFrame) -> DataFrame:
    """Counts of the last day that has log, for all counted keys, from one scan of ``log`` (d, h, keys).

    (kind, key, h, d, n, before, before_hour): ``kind`` names the key column. One aggregate
    counts every key per day, and users per hour. Days are
    numbered without gaps, so the last available day is one step back in a window; a window holds
    one row per day, a user's 24.
    """
    kinds = [*COUNTED_KEYS, "user_id"]
    cells = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key"),
                 (F.col("h") if k == "user_id" else F.lit(None).cast("string")).alias("h"))
        for k in kinds
    ])
    counted = log.select("d", F.explode(cells).alias("c")).groupBy("c.kind", "c.key", "c.h", "d").agg(
        F.count(F.lit(1)).alias("n"))
    ranked = counted.where(F.col("key").isNotNull())
    day_before = Window.partitionBy("kind", "key").orderBy("rank").rangeBetween(-1, -1)
    same_hour = Window.partitionBy("kind", "key", "h").orderBy("rank").rangeBetween(-1, -1)
    days = available_periods(counted.where(F.col("kind") == kinds[0]), "d")
    return ranked.join(F.broadcast(days.select("d", "rank")), "d").select(
        "kind", "key", "h", "d", "n", "rank",
        F.sum("n").over(day_before).alias("before"), F.sum("n").over(same_hour).alias("before_hour"),
    )


def prepare_with_day_counts(log: DataFrame, **heavy) -> DataFrame:
    """A cleaned log with the counts of the previous available day for five keys.

    Rows of the first day are left out, as they have no day before. All counts come from one
    aggregate that is stored, so the log is read twice: for the counts, and to be joined.
    """
    parts = log.withColumn("d", F.substring(F.col("hour").cast("string"), 1, 6)).withColumn(
        "h", packed_hour_of_day("hour")
    )
    path = new_folder(log.sparkSession, "day-counts")
    day_history(parts).write.partitionBy("kind").parquet(path)
    history = log.sparkSession.read.parquet(path)
    rows = parts
    for key, name in COUNTED_KEYS.items():
        lookup = history.where(F.col("kind") == key).select(
            F.col("key").alias(key), "d", F.col("before").alias(name))
        rows = attach_stored(rows, lookup, [key, "d"], ["id"], **heavy)
    users = history.where(F.col("kind") == "user_id").select(
        F.col("key").alias("user_id"), "d", "h", "n",
        F.col("before").alias("user_count"), F.col("before_hour").alias("user_hour_count"))
    rows = attach(rows, users.drop("n"), ["user_id", "d", "h"], ["id"], counts=users.select("user_id", "d", "h", "n"), **heavy)
    first = history.agg(F.min("d"))
    return rows.where(F.col("d") > first.scalar())


# Key columns whose past click rate is joined, with the name of the rate.
RATED_KEYS = {"C14": "c14_rate", "C17": "c17_rate", "pub_id": "pub_id_rate",
              "pub_category": "pub_category_rate"}


def rate_history(timed: DataFrame) -> DataFrame:
    """(kind, key, dt, past_rows, rate) of all rated keys, from one scan of the log; ``kind`` names the key column."""
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in RATED_KEYS])
    keyed = timed.select("dt", "click", F.explode(cells).alias("c")).select("dt", "click", "c.*")
    return past_rate(keyed.where(F.col("key").isNotNull()), ["kind", "key"], "dt", "click")


def prepare_with_rates(log: DataFrame, **heavy) -> DataFrame:
    """A cleaned log with each key's click rate over all earlier days, or null.

    The rates come from one aggregate with a row per key and day, which is stored, so the log is read twice and
    not shuffled for the short ones.
    """
    timed = with_time_columns(log)
    path = new_folder(log.sparkSession, "rates")
    rate_history(timed).drop("past_rows").write.partitionBy("kind").parquet(path)
    history = log.sparkSession.read.parquet(path)
    rows = timed
    for key, name in RATED_KEYS.items():
        rates = history.where(F.col("kind") == key).select(F.col("key").alias(key), "dt", F.col("rate").alias(name))
        rows = attach_stored(rows, rates, [key, "dt"], ["id"], **heavy)
    return rows


def prepare_with_topics(log: DataFrame, topics: DataFrame | None = None, **settings) -> DataFrame:
    """A cleaned log with each user's topics; users without topics are dropped."""
    return with_topics(log, user_topics(log, **settings) if topics is None else topics, ["id"])
