"""Queries for identity, time, counts, bags and lagged joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.binning import zero_if_null
from ...functions.identity import composite_key, with_identity
from ...functions.times import (
    day_range, packed_day, packed_hour_of_day, packed_month, packed_year, weekday,
    with_time_columns,
)
from ...operators import counts
from ...operators.bags import bag_runs, bag_set
from ...operators.sampling import by_hash
from ...operators.topics import with_default_topics, with_topics
from ...sources.logs import union_aligned
from .. import prepare
from .base import (
    LOG_SQL, clean, events, md5_hash, query, r6, raw_log, sql6, sql_hash, sql_ts, table,
    text_ts,
)

WITH_LOG = f"WITH {LOG_SQL}\n"


def timed(spark, sf_dir):
    return with_time_columns(clean(spark, sf_dir))


@query("identity_case", WITH_LOG + "SELECT id, user_id FROM clean")
def identity_case(spark, sf_dir):
    return with_identity(raw_log(spark, sf_dir)).select("id", "user_id")


@query("publisher_case", WITH_LOG + "SELECT id, pub_id, pub_domain, pub_category FROM clean")
def publisher_case(spark, sf_dir):
    return clean(spark, sf_dir).select("id", "pub_id", "pub_domain", "pub_category")


@query("project_drop_rename",
       WITH_LOG + "SELECT id, click, hour AS packed_hour, C1, user_id, pub_id, 'train' AS split FROM clean")
def project_drop_rename(spark, sf_dir):
    kept = with_identity(raw_log(spark, sf_dir)).withColumnRenamed("hour", "packed_hour")
    return kept.withColumn("split", F.lit("train")).drop("pub_domain", "pub_category").select(
        "id", "click", "packed_hour", "C1", "user_id", "pub_id", "split"
    )


@query("composite_key", WITH_LOG + "SELECT id, impression FROM clean")
def composite(spark, sf_dir):
    return clean(spark, sf_dir).select("id", composite_key().alias("impression"))


@query("time_parts", WITH_LOG + f"""SELECT id, '20' || substr(hour, 1, 2) AS y, substr(hour, 3, 2) AS mo,
  substr(hour, 5, 2) AS day, h, {sql_ts('date_time')}, CAST(dt AS VARCHAR) AS dt FROM clean""")
def time_parts(spark, sf_dir):
    return timed(spark, sf_dir).select(
        "id", packed_year("hour").alias("y"), packed_month("hour").alias("mo"),
        packed_day("hour").alias("day"), packed_hour_of_day("hour").alias("h"),
        text_ts("date_time"), F.col("dt").cast("string").alias("dt"),
    )


@query("day_of_week", """SELECT event_id, CAST(dayofweek(ts) AS BIGINT) AS weekday,
  strftime(ts, '%H') AS h FROM events""")
def day_of_week(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id", weekday("ts").cast("bigint").alias("weekday"), F.date_format("ts", "HH").alias("h")
    )


@query("hour_window", WITH_LOG + f"""SELECT user_id, {sql_ts('date_time', 'window_start')},
  {sql_ts("date_time + INTERVAL 1 HOUR", 'window_end')}, count(*) AS n
  FROM clean GROUP BY user_id, date_time""")
def hour_window(spark, sf_dir):
    return counts.hour_counts(timed(spark, sf_dir), ["user_id"]).select(
        "user_id", text_ts("window_start"), text_ts("window_end"), "n"
    )


@query("date_shift", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR) AS next_day
  FROM orders""")
def date_shift(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 1).cast("string").alias("next_day")
    )


@query("day_filter", WITH_LOG + "SELECT id, hour, click FROM clean WHERE substr(hour, 1, 6) = '240115'")
def day_filter(spark, sf_dir):
    return clean(spark, sf_dir).withColumn("hour", F.col("hour").cast("int")).where(
        day_range("240115")
    ).select("id", F.col("hour").cast("string").alias("hour"), "click")


@query("hash_sample", f"""SELECT event_id, event_type FROM events
  WHERE {sql_hash('CAST(event_id AS VARCHAR)')} % 1000000 < 300000""")
def hash_sample(spark, sf_dir):
    key = md5_hash(F.col("event_id").cast("string"))
    return by_hash(table(spark, sf_dir, "events"), key, 0.3).select("event_id", "event_type")


@query("count_by_key", WITH_LOG + "SELECT pub_id, count(*) AS pub_id_count FROM clean GROUP BY pub_id")
def count_by_key(spark, sf_dir):
    return counts.count_by(clean(spark, sf_dir), ["pub_id"], "pub_id_count")


@query("count_by_key_hour", WITH_LOG + "SELECT C17, h, count(*) AS c17_hour_count FROM clean GROUP BY C17, h")
def count_by_key_hour(spark, sf_dir):
    log = clean(spark, sf_dir).withColumn("h", packed_hour_of_day("hour"))
    return counts.count_by(log, ["C17", "h"], "c17_hour_count")


@query("user_hour_count", WITH_LOG + "SELECT user_id, hour, count(*) AS hour_count FROM clean GROUP BY ALL")
def user_hour_count(spark, sf_dir):
    return counts.count_by(clean(spark, sf_dir), ["user_id", "hour"], "hour_count")


@query("user_day_count", WITH_LOG + """SELECT user_id, CAST(dt + 1 AS VARCHAR) AS last_day,
  count(*) AS day_count FROM clean GROUP BY ALL""")
def user_day_count(spark, sf_dir):
    log = timed(spark, sf_dir).select("user_id", F.date_add("dt", 1).alias("last_day"))
    return counts.count_by(log, ["user_id", "last_day"], "day_count").withColumn(
        "last_day", F.col("last_day").cast("string")
    )


@query("line_counts", """SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL""")
def line_counts(spark, sf_dir):
    return counts.count_by(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag"])


@query("past_rate_by_key", WITH_LOG + f"""SELECT C14, CAST(dt AS VARCHAR) AS dt,
  CAST(sum(a) OVER w AS BIGINT) AS past_rows, {sql6('sum(p) OVER w / sum(a) OVER w', 'rate')}
  FROM (SELECT C14, dt, count(*) AS a, CAST(sum(CAST(click AS BIGINT)) AS DOUBLE) AS p
        FROM clean GROUP BY C14, dt)
  WINDOW w AS (PARTITION BY C14 ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def past_rate_by_key(spark, sf_dir):
    rates = counts.past_rate(timed(spark, sf_dir), ["C14"], "dt", "click")
    return rates.select("C14", F.col("dt").cast("string").alias("dt"), "past_rows", r6("rate"))


@query("user_bag", WITH_LOG + """SELECT user_id, pub_id, count(*) AS n
  FROM clean WHERE pub_id IS NOT NULL GROUP BY ALL""")
def user_bag(spark, sf_dir):
    return bag_runs(clean(spark, sf_dir), "user_id", "pub_id")


@query("user_set_bag", WITH_LOG + "SELECT DISTINCT user_id, pub_id FROM clean WHERE pub_id IS NOT NULL")
def user_set_bag(spark, sf_dir):
    return bag_set(clean(spark, sf_dir), "user_id", "pub_id")


@query("bag_signature", WITH_LOG + f"""SELECT user_id, bit_xor({sql_hash('pub_id')}) AS bag_id
  FROM (SELECT DISTINCT user_id, pub_id FROM clean) GROUP BY user_id""")
def bag_signature(spark, sf_dir):
    return prepare.user_bags(clean(spark, sf_dir), "md5").select("user_id", "bag_id")


@query("distinct_hours", WITH_LOG + """SELECT 'hour' AS kind, hour AS period FROM clean GROUP BY hour
  UNION ALL SELECT 'day', d FROM clean GROUP BY d""")
def distinct_hours(spark, sf_dir):
    log = clean(spark, sf_dir)
    hours = counts.distinct_sorted(log, "hour").select(F.lit("hour").alias("kind"), F.col("hour").alias("period"))
    days = counts.distinct_sorted(log, "hour", 6).select(F.lit("day").alias("kind"), F.col("hour").alias("period"))
    return hours.union(days)


@query("distinct_pairs", WITH_LOG + "SELECT DISTINCT user_id, pub_id FROM clean")
def distinct_pairs(spark, sf_dir):
    return clean(spark, sf_dir).select("user_id", "pub_id").distinct()


@query("ordered_hours", WITH_LOG + """SELECT hour, position FROM
  (SELECT hour, row_number() OVER (ORDER BY hour) AS position, count(*) OVER () AS hours
   FROM (SELECT DISTINCT hour FROM clean))
  WHERE position <= hours - 24 AND position > hours - 72""")
def ordered_hours(spark, sf_dir):
    """All hours but the last 24, and of those the last 48."""
    periods = counts.available_periods(clean(spark, sf_dir), "hour")
    hours = periods.select("hour", F.col("rank").cast("bigint").alias("position"))
    total = periods.agg(F.count(F.lit(1)))
    return hours.where(
        (F.col("position") <= total.scalar() - 24) & (F.col("position") > total.scalar() - 72)
    )


@query("union_aligned", """SELECT event_id AS id, value AS amount,
    CAST(event_type = 'purchase' AS INTEGER) AS click, 'train' AS split FROM events
  UNION ALL SELECT o_orderkey, o_totalprice, NULL, 'score' FROM orders""")
def union_of_tables(spark, sf_dir):
    train = table(spark, sf_dir, "events").select(
        (F.col("event_type") == "purchase").cast("int").alias("click"), F.col("value").alias("amount"),
        F.col("event_id").alias("id"), F.lit("train").alias("split"),
    )
    unlabelled = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("score").alias("split"),
        F.col("o_totalprice").alias("amount"),
    )
    return union_aligned([train, unlabelled]).select("id", "amount", "click", "split")


HOUR_AGO = """hc AS (SELECT user_id, date_time + INTERVAL 1 HOUR AS date_time, count(*) AS hour_count
  FROM clean GROUP BY ALL)"""
DAY_AGO = """dc AS (SELECT user_id, dt + 1 AS dt, count(*) AS day_count
  FROM (SELECT user_id, dt FROM clean) GROUP BY ALL)"""


@query("prev_hour_count", WITH_LOG + f""", {HOUR_AGO} SELECT id, user_id, hour_count
  FROM clean LEFT JOIN hc USING (user_id, date_time)""")
def prev_hour_count(spark, sf_dir):
    return counts.with_previous_hour(timed(spark, sf_dir), ["user_id"], ["id"]).select(
        "id", "user_id", "hour_count"
    )


@query("prev_day_count", WITH_LOG + f""", {DAY_AGO} SELECT id, user_id, day_count
  FROM clean LEFT JOIN dc USING (user_id, dt)""")
def prev_day_count(spark, sf_dir):
    return counts.with_previous_day(timed(spark, sf_dir), ["user_id"], ["id"]).select(
        "id", "user_id", "day_count"
    )


@query("null_to_zero", WITH_LOG + f""", {DAY_AGO} SELECT id, coalesce(day_count, 0) AS day_count
  FROM clean LEFT JOIN dc USING (user_id, dt)""")
def null_to_zero(spark, sf_dir):
    rows = counts.with_previous_day(timed(spark, sf_dir), ["user_id"], ["id"])
    return rows.select("id", zero_if_null("day_count").alias("day_count"))


@query("prev_available_day", """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS dt FROM orders),
  days AS (SELECT dt, lag(dt) OVER (ORDER BY dt) AS previous FROM (SELECT DISTINCT dt FROM o)),
  n AS (SELECT o_custkey, dt AS previous, count(*) AS day_count FROM o GROUP BY ALL)
  SELECT o_orderkey, o_custkey, day_count FROM o JOIN days USING (dt)
  LEFT JOIN n USING (o_custkey, previous)""")
def prev_available_day(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("dt", F.col("o_orderdate").cast("date"))
    return counts.with_previous_available(
        orders, ["o_custkey"], ["o_orderkey"], "dt", "day_count"
    ).select("o_orderkey", "o_custkey", "day_count")


def _previous_day_sql() -> str:
    ctes, joins, names = [], [], []
    for i, (key, name) in enumerate([*prepare.COUNTED_KEYS.items(), ("user_id", "user_count")]):
        ctes.append(f"n{i} AS (SELECT {key}, d AS previous, count(*) AS {name} FROM clean GROUP BY ALL)")
        joins.append(f"LEFT JOIN n{i} USING ({key}, previous)")
        names.append(name)
    ctes.append("nh AS (SELECT user_id, h, d AS previous, count(*) AS user_hour_count FROM clean GROUP BY ALL)")
    joins.append("LEFT JOIN nh USING (user_id, h, previous)")
    return f"""days AS (SELECT d, lag(d) OVER (ORDER BY d) AS previous FROM (SELECT DISTINCT d FROM clean)),
    {', '.join(ctes)},
    counted AS (SELECT * FROM clean JOIN days USING (d) {' '.join(joins)} WHERE previous IS NOT NULL)"""


PREVIOUS_DAY_SQL = _previous_day_sql()
COUNT_NAMES = [*prepare.COUNTED_KEYS.values(), "user_count", "user_hour_count"]


@query("previous_day_counts", WITH_LOG + f""", {PREVIOUS_DAY_SQL}
  SELECT id, user_id, d, h, {', '.join(f'CAST({n} AS BIGINT) AS {n}' for n in COUNT_NAMES)} FROM counted""")
def previous_day_counts(spark, sf_dir):
    return prepare.prepare_with_day_counts(clean(spark, sf_dir)).select(
        "id", "user_id", "d", "h", *COUNT_NAMES
    )


PREPARED_SQL = f"""{HOUR_AGO}, {DAY_AGO},
  bags AS (SELECT user_id, bit_xor({sql_hash('pub_id')}) AS bag_id
    FROM (SELECT DISTINCT user_id, pub_id FROM clean) GROUP BY user_id),
  prepared AS (SELECT * FROM clean LEFT JOIN bags USING (user_id)
    LEFT JOIN hc USING (user_id, date_time) LEFT JOIN dc USING (user_id, dt))"""


def prepared(spark, sf_dir):
    return prepare.prepare_log(clean(spark, sf_dir), "md5")


@query("prepared_log", WITH_LOG + f""", {PREPARED_SQL} SELECT id, click, user_id, pub_id, pub_domain,
  pub_category, C1, impression, {sql_ts('date_time')}, CAST(dt AS VARCHAR) AS dt, bag_id,
  CAST(hour_count AS BIGINT) AS hour_count, CAST(day_count AS BIGINT) AS day_count FROM prepared""")
def prepared_log(spark, sf_dir):
    return prepared(spark, sf_dir).select(
        "id", "click", "user_id", "pub_id", "pub_domain", "pub_category", "C1", "impression",
        text_ts("date_time"), F.col("dt").cast("string").alias("dt"), "bag_id",
        "hour_count", "day_count",
    )


# Stand-in for a table of user topics: every other user has a vector, whose entries are
# dealt over ten topics by their place and added up.
VECTORS_SQL = "vectors AS (SELECT vec_id * 2 AS user_id, [" + ", ".join(
    f"list_sum(list_transform(generate_series({i + 1}, len(embedding), 10), lambda j: CAST(embedding[j] AS DOUBLE)))"
    for i in range(10)) + "] AS embedding FROM embeddings)"


def user_vectors(spark, sf_dir, size: int = 10):
    def topic(i):
        places = F.sequence(F.lit(i + 1), F.size("embedding"), F.lit(size))
        entries = F.transform(places, lambda j: F.element_at("embedding", j).cast("double"))
        return F.aggregate(entries, F.lit(0.0), lambda a, x: a + x)

    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") * 2).alias("user_id"), F.array(*[topic(i) for i in range(size)]).alias("topics")
    )


def _entries():
    return [r6(F.col("topics")[i], f"t{i}") for i in range(10)]


@query("inner_topic_join", f"""WITH {VECTORS_SQL} SELECT event_id, user_id,
  {', '.join(sql6(f'CAST(embedding[{i + 1}] AS DOUBLE)', f't{i}') for i in range(10))}
  FROM events JOIN vectors USING (user_id)""")
def inner_topic_join(spark, sf_dir):
    rows = with_topics(table(spark, sf_dir, "events"), user_vectors(spark, sf_dir), ["event_id"])
    return rows.select("event_id", "user_id", *_entries())


@query("lookup_default", f"""WITH {VECTORS_SQL} SELECT event_id, user_id,
  {', '.join(sql6(f'coalesce(CAST(embedding[{i + 1}] AS DOUBLE), 0.0)', f't{i}') for i in range(10))}
  FROM events LEFT JOIN vectors USING (user_id)""")
def lookup_default(spark, sf_dir):
    rows = with_default_topics(table(spark, sf_dir, "events"), user_vectors(spark, sf_dir), ["event_id"])
    return rows.select("event_id", "user_id", *_entries())
