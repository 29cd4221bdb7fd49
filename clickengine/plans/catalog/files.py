"""Queries that write files below the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import metrics, steps
from ...operators.sampling import by_hash
from ...session import new_folder
from ...sources import logs
from ...sources.store import StateStore
from .base import LOG_SQL, events, md5_hash, query, r6, raw_log, sql6, sql_hash, table
from .models import BATCHES, SCORED_SQL, WITH_EX, examples, trained

WITH_LOG = f"WITH {LOG_SQL}\n"
COLUMNS = ", ".join(logs.LABELLED_COLUMNS)


@query("csv_roundtrip", WITH_LOG + f"SELECT {COLUMNS}, 'train' AS split FROM log")
def csv_roundtrip(spark, sf_dir):
    """The raw log as gzipped header CSV, read with the fixed schema."""
    path = new_folder(spark, "csv")
    raw_log(spark, sf_dir).write.option("compression", "gzip").csv(path, header=True)
    return logs.read_log_csv(spark, path, partitions=4)


@query("unlabelled_csv", WITH_LOG + f"""SELECT {COLUMNS.replace(' click,', ' CAST(NULL AS VARCHAR) AS click,')},
  'score' AS split FROM log""")
def unlabelled_csv(spark, sf_dir):
    """A log without labels has a null label and says so in ``split``."""
    path = new_folder(spark, "csv-unlabelled")
    raw_log(spark, sf_dir).select(*logs.UNLABELLED_COLUMNS).write.csv(path, header=True)
    return logs.read_log_csv(spark, path, labelled=False)


@query("hour_partitions", WITH_LOG + """SELECT 'hour' AS kind, id, click, CAST(hour AS INTEGER) AS hour FROM log
    WHERE hour = '24011503'
  UNION ALL SELECT 'day', id, click, CAST(hour AS INTEGER) FROM log WHERE substr(hour, 1, 6) = '240116'
  UNION ALL SELECT 'all', id, click, CAST(hour AS INTEGER) FROM log""")
def hour_partitions(spark, sf_dir):
    """A table partitioned by hour, read by hour, by day and whole."""
    path = new_folder(spark, "hours")
    logs.write_by_hour(raw_log(spark, sf_dir), path)
    parts = {"hour": logs.read_hour(spark, path, "24011503"), "day": logs.read_day(spark, path, "240116"),
             "all": logs.read_table(spark, path)}
    out = [df.select(F.lit(kind).alias("kind"), "id", "click", F.col("hour").cast("int").alias("hour"))
           for kind, df in parts.items()]
    return logs.union_aligned(out)


@query("replace_hours_twice", WITH_LOG + """SELECT id, CAST(hour AS INTEGER) AS hour,
  CASE WHEN substr(hour, 1, 6) = '240115' THEN 'new' ELSE 'old' END AS written FROM log""")
def replace_hours_twice(spark, sf_dir):
    """Replacing the hours of one day, twice, leaves the other hours and no row double."""
    path = new_folder(spark, "replaced")
    log = raw_log(spark, sf_dir).select("id", F.col("hour").cast("int").alias("hour"))
    logs.replace_hours(log.withColumn("written", F.lit("old")), path)
    day = log.where(logs.day_range("240115")).withColumn("written", F.lit("new"))
    for _ in range(2):
        logs.replace_hours(day, path)
    return logs.read_table(spark, path).select("id", F.col("hour").cast("int").alias("hour"), "written")


@query("table_roundtrip", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders""")
def table_roundtrip(spark, sf_dir):
    """A table written once and read again; writing over it by accident is refused."""
    path = new_folder(spark, "table")
    logs.write_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path)
    return logs.read_table(spark, path)


@query("metrics_table", WITH_EX + SCORED_SQL + f""", batches AS (SELECT DISTINCT example_id, batch FROM ex)
  SELECT batch + 1 AS version, count(*) AS rows, {sql6('avg(loss)', 'loss')},
    {sql6("avg(CAST(CAST(prob >= 0.5 AS BIGINT) = label AS INTEGER))", 'accuracy')}
  FROM scored JOIN batches USING (example_id) GROUP BY batch""")
def metrics_table(spark, sf_dir):
    """Metrics stored per version; writing a version again replaces it."""
    store = StateStore(spark, new_folder(spark, "metrics"))
    scored = steps.validate(examples(spark, sf_dir), trained(spark, sf_dir), carry=["batch"]).persist()
    try:
        for i in [*range(BATCHES + 1), 0]:
            store.save_metrics(i + 1, metrics.evaluate(scored.where(F.col("batch") == i)))
    finally:
        scored.unpersist()
    found = store.metrics().where(F.col("rows") > 0)
    return found.select(F.col("version").cast("bigint").alias("version"), "rows", r6("loss"), r6("accuracy"))


@query("validation_sample", WITH_EX + SCORED_SQL + f""" SELECT count(*) AS rows, {sql6('avg(loss)', 'loss')} FROM scored
  WHERE {sql_hash('CAST(example_id AS VARCHAR)')} % 1000000 < 250000""")
def validation_sample(spark, sf_dir):
    """Loss over the quarter of the events that a hash of the id picks."""
    sample = by_hash(examples(spark, sf_dir), md5_hash(F.col("example_id").cast("string")), 0.25)
    scored = steps.validate(sample, trained(spark, sf_dir))
    return metrics.evaluate(scored).select("rows", r6("loss"))


@query("local_rows", """SELECT event_type, count(*) AS n, CAST(event_type = 'purchase' AS BIGINT) AS label
  FROM events WHERE event_type IN ('purchase', 'error') GROUP BY event_type""")
def local_rows(spark, sf_dir):
    """A local list of event types and labels, joined to all events."""
    labels = logs.local_rows(spark, [("purchase", 1), ("error", 0)], "event_type string, label bigint")
    return events(spark, sf_dir).join(F.broadcast(labels), "event_type").groupBy("event_type", "label").agg(
        F.count(F.lit(1)).alias("n"))
