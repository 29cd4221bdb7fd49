"""Registry, table access and the click log that the queries derive from ``events``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.hashing import text_hash
from ...functions.identity import NOT_AN_APP, UNKNOWN_DEVICE, with_identity
from ...session import configure
from ...sources.logs import spread_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with its SQL where SQL can say it."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col: str | Column, name: str | None = None) -> Column:
    """Six decimals, and no negative zero, for comparison with another engine."""
    name = name or (col if isinstance(col, str) else None)
    out = F.round(col, 6) + F.lit(0.0)
    return out.alias(name) if name else out


def sql6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


def text_ts(col: str | Column, name: str | None = None) -> Column:
    name = name or col
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(name)


def sql_ts(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name or expr}"


def md5_hash(text: Column) -> Column:
    return text_hash(text, "md5")


def sql_hash(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def sql_bucket(text: str, size: int, offset: int = 0) -> str:
    return f"({sql_hash(text)} % {size} + {offset})"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the code ``k`` of ``props`` and the decile ``v`` of ``value``."""
    return with_codes(spread_out(table(spark, sf_dir, "events"), "event_id"))


def with_codes(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.floor(F.col("value") / 10).cast("bigint").alias("v"),
    )


RAW_SQL = """raw AS (
  SELECT event_id, ts, user_id, event_type, value,
    CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, CAST(floor(value / 10) AS BIGINT) AS v
  FROM events)"""

# The columns of a click log as expressions that Spark and the checking engine both read.
_LOG_COLUMNS = {
    "id": "CAST(event_id AS {text})",
    "click": "CASE WHEN event_type = 'purchase' THEN '1' ELSE '0' END",
    "hour": "{hour}",
    "C1": "CAST(1000 + k % 7 AS {text})",
    "banner_pos": "CAST(k % 3 AS {text})",
    "site_id": "concat('s', CAST(k % 11 AS {text}))",
    "site_domain": "concat('sd', CAST(k % 5 AS {text}))",
    "site_category": "concat('sc', CAST(k % 3 AS {text}))",
    "app_id": f"CASE WHEN k < 60 THEN '{NOT_AN_APP}' ELSE concat('a', CAST(k % 13 AS {{text}})) END",
    "app_domain": "concat('ad', CAST(k % 4 AS {text}))",
    "app_category": "concat('ac', CAST(k % 3 AS {text}))",
    "device_id": f"CASE WHEN event_type = 'error' THEN '{UNKNOWN_DEVICE}' "
                 "ELSE concat('d', CAST(user_id AS {text})) END",
    "device_ip": "concat('ip', CAST(user_id AS {text}))",
    "device_model": "concat('m', CAST(k % 10 AS {text}))",
    "device_type": "CAST(k % 4 AS {text})",
    "device_conn_type": "CAST(v % 4 AS {text})",
    "C14": "CAST(k AS {text})",
    "C15": "CAST(k % 5 AS {text})",
    "C16": "CAST(k % 6 AS {text})",
    "C17": "CAST(v AS {text})",
    "C18": "CAST(k % 4 AS {text})",
    "C19": "CAST(k % 8 AS {text})",
    "C20": "CAST(user_id % 9 AS {text})",
    "C21": "CAST(k % 12 AS {text})",
}


def _log_exprs(text: str, hour: str) -> list[str]:
    return [f"{e.format(text=text, hour=hour)} AS {c}" for c, e in _LOG_COLUMNS.items()]


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the shape of a raw click log."""
    return events(spark, sf_dir).selectExpr(*_log_exprs("STRING", "date_format(ts, 'yyMMddHH')"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_identity(raw_log(spark, sf_dir))


LOG_SQL = RAW_SQL + ",\nlog AS (SELECT " + ",\n  ".join(
    _log_exprs("VARCHAR", "strftime(ts, '%y%m%d%H')")
) + f""" FROM raw),
clean AS (SELECT *,
    CASE WHEN device_id = '{UNKNOWN_DEVICE}' THEN device_ip || device_model ELSE device_id END AS user_id,
    CASE WHEN app_id = '{NOT_AN_APP}' THEN site_id ELSE app_id END AS pub_id,
    CASE WHEN app_id = '{NOT_AN_APP}' THEN site_domain ELSE app_domain END AS pub_domain,
    CASE WHEN app_id = '{NOT_AN_APP}' THEN site_category ELSE app_category END AS pub_category,
    concat_ws('|', banner_pos, device_type, device_conn_type,
              C14, C15, C16, C17, C18, C19, C20, C21) AS impression,
    substr(hour, 1, 6) AS d, substr(hour, 7, 2) AS h,
    CAST(strptime(hour, '%y%m%d%H') AS TIMESTAMP) AS date_time,
    CAST(strptime(hour, '%y%m%d%H') AS DATE) AS dt
  FROM log)"""
