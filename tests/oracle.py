"""Compare registered queries with their SQL on one scale folder.

``python tests/oracle.py [sf_dir] [name ...]`` prints a line per query.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    return (v is not None, str(type(v)) if not isinstance(v, (int, float)) else "", v if v is not None else 0)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple(_key(v) for v in r))


def kinds(rows):
    """The Python types seen per column, to catch int against double."""
    return [sorted({type(v).__name__ for v in col if v is not None}) for col in zip(*rows)] if rows else []


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_cols, got = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if kinds(got) != kinds(want):
        return f"types {list(zip(got_cols, kinds(got), kinds(want)))}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} rows differ, first {bad[0]}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                result = "ok" if problem is None else f"DIFF {problem}"
            else:
                result = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            result = f"FAIL {type(e).__name__}: {str(e)[:1500]}"
        bad += result.startswith(("DIFF", "FAIL"))
        print(f"{name:28s} {time.time() - start:6.1f}s {result}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
