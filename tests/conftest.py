import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clickengine.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


# Settings that make almost every key of a small fixture a heavy one.
HEAVY = {"heavy_rows": 3, "heavy_share": 0.0, "sample_every": 1}


@pytest.fixture
def heavy():
    return dict(HEAVY)


def rows_of(df, *columns):
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=repr)


def close(a, b, tolerance=1e-9):
    return a.keys() == b.keys() and all(
        all(abs(x - y) <= tolerance for x, y in zip(a[k], b[k])) for k in a
    )
