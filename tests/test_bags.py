from collections import Counter

from conftest import rows_of
from pyspark.sql import functions as F

from clickengine.operators import bags


def visits(spark):
    rows = [("hot", f"p{i % 7}") for i in range(60)] + [("hot", "p0")] * 40
    rows += [("a", "x"), ("a", "x"), ("a", "w"), ("b", "x"), ("c", None)]
    return spark.createDataFrame(rows, "user string, pub string")


def test_bag_is_rows_whatever_its_size(spark):
    got = Counter({(r["user"], r["pub"]): r["n"] for r in bags.bag_runs(visits(spark), "user", "pub").collect()})
    assert got == Counter((r["user"], r["pub"]) for r in visits(spark).collect() if r["pub"] is not None)
    assert rows_of(bags.bag_set(visits(spark), "user", "pub").where("user <> 'hot'")) == [("a", "w"), ("a", "x"), ("b", "x")]


def test_signature_depends_on_the_set_only(spark):
    rows = [("a", "x"), ("a", "y"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x")]
    runs = bags.bag_runs(spark.createDataFrame(rows, "user string, pub string"), "user", "pub")
    ids = dict(rows_of(bags.set_signature(runs, "user", F.xxhash64("pub"))))
    assert ids["a"] == ids["b"] != ids["c"]
