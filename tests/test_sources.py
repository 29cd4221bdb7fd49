import gzip

from conftest import rows_of
from pyspark.sql import functions as F

from clickengine.operators import features as feat
from clickengine.operators.sampling import bernoulli, by_hash, with_shard
from clickengine.sources import examples as ex
from clickengine.sources import logs

HEADER = ",".join(logs.LABELLED_COLUMNS)


def line(i, hour="14102100"):
    return ",".join([str(i), str(i % 2), hour, *[f"v{n}" for n in range(21)]])


def test_log_csv(spark, tmp_path):
    path = str(tmp_path / "train.gz")
    with gzip.open(path, "wt") as f:
        f.write("\n".join([HEADER, line(1), line(2)]) + "\n")
    df = logs.read_log_csv(spark, path, partitions=3)
    assert df.rdd.getNumPartitions() == 3
    assert rows_of(df, "id", "click", "hour", "C21", "split") == [
        ("1", "1", "14102100", "v20", "train"), ("2", "0", "14102100", "v20", "train")]


def test_unlabelled_log_has_no_made_up_label(spark, tmp_path):
    path = tmp_path / "test.csv"
    cut = [",".join(p for i, p in enumerate(t.split(",")) if i != 1) for t in (HEADER, line(7))]
    path.write_text("\n".join(cut) + "\n")
    df = logs.read_log_csv(spark, str(path), labelled=False)
    assert rows_of(df, "id", "click", "hour", "split") == [("7", None, "14102100", "score")]
    both = logs.union_aligned([df, df.drop("click")])
    assert both.columns == df.columns and both.count() == 2


def hourly(spark, hours, tag):
    return spark.createDataFrame([(i, tag, h) for h in hours for i in range(5)], "id int, tag string, hour int")


def test_hour_partitions(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.write_by_hour(hourly(spark, [14102100, 14102123, 14102200], "a"), path)
    assert len(list((tmp_path / "log" / "hour=14102100").glob("*.parquet"))) == 1
    assert logs.read_table(spark, path).count() == 15
    hour = logs.read_hour(spark, path, 14102123)
    assert hour.count() == 5 and "hour" in hour.columns
    assert "PartitionFilters: [isnotnull(hour" in hour._jdf.queryExecution().executedPlan().toString()
    day = logs.read_day(spark, path, "141021")
    assert sorted({r["hour"] for r in day.collect()}) == [14102100, 14102123]


def test_replacing_hours_twice_does_not_duplicate(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.write_by_hour(hourly(spark, [1, 2], "a"), path)
    for _ in range(2):
        logs.replace_hours(hourly(spark, [2, 3], "b"), path)
    got = rows_of(logs.read_table(spark, path).groupBy("hour", "tag").count())
    assert got == [(1, "a", 5), (2, "b", 5), (3, "b", 5)]


def test_local_rows(spark):
    assert rows_of(logs.local_rows(spark, [(1, "a")], "n int, s string")) == [(1, "a")]


LINES = {
    "1 0:1.5 7:2": (True, 1, {0: 1.5, 7: 2.0}),
    "0  9:1   3:0.5 ": (True, 0, {9: 1.0, 3: 0.5}),
    "1 4:1 4:3": (True, 1, {4: 3.0}),
    "0": (True, 0, {}),
    "x 1:1": (False, None, None),
    "1 2:": (False, None, None),
    "1 2": (False, None, None),
    "": (False, None, None),
    None: (False, None, None),
}


def test_libsvm_lines(spark):
    df = spark.createDataFrame([(t,) for t in LINES], "line string")
    got = {r["line"]: (r["valid"], r["label"], r["features"]) for r in ex.parse_libsvm(df).collect()}
    assert got == LINES


def test_envelopes_and_rejects(spark):
    texts = ['{"payload": "1 2:1.0"}', '{"payload": "no"}', '{"other": 1}', "{oops"]
    parsed = ex.parse_libsvm(ex.unwrap_envelope(spark.createDataFrame([(t,) for t in texts], "value string")))
    assert rows_of(ex.accepted(parsed), "value", "label") == [(texts[0], 1)]
    assert rows_of(ex.rejected(parsed, ["value"])) == sorted(((t,) for t in texts[1:]), key=repr)


def test_written_lines_and_scores(spark, tmp_path):
    rows = spark.createDataFrame([(1, {5: 0.5, 0: 1.0})], "label int, features map<long,double>")
    ex.write_libsvm(rows, str(tmp_path / "svm"))
    assert rows_of(spark.read.text(str(tmp_path / "svm"))) == [("1 0:1.0 5:0.5",)]
    scored = spark.createDataFrame([("a", 1 / 3)], "example_id string, prob double")
    ex.write_scores(scored, str(tmp_path / "plain"))
    assert rows_of(spark.read.text(str(tmp_path / "plain"))) == [("a,0.33333333",)]
    ex.write_scores(scored, str(tmp_path / "csv"), header=True)
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert rows_of(back, "id", "click") == [("a", "0.33333333")]


def test_later_feature_group_wins(spark):
    one = [feat.numbered(5, F.lit(1.0)), feat.numbered(6, F.lit(1.0))]
    two = [feat.numbered(5, F.lit(9.0)), feat.numbered(7, F.lit(None).cast("double"))]
    got = spark.range(1).select(feat.as_map(one, two).alias("m")).first()["m"]
    assert got == {5: 9.0, 6: 1.0}
    space = feat.Namespace("s", 1, 20)
    texts = feat.indicators([F.lit("a"), F.lit(None).cast("string")], space)
    later = feat.named_values({"b": F.lit(3.0)}, space)
    got = spark.range(1).select(feat.as_map(one, texts, later).alias("m")).first()["m"]
    assert got == {5: 1.0, 6: 1.0, 20: 3.0}


def test_samples_and_shards(spark):
    rows = spark.range(10000)
    picked = by_hash(rows, F.xxhash64("id"), 0.3)
    assert 2700 < picked.count() < 3300
    assert rows_of(picked) == rows_of(by_hash(rows.repartition(7), F.xxhash64("id"), 0.3))
    assert by_hash(rows, F.xxhash64("id"), 1.0).count() == 10000
    assert 2500 < bernoulli(rows, 0.3).count() < 3500
    shards = with_shard(rows, "id", 8)
    assert rows_of(shards) == rows_of(with_shard(rows.repartition(5), "id", 8))
    sizes = [r["count"] for r in shards.groupBy("shard").count().collect()]
    assert len(sizes) == 8 and min(sizes) > 1000


def test_md5_of_many_texts_at_once_is_that_of_each(spark):
    """Texts around the edges of md5's blocks, enough of them to be hashed side by side, and nulls."""
    import pyarrow as pa

    from clickengine.functions.hashing import md5_numbers, text_hash

    texts = [("é€😀" + "x" * 130)[k % 3:k % 131] + str(k) for k in range(3000)] + ["", None, "y" * 5000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    alone = [r["h"] for r in rows.select("k", text_hash(F.col("t"), "md5").alias("h")).orderBy("k").collect()]
    for cut in (0, 1, 2990):
        got = md5_numbers(pa.array([*texts, "after"]).slice(cut, len(texts) - cut)).tolist()
        assert [None if t is None else n for t, n in zip(texts[cut:], got)] == alone[cut:]
    assert md5_numbers(pa.array([], pa.string())).tolist() == []


def test_md5_features_are_hashed_in_batches_with_the_same_maps(spark):
    """Ids of a narrow range collide: an id stays where it came first, with the last value; nulls are left out."""
    from clickengine.functions.hashing import Namespace, bucket

    spaces = [Namespace("narrow", 5), Namespace("wide", 1000, 5)]
    rows = spark.range(600).selectExpr(
        "id", "IF(id % 7 = 0, NULL, concat('é', id)) AS a", "CAST(id % 10 AS STRING) AS b",
        "IF(id % 3 = 0, NULL, id / 3) AS x", "array(id / 4, NULL, CAST('NaN' AS DOUBLE)) AS v")
    texts = [F.col("a"), F.concat(F.lit("b-"), F.col("b")), F.col("b")]
    group = feat.vector_entries("v", 4, spaces[0], method="md5")
    groups = [group, feat.indicators(texts, spaces[0], "md5"), feat.indicators(texts, spaces[1], "md5"),
              feat.crossed_values(feat.named_values({"x": F.col("x")}, spaces[1], "md5"), texts, spaces[0], "md5")]
    made = rows.select("id", feat.as_map(*groups).alias("m"))
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    pairs = [(f.value, bucket(f.text, f.space, "md5")) for g in groups for f in g]
    plain = rows.select("id", F.array(*[F.struct(k.alias("k"), v.cast("double").alias("v")) for v, k in pairs]).alias("p"))
    entries = made.select("id", F.map_entries("m").alias("m"))
    for got, want in zip(entries.orderBy("id").collect(), plain.orderBy("id").collect()):
        expected: dict[int, float] = {}
        for k, v in want["p"]:
            if k is not None and v is not None:
                expected[k] = v
        assert repr([tuple(e) for e in got["m"]]) == repr(list(expected.items()))
