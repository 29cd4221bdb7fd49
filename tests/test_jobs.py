"""Log files to score file, over a small log of four days."""

import random

from conftest import rows_of
from pyspark.sql import functions as F
from test_models import make

from clickengine.operators.frequency import thin_examples
from clickengine.plans import feature_sets as sets
from clickengine.plans import jobs, training
from clickengine.plans.jobs import Recipe
from clickengine.functions.logistic import FtrlConfig
from clickengine.sources.logs import LABELLED_COLUMNS, read_table

DAYS = (21, 22, 23, 24)


def log_rows(labelled_days=DAYS[:3]):
    """Forty rows an hour, four hours a day; ads of banner 1 are clicked."""
    rng = random.Random(7)
    n = 0
    for day in DAYS:
        for h in range(4):
            for _ in range(40):
                n += 1
                banner = rng.randrange(3)
                click = int(rng.random() < (0.8 if banner == 1 else 0.1))
                row = dict.fromkeys(LABELLED_COLUMNS, "x")
                row.update(id=str(n), click=str(click), hour=f"1410{day}{h:02d}", banner_pos=str(banner),
                           app_id="ecad2386" if n % 2 else f"a{n % 5}", site_id=f"s{n % 3}",
                           device_id=f"d{n % 6}", C14=str(n % 4), C17=str(banner))
                yield day in labelled_days, row


def write_csv(path, columns, rows):
    path.write_text("\n".join([",".join(columns), *[",".join(r[c] for c in columns) for r in rows]]) + "\n")


def tables(spark, tmp_path):
    rows = list(log_rows())
    write_csv(tmp_path / "train.csv", LABELLED_COLUMNS, [r for known, r in rows if known])
    write_csv(tmp_path / "test.csv", [c for c in LABELLED_COLUMNS if c != "click"], [r for known, r in rows if not known])
    jobs.ingest(spark, str(tmp_path / "train.csv"), str(tmp_path / "train"), partitions=2)
    jobs.ingest(spark, str(tmp_path / "test.csv"), str(tmp_path / "test"), labelled=False)
    return [str(tmp_path / "train"), str(tmp_path / "test")]


def test_bag_model_from_csv_to_scores(spark, tmp_path):
    paths = tables(spark, tmp_path)
    out, model = str(tmp_path / "bags"), str(tmp_path / "model")
    for _ in range(2):  # a rerun replaces
        jobs.build_bag_table(spark, paths, out)
    table = read_table(spark, out)
    assert table.count() == 640 and table.where("click is null").count() == 160
    # The unlabelled day's lagged counts reach back into the labelled ones.
    assert table.where("hour = 14102400").agg(F.min("day_count")).first()[0] > 20
    recipe = Recipe(sets.bag_features, FtrlConfig(alpha=0.5, l1=0.1), sample=1.0, skip=4, take=-6, min_sightings=3)
    store = jobs.train_by_hour(spark, out, model, recipe)
    report = training.summary(store).orderBy("version").collect()
    assert [r["batch"] for r in report] == ["14102202", "14102203", *[f"141023{h:02d}" for h in "0123" for h in [int(h)]]]
    jobs.score_day(spark, out, "141024", model, sets.bag_features, str(tmp_path / "scores"))
    lines = [r[0].split(",") for r in spark.read.text(str(tmp_path / "scores")).collect()]
    assert len(lines) == 160 and all(0 < float(p) < 1 and len(p.split(".")[1]) == 8 for _, p in lines)
    assert {i for i, _ in lines} == {r["id"] for known, r in log_rows() if not known}


def test_count_and_rate_models(spark, tmp_path):
    paths = tables(spark, tmp_path)
    jobs.build_count_table(spark, paths[:1], str(tmp_path / "counts"))
    jobs.build_rate_table(spark, paths[:1], str(tmp_path / "rates"))
    for name, features in (("counts", sets.count_features), ("rates", sets.rate_features)):
        recipe = Recipe(features, FtrlConfig(alpha=0.5, l1=0.1), sample=1.0, take=-4)
        store = jobs.train_by_hour(spark, str(tmp_path / name), str(tmp_path / f"{name}-model"), recipe)
        losses = [r["loss"] for r in training.summary(store).orderBy("version").collect()]
        assert len(losses) == 4 and losses[-1] < losses[0]


def test_topic_and_category_models(spark, tmp_path):
    paths = tables(spark, tmp_path)
    topics, out = str(tmp_path / "topics"), str(tmp_path / "topical")
    jobs.build_topic_tables(spark, paths[:1], "141021", topics, out, num_features=64, iterations=2)
    assert read_table(spark, out).count() == 480
    recipe = Recipe(sets.topic_features, FtrlConfig(alpha=0.5, l1=0.1), sample=0.5, take=2)
    store = jobs.train_by_hour(spark, out, str(tmp_path / "t-model"), recipe)
    assert 0 < training.summary(store).agg(F.sum("rows")).first()[0] < 80
    store = jobs.train_by_rows(spark, paths[0], topics, str(tmp_path / "c-model"),
                               FtrlConfig(alpha=0.5, l1=0.1), rows=200)
    report = training.summary(store).orderBy("version").collect()
    assert [r["rows"] for r in report] == [200, 200, 80]
    assert report[-1]["loss"] < report[0]["loss"]


def test_recipes_name_their_settings():
    assert {n: r.config.l1 for n, r in jobs.RECIPES.items()} == {"topic": 5, "rate": 4, "count": 2.5, "bag": 1.5}


def test_thinned_examples_keep_their_rows(spark, heavy):
    rows = [(1, {1: 1.0, 2: 1.0}), (0, {1: 2.0}), (1, {1: 3.0, 3: 1.0}), (0, {}), (0, {3: 5.0})]
    want = {True: [{}, {1: 2.0}, {1: 3.0}, {}, {3: 5.0}],
            False: [{1: 1.0}, {1: 2.0}, {1: 3.0, 3: 1.0}, {}, {3: 5.0}]}
    for progressive, maps in want.items():
        for how in ({}, heavy):
            thin = thin_examples(make(spark, rows), 2, progressive, **how)
            assert [r["features"] for r in thin.orderBy("seq").collect()] == maps


def test_batches_of_rows(spark):
    got = training.batches_of(make(spark, [(0, {1: 1.0})] * 7), 3)
    assert rows_of(got.groupBy("batch").count()) == [(0, 3), (1, 3), (2, 1)]
