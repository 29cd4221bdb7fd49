"""Partition-parallel training: every shard learns in order, then the shards are averaged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logistic import FtrlConfig, clipped, log_loss, sigmoid
from ..session import new_folder
from .features import exploded
from .inorder import COUNTED, Models, Rule, counted
from .sampling import with_shard
from .skew import attach, attach_stored
from .state import average_shards

DEFAULT_SHARDS = 8
_COLUMNS = ["feature", "w", "z", "n", "p_new", "n_new", "g_new"]
_REPORT = ["seq", "example_id", "label", "step", "margin", "nonzero"]


def partition_keys(spark, count: int) -> list[int]:
    """Numbers of which the k-th falls in the k-th of ``count`` hash partitions.

    Dealing rows by a shard's own number would put several shards in one task and leave others idle.
    """
    found: dict[int, int] = {}
    tried = 0
    while len(found) < count:
        more = spark.range(tried, tried + 64 * count).select(
            "id", F.pmod(F.hash("id"), F.lit(count)).alias("at")).groupBy("at").agg(F.min("id").alias("id"))
        for r in more.collect():
            found.setdefault(r["at"], r["id"])
        tried += 64 * count
    return [found[k] for k in range(count)]


def _in_order(groups: list[str], configs: list[FtrlConfig], rule: Rule, report: bool, several: bool):
    """The update of the groups that stream by; it holds one group's features, not its examples."""
    columns = [*groups, "config_id", *_COLUMNS, *(_REPORT if report else [])]

    def framed(data: dict, key: tuple) -> pd.DataFrame:
        out = pd.DataFrame(data)
        for name, value in zip(groups, key):
            out[name] = value
        return out.reindex(columns=columns)

    def scored(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        seq, ids, steps, labels, margins, nonzero = zip(*rows)
        models = len(configs)
        return framed({
            "config_id": np.tile(np.arange(models), len(rows)), "seq": np.repeat(seq, models), "example_id": np.repeat(ids, models),
            "step": np.repeat(steps, models), "label": np.repeat(labels, models), "margin": np.concatenate(margins),
            "nonzero": np.concatenate(nonzero)}, key)

    def start_of(count: int, z, n, p, m) -> np.ndarray:
        """(z, n, p_count, n_count) x model x feature; without arrays, no feature has a state."""
        if z is None or not count:
            return np.zeros((4, len(configs), count))
        cells = [np.stack(x).T if several else np.asarray(x, float)[None, :] for x in (z, n, p, m)]
        if rule.from_counts:
            cells[1] = counted(cells[2], cells[3])
        return np.stack(cells)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, models = None, None
        seen: list[tuple] = []
        for frame in frames:
            keys = zip(*(frame[g] for g in groups))
            named = (frame[c] for c in ("seq", "example_id", "before", "label", "ids", "vals", "z", "n", "p", "m"))
            for key, seq, example, before, label, ids, values, z, n, p, m in zip(keys, *named):
                if key != now:
                    if seen:
                        yield scored(now, seen)
                        seen = []
                    if models is not None:
                        yield framed(models.rows(), now)
                    now, models = key, Models(configs, rule, int(before))
                slots = models.slots(np.asarray(ids, np.int64), lambda: start_of(len(ids), z, n, p, m))
                margin = models.learn(slots, np.asarray(values, float), int(label), report)
                if report:
                    seen.append((seq, example, models.steps, label, margin, models.nonzero.copy()))
            if seen:
                yield scored(now, seen)
                seen = []
        if models is not None:
            yield framed(models.rows(), now)

    return run


def _side_by_side(state: DataFrame, known_by: list[str], columns: list[str], models: int) -> DataFrame:
    """The state of several models with one row per feature: each column an array by ``config_id``."""
    return state.groupBy(*known_by, "feature").agg(*[
        F.array(*[F.coalesce(F.sum(F.when(F.col("config_id") == i, F.col(c))), F.lit(0.0)) for i in range(models)]).alias(c)
        for c in columns])


def train_in_order(
    state: DataFrame, rows: DataFrame, config: FtrlConfig | list[FtrlConfig], groups: dict[str, str], parts: int,
    known_by: list[str] | None = None, rule: Rule = COUNTED, stored: bool = False, report: bool = False,
    steps: DataFrame | None = None, **heavy,
) -> DataFrame:
    """(groups, feature, w, z, n, p_new, n_new, g_new): every group of ``rows`` learns by itself,
    in order of ``seq``, whatever the size of the blocks its rows come in.

    ``groups`` are the columns and their types, ``known_by`` those of them that ``state`` is told
    apart by. The first group column numbers the tasks, 0 to ``parts`` - 1. Spark joins each
    example to the state of its own features first, so a task gets the slice of the
    model its group touches and reads its examples as a stream. ``stored`` says that the state
    lies in storage, so that a small one is broadcast.

    ``rule`` says how an example moves a model. Several configurations learn side by side in one pass; ``state`` and
    result then have ``config_id`` too. ``steps`` (groups, steps) has how many examples a group of ``parts`` learned before.
    With ``report`` there is also a row per example and model, without a feature: seq, example_id, label, step (from 1),
    the margin before the example was learned, and by how much the weights other than zero have grown since the start.
    """
    names, known_by = list(groups), known_by or []
    several = not isinstance(config, FtrlConfig)
    configs = list(config) if several else [config]
    columns = ["z", "n", "p_count", "n_count"]
    flat = exploded(rows, [*names, "seq", "example_id", "label"])
    if several:
        state, nothing = _side_by_side(state, known_by, columns, len(configs)), F.array(*[F.lit(0.0)] * len(configs))
    else:
        state, nothing = state.select(*known_by, "feature", *columns), F.lit(0.0)
    entry = F.struct("feature", "value", *columns)

    def start(c: str):
        """An example's cells; null if the state has none of its features, so that a sort need not hold as many zeros."""
        known = F.exists("e", lambda x: x["z"].isNotNull() | x["n"].isNotNull() | x["p_count"].isNotNull() | x["n_count"].isNotNull())
        return F.when(known, F.transform("e", lambda x: F.coalesce(x[c], nothing)))

    join = attach_stored if stored else attach
    # The lists gather again what one example row held before it was exploded.
    ready = (
        join(flat, state, [*known_by, "feature"], ["example_id"], **heavy)
        .groupBy(*names, "seq", "example_id", "label")
        .agg(F.array_sort(F.collect_list(F.when(F.col("feature").isNotNull(), entry))).alias("e"))
    )
    ready = ready.select(*names, "seq", "example_id", "label", F.col("e.feature").alias("ids"), F.col("e.value").alias("vals"),
                         start("z").alias("z"), start("n").alias("n"), start("p_count").alias("p"), start("n_count").alias("m"))
    before = F.lit(0)
    if steps is not None:
        # A row per group, and there are as many groups as shards.
        ready = ready.join(F.broadcast(steps.select(*names, F.col("steps").alias("__steps"))), names, "left")
        before = F.coalesce("__steps", F.lit(0))
    keys = partition_keys(rows.sparkSession, parts)
    task = F.element_at(F.array(*[F.lit(k).cast("bigint") for k in keys]), F.col(names[0]).cast("int") + 1)
    ready = (
        ready.withColumn("__task", task).repartition(parts, "__task")
        .sortWithinPartitions(*names, "seq", "example_id")
        .select(*names, "seq", "example_id", before.cast("bigint").alias("before"), "label",
                "ids", "vals", "z", "n", "p", "m")
    )
    schema = [f"{g} {t}" for g, t in groups.items()] + ["config_id bigint, feature bigint", *[f"{c} double" for c in _COLUMNS[1:]]]
    if report:
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        schema += [f"{c} {kinds[c]}" for c in ("seq", "example_id", "label")] + ["step bigint", "margin double", "nonzero bigint"]
    out = ready.mapInPandas(_in_order(names, configs, rule, report, several), ", ".join(schema))
    return out if several else out.drop("config_id")


def learned_and_scored(
    state: DataFrame, rows: DataFrame, config: FtrlConfig | list[FtrlConfig], groups: dict[str, str], parts: int, **how,
) -> tuple[DataFrame, DataFrame]:
    """What ``train_in_order`` learned, and (groups, seq, example_id, label, step, margin, prob, loss, nonzero) of every example
    under the model that had learned the rows before it and not yet this one. One pass, stored, gives both."""
    spark = rows.sparkSession
    mixed = train_in_order(state, rows, config, groups, parts, report=True, **how)
    path = new_folder(spark, "in-order")
    # In one folder: to write two, Spark would sort all rows of a task first.
    mixed.write.parquet(path)
    back = spark.read.schema(mixed.schema).parquet(path)
    keys = [*groups, *(["config_id"] if "config_id" in mixed.columns else [])]
    prob = sigmoid(F.col("margin"))
    scored = back.where("feature IS NULL").select(
        *keys, "seq", "example_id", "label", "step", "margin", prob.alias("prob"),
        log_loss(F.col("label"), clipped(prob)).alias("loss"), "nonzero")
    return back.where("feature IS NOT NULL").select(*keys, *_COLUMNS), scored


def train_shards(
    state: DataFrame, examples: DataFrame, config: FtrlConfig, shards: int = DEFAULT_SHARDS,
    stored: bool = False, method: str = "xxhash64", **heavy,
) -> DataFrame:
    """(shard, feature, w, z, p_new, n_new, g_new) of examples with a ``seq`` order, a task per shard."""
    rows = with_shard(examples, "example_id", shards, method=method)
    return train_in_order(state, rows, config, {"shard": "int"}, shards, stored=stored, **heavy)


def shard_step(
    state: DataFrame, examples: DataFrame, config: FtrlConfig, shards: int = DEFAULT_SHARDS,
    **heavy,
) -> DataFrame:
    """The state after all shards trained on their part of the batch and were averaged."""
    return average_shards(state, train_shards(state, examples, config, shards, **heavy), shards)
