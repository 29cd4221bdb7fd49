"""Scoring and one training step over a mini-batch of examples.

Examples are (model keys, example_id, label, features map). A step explodes them to one
row per feature, brings in the weights, sums the margin per example and the gradients per
feature, and joins the sums to the state. With one example per batch it is the published
per-example update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logistic as L
from .features import exploded
from .skew import BROADCAST_ROWS, attach, attach_stored, fits_broadcast
from .state import STATE_COLUMNS


def _rates(config: L.FtrlConfig | list[L.FtrlConfig]) -> L.Rates:
    """Literals for one configuration; for several, a choice by ``config_id``."""
    if isinstance(config, L.FtrlConfig):
        return config.columns()

    def pick(field: str) -> Column:
        chosen = F.lit(float(getattr(config[0], field)))
        for i, c in enumerate(config[1:], start=1):
            chosen = F.when(F.col("config_id") == i, F.lit(float(getattr(c, field)))).otherwise(chosen)
        return chosen

    return L.Rates(*(pick(f) for f in ("alpha", "beta", "l1", "l2", "sigma_sign")))


def _squares(config: L.FtrlConfig | list[L.FtrlConfig]) -> Column:
    whole = F.col("g") * F.col("g")
    if isinstance(config, L.FtrlConfig):
        return whole if config.square == "batch" else F.col("q")
    ids = [i for i, c in enumerate(config) if c.square == "batch"]
    return F.when(F.col("config_id").isin(ids), whole).otherwise(F.col("q")) if ids else F.col("q")


def grid_gradients(
    examples: DataFrame, weights: DataFrame, configs: list[L.FtrlConfig], stored: bool = False, **heavy
) -> DataFrame:
    """(config_id, feature, g, q, p_new, n_new) of all models over the same examples.

    ``weights`` are (config_id, feature, w). Every feature brings the weights of all
    models at once, so examples are shuffled once, whatever the number of models; a row per model
    only comes up behind the sums per feature.
    """
    ids = range(len(configs))
    wide = weights.groupBy("feature").agg(
        *[F.sum(F.when(F.col("config_id") == i, F.col("w"))).alias(f"__w{i}") for i in ids])
    join = attach_stored if stored else attach
    rows = join(exploded(examples, ["example_id", "label"]), wide, ["feature"], ["example_id"], **heavy)
    one_example = Window.partitionBy("example_id")
    summed = rows.select("feature", "value", "label", *[
        F.sum(F.coalesce(f"__w{i}", F.lit(0.0)) * F.col("value")).over(one_example).alias(f"__m{i}") for i in ids])
    summed = summed.where(F.col("feature").isNotNull())
    g = [L.gradient(F.col("label"), L.clipped(L.sigmoid(F.col(f"__m{i}"))), F.col("value")) for i in ids]
    label = F.col("label").cast("double")
    sums = summed.groupBy("feature").agg(
        *[F.sum(g[i]).alias(f"__g{i}") for i in ids], *[F.sum(g[i] * g[i]).alias(f"__q{i}") for i in ids],
        F.sum(label).alias("p_new"), F.sum(1.0 - label).alias("n_new"))
    each = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("config_id"), F.col(f"__g{i}").alias("g"), F.col(f"__q{i}").alias("q"))
        for i in ids])
    return sums.select("feature", "p_new", "n_new", F.inline(each))


def weighted_rows(
    examples: DataFrame, weights: DataFrame, keys: list[str], carry: list[str],
    stored: bool = False, **heavy,
) -> DataFrame:
    """(keys, carry, feature, value, w): exploded examples with weights, 0 where unknown.

    ``stored`` says that the weights lie in storage, so that a small model is broadcast.
    """
    rows = exploded(examples, [*keys, *carry])
    on = [*keys, "feature"]
    join = attach_stored if stored else attach
    return join(rows, weights.select(*on, "w"), on, ["example_id"], **heavy).withColumn(
        "w", F.coalesce("w", F.lit(0.0))
    )


def sparse_dot(
    examples: DataFrame, weights: DataFrame, keys: list[str] | None = None,
    carry: list[str] | None = None, **heavy,
) -> DataFrame:
    """(keys, example_id, carry, margin)."""
    keys, carry = keys or [], carry or []
    rows = weighted_rows(examples, weights, keys, ["example_id", *carry], **heavy)
    return rows.groupBy(*keys, "example_id", *carry).agg(
        F.coalesce(F.sum(F.col("w") * F.col("value")), F.lit(0.0)).alias("margin")
    )


def predict(
    examples: DataFrame, weights: DataFrame, keys: list[str] | None = None,
    carry: list[str] | None = None, threshold: float = 0.5, **heavy,
) -> DataFrame:
    """(keys, example_id, carry, margin, prob, predicted)."""
    return sparse_dot(examples, weights, keys, carry, **heavy).withColumn(
        "prob", L.sigmoid(F.col("margin"))
    ).withColumn("predicted", (F.col("prob") >= threshold).cast("bigint"))


def validate(
    examples: DataFrame, weights: DataFrame, keys: list[str] | None = None,
    carry: list[str] | None = None, **heavy,
) -> DataFrame:
    """(keys, example_id, label, carry, prob, loss) of labelled examples."""
    scored = predict(examples, weights, keys, ["label", *(carry or [])], **heavy)
    return scored.select(
        *(keys or []), "example_id", "label", *(carry or []), "prob",
        L.log_loss(F.col("label"), L.clipped(F.col("prob"))).alias("loss"),
    )


def margin_rows(
    examples: DataFrame, state: DataFrame, config: L.FtrlConfig, stored: bool = False,
    max_rows: int = BROADCAST_ROWS, **heavy,
) -> DataFrame:
    """Exploded labelled examples with the margin under the published weights and under those that
    z and n give, from one join: what validating and learning from a batch have in common."""
    weights = state.select("feature", "w", L.weight(F.col("z"), F.col("n"), config.columns()).alias("__now"))
    weights = weights.where((F.col("w") != 0.0) | (F.col("__now") != 0.0))
    if stored and fits_broadcast(weights, max_rows):
        # Dealt by example before an example becomes many rows, as the join leaves them where they are.
        rows = exploded(examples.repartition("example_id"), ["example_id", "label"]).join(F.broadcast(weights), "feature", "left")
    else:
        rows = attach(exploded(examples, ["example_id", "label"]), weights, ["feature"], ["example_id"], **heavy)
    one_example = Window.partitionBy("example_id")

    def margin(w: str) -> Column:
        total = F.sum(F.coalesce(w, F.lit(0.0)) * F.col("value")).over(one_example)
        return F.coalesce(total, F.lit(0.0))

    return rows.select(
        "example_id", "label", "feature", "value", margin("w").alias("published"), margin("__now").alias("margin"))


def scored_rows(rows: DataFrame) -> DataFrame:
    """(example_id, label, prob, loss) of the examples in ``margin_rows``, under the published weights."""
    examples = rows.groupBy("example_id", "label").agg(F.first("published").alias("margin"))
    prob = L.sigmoid(F.col("margin"))
    return examples.select(
        "example_id", "label", prob.alias("prob"), L.log_loss(F.col("label"), L.clipped(prob)).alias("loss"))


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, g, q, p_new, n_new) of exploded rows with their example's ``margin``."""
    scored = rows.where(F.col("feature").isNotNull()).withColumn("prob", L.clipped(L.sigmoid(F.col("margin"))))
    g = L.gradient(F.col("label"), F.col("prob"), F.col("value"))
    label = F.col("label").cast("double")
    return scored.groupBy(*keys, "feature").agg(
        F.sum(g).alias("g"), F.sum(g * g).alias("q"),
        F.sum(label).alias("p_new"), F.sum(1.0 - label).alias("n_new"),
    )


def gradients(
    examples: DataFrame, weights: DataFrame, keys: list[str] | None = None, **heavy
) -> DataFrame:
    """(keys, feature, g, q, p_new, n_new): sums of gradient, its square and label counts."""
    keys = keys or []
    rows = weighted_rows(examples, weights, keys, ["example_id", "label"], **heavy)
    one_example = Window.partitionBy(*keys, "example_id")
    return _sums(rows.withColumn("margin", F.sum(F.col("w") * F.col("value")).over(one_example)), keys)


def current_weights(state: DataFrame, rates: L.Rates, keys: list[str]) -> DataFrame:
    """Weights other than zero; a missing one counts as zero."""
    weights = state.select(*keys, "feature", L.weight(F.col("z"), F.col("n"), rates).alias("w"))
    return weights.where(F.col("w") != 0.0)


def ftrl_step(
    state: DataFrame, examples: DataFrame, config: L.FtrlConfig | list[L.FtrlConfig],
    keys: list[str] | None = None, counted: bool = False, **heavy,
) -> DataFrame:
    """The state after one mini-batch.

    ``counted`` estimates the squared-gradient sum from label counts. With a list of
    configurations, ``state`` carries ``config_id`` and all models advance in the same job,
    over the same examples.
    """
    rates = _rates(config)
    if isinstance(config, L.FtrlConfig):
        keys = [*(keys or [])]
        sums = gradients(examples, current_weights(state, rates, keys), keys, **heavy)
    else:
        if keys:
            raise ValueError("a grid of configurations has no further model keys")
        keys = ["config_id"]
        sums = grid_gradients(examples, current_weights(state, rates, keys), config, **heavy)
    return _advanced(state, sums, config, keys, counted)


def step_from_rows(
    state: DataFrame, rows: DataFrame, config: L.FtrlConfig, counted: bool = False
) -> DataFrame:
    """``ftrl_step`` over a batch whose ``margin_rows`` are there already."""
    return _advanced(state, _sums(rows, []), config, [], counted)


def _advanced(
    state: DataFrame, sums: DataFrame, config: L.FtrlConfig | list[L.FtrlConfig], keys: list[str], counted: bool
) -> DataFrame:
    rates = _rates(config)
    on = [*keys, "feature"]
    joined = state.select(*on, *STATE_COLUMNS).join(sums, on, "full_outer").select(
        *on, "g", "q",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in STATE_COLUMNS + ["p_new", "n_new"]],
    )
    counts = joined.withColumn("p_count", F.col("p_count") + F.col("p_new")).withColumn(
        "n_count", F.col("n_count") + F.col("n_new")
    )
    seen = F.col("g").isNotNull()
    if counted:
        grown = L.counted_n(F.col("p_count"), F.col("n_count"))
    else:
        grown = F.col("n") + _squares(config)
    moved = counts.withColumn("__n", F.when(seen, grown).otherwise(F.col("n"))).withColumn(
        "__z",
        F.when(
            seen,
            L.next_z(F.col("z"), F.col("g"), F.col("n"), F.col("__n"),
                     L.weight(F.col("z"), F.col("n"), rates), rates),
        ).otherwise(F.col("z")),
    )
    return moved.select(
        *on,
        F.when(seen, L.weight(F.col("__z"), F.col("__n"), rates)).otherwise(F.col("w")).alias("w"),
        F.col("__z").alias("z"), F.col("__n").alias("n"), "p_count", "n_count",
        (F.col("g_sum") + F.coalesce("g", F.lit(0.0))).alias("g_sum"),
    )


def gradient_descent_step(
    weights: DataFrame, examples: DataFrame, step_rate: float, **heavy
) -> DataFrame:
    """(feature, w) after one plain gradient step over the batch."""
    sums = gradients(examples, weights, **heavy)
    return weights.select("feature", "w").join(sums, "feature", "full_outer").select(
        "feature",
        L.gradient_step(
            F.coalesce("w", F.lit(0.0)), F.coalesce("g", F.lit(0.0)), F.lit(float(step_rate))
        ).alias("w"),
    )


def ogd_step(weights: DataFrame, examples: DataFrame, t: int, **heavy) -> DataFrame:
    """Online gradient descent: the step shrinks with the square root of the batch number."""
    return gradient_descent_step(weights, examples, 1.0 / t ** 0.5, **heavy)
