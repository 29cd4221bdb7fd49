"""Loss, accuracy, ROC points and AUC of scored examples (label, prob, loss)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import rolling_sums

POINTS = 11  # thresholds 0.0, 0.1, ... 1.0


def _passes(k: int, label: int) -> Column:
    """1 for an example of this label whose probability reaches k/10."""
    return ((F.col("prob") >= F.lit(k) / F.lit(10.0)) & (F.col("label") == label)).cast("bigint")


def _parts(threshold: float) -> dict[str, Column]:
    """What has to be summed for all metrics: one pass, no row per threshold."""
    hit = (F.col("prob") >= threshold).cast("bigint") == F.col("label")
    parts = {
        "s_rows": F.lit(1).cast("bigint"),
        "s_loss": F.col("loss"),
        "s_hits": hit.cast("bigint"),
        "s_pos": (F.col("label") == 1).cast("bigint"),
        "s_neg": (F.col("label") == 0).cast("bigint"),
    }
    for k in range(POINTS):
        parts[f"s_tp{k}"] = _passes(k, 1)
        parts[f"s_fp{k}"] = _passes(k, 0)
    return parts


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def _auc() -> Column:
    """Trapezoid under the points; 0 when a class is missing."""
    area = F.lit(0.0)
    for k in range(POINTS - 1):
        height = (_share(f"s_tp{k + 1}", "s_pos") + _share(f"s_tp{k}", "s_pos")) / 2.0
        area = area + height * (_share(f"s_fp{k}", "s_neg") - _share(f"s_fp{k + 1}", "s_neg"))
    return area


def _summary() -> list[Column]:
    return [
        F.try_divide(F.col("s_loss"), F.col("s_rows")).alias("loss"),
        F.try_divide(F.col("s_hits"), F.col("s_rows")).alias("accuracy"),
        _auc().alias("auc"),
    ]


def evaluate(scored: DataFrame, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """(by, rows, loss, accuracy, auc); null loss and accuracy when there are no rows."""
    by = by or []
    sums = scored.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in _parts(threshold).items()])
    return sums.select(*by, F.coalesce("s_rows", F.lit(0).cast("bigint")).alias("rows"), *_summary())


def roc_points(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, point, tpr, fpr): shares of each class with a probability of at least point/10."""
    by = by or []
    sums = scored.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in _parts(0.5).items()])
    points = F.array(*[
        F.struct(
            F.lit(k).cast("bigint").alias("point"),
            _share(f"s_tp{k}", "s_pos").alias("tpr"),
            _share(f"s_fp{k}", "s_neg").alias("fpr"),
        )
        for k in range(POINTS)
    ])
    return sums.select(*by, F.inline(points))


def rolling_metrics(
    indexed: DataFrame, size: int = 1000, threshold: float = 0.5, idx: str = "idx"
) -> DataFrame:
    """Per row: loss, accuracy and auc over the last ``size`` rows in the order of ``idx``."""
    base = indexed.select(idx, "example_id", "label", "prob", "loss")
    rolled = rolling_sums(base, size, _parts(threshold), idx)
    return rolled.select(idx, "example_id", *_summary())


def reports(
    scored: DataFrame, every: int, size: int = 1000, by: list[str] | None = None, threshold: float = 0.5
) -> DataFrame:
    """(by, step, rows, loss, accuracy, auc, nonzero) at every ``every``-th example, over its last ``size`` ones.

    ``scored`` has (by, step, label, prob, loss, nonzero) with steps 1, 2, ... within each group; rows before the first
    step that a report needs may be missing. Examples are first added up per ``every`` steps where that divides ``size``, so a window
    covers a few rows.
    """
    by = by or []
    unit = every if size % every == 0 else 1
    bucket = F.floor((F.col("step") - 1) / unit).alias("bucket")
    sums = scored.groupBy(*by, bucket).agg(
        *[F.sum(c).alias(n) for n, c in _parts(threshold).items()], F.max(F.struct("step", "nonzero")).alias("last"))
    rolled = rolling_sums(
        sums.withColumnsRenamed({n: f"own_{n}" for n in _parts(threshold)}), size // unit,
        {n: F.col(f"own_{n}") for n in _parts(threshold)}, "bucket", by)
    return rolled.where(F.col("last.step") % every == 0).select(
        *by, F.col("last.step").alias("step"), F.col("s_rows").alias("rows"), *_summary(), F.col("last.nonzero").alias("nonzero"))
