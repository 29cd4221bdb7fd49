"""The arithmetic of logistic models with per-coordinate rates, as column expressions.

Notation follows McMahan et al., "Ad Click Prediction: a View from the Trenches"
(KDD 2013): ``z`` and ``n`` are the per-feature sums the weight is computed from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a probability of exactly 0 or 1 is replaced by.
PROB_FLOOR = 0.0000000000001
PROB_CEILING = 0.999999999999


@dataclass(frozen=True)
class FtrlConfig:
    """Hyper-parameters; ``sigma_sign=+1`` flips the published sign of the sigma term.

    ``square`` says what a mini-batch adds to ``n``: the squares of each ``example``'s
    gradient, or the square of the whole ``batch``'s gradient. Both are the published
    update for batches of one. The second keeps large batches from overshooting: a batch
    of B like examples moves z by B gradients, but n by only B squares of the first kind.
    """

    alpha: float = 5.0
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    sigma_sign: int = -1
    square: str = "example"

    def __post_init__(self):
        if self.square not in ("example", "batch"):
            raise ValueError("square must be 'example' or 'batch'")

    def columns(self) -> "Rates":
        return Rates(*(F.lit(float(v)) for v in (self.alpha, self.beta, self.l1, self.l2)),
                     sigma_sign=F.lit(float(self.sigma_sign)))


@dataclass(frozen=True)
class Rates:
    """The same hyper-parameters as columns."""

    alpha: Column
    beta: Column
    l1: Column
    l2: Column
    sigma_sign: Column


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def clipped(prob: Column) -> Column:
    return (
        F.when(prob == 0.0, F.lit(PROB_FLOOR))
        .when(prob == 1.0, F.lit(PROB_CEILING))
        .otherwise(prob)
    )


def log_loss(label: Column, prob: Column) -> Column:
    """Loss of one example; ``prob`` must be clipped."""
    label = label.cast("double")
    return -label * F.log(prob) - (1.0 - label) * F.log(1.0 - prob)


def gradient(label: Column, prob: Column, value: Column) -> Column:
    return (prob - label.cast("double")) * value


def inverse_rate(n: Column, rates: Rates) -> Column:
    """1 / eta."""
    return (rates.beta + F.sqrt(n)) / rates.alpha + rates.l2


def rate(n: Column, rates: Rates) -> Column:
    """eta, the learning rate of one coordinate."""
    return 1.0 / inverse_rate(n, rates)


def weight(z: Column, n: Column, rates: Rates) -> Column:
    """Soft threshold: zero until ``|z|`` exceeds l1."""
    return F.when(F.abs(z) <= rates.l1, F.lit(0.0)).otherwise(
        -(z - F.signum(z) * rates.l1) / inverse_rate(n, rates)
    )


def sigma(old_n: Column, new_n: Column, rates: Rates) -> Column:
    return (F.sqrt(new_n) - F.sqrt(old_n)) / rates.alpha


def next_z(z: Column, g: Column, old_n: Column, new_n: Column, w: Column, rates: Rates) -> Column:
    return z + g + rates.sigma_sign * sigma(old_n, new_n, rates) * w


def counted_n(positives: Column, negatives: Column) -> Column:
    """Squared-gradient sum estimated from label counts alone."""
    total = positives + negatives
    return F.when(total > 0, positives * negatives / total).otherwise(F.lit(0.0))


def gradient_step(w: Column, g: Column, step_rate: Column) -> Column:
    return w - step_rate * g
