"""Scoring a table with a stored model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logistic import clipped
from ..operators.state import published
from ..operators.steps import predict


def score(examples: DataFrame, state: DataFrame, stored: bool = False, **heavy) -> DataFrame:
    """(example_id, prob) with probabilities strictly between 0 and 1."""
    scored = predict(examples, published(state), stored=stored, **heavy)
    return scored.select("example_id", clipped(F.col("prob")).alias("prob"))
