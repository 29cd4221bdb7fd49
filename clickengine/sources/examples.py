"""LIBSVM lines, JSON envelopes and score files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.features import FEATURE_MAP


def unwrap_envelope(df: DataFrame, column: str = "value", name: str = "line") -> DataFrame:
    """The ``payload`` field of a JSON text; null for bad JSON or a missing field."""
    return df.withColumn(name, F.from_json(column, "payload string")["payload"])


def _number(text: Column, kind: str) -> Column:
    return text.try_cast(kind)


def parse_libsvm(df: DataFrame, column: str = "line") -> DataFrame:
    """Add ``label``, ``features`` and ``valid``.

    Indices count from 0 and may come in any order, with any number of spaces between
    them; of a repeated index the last value holds. A line that does not parse, or whose
    label is neither 0 nor 1, keeps null features and ``valid`` false.
    """
    parts = F.col("__parts")
    pairs = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            _number(F.get(F.split(p, ":"), F.lit(0)), "bigint").alias("k"),
            _number(F.get(F.split(p, ":"), F.lit(1)), "double").alias("v"),
        ),
    )
    sound = F.col("__label").isin(0, 1) & F.forall(
        "__pairs", lambda e: e["k"].isNotNull() & e["v"].isNotNull()
    )
    # Columns of their own, so that a line is taken apart once.
    staged = (
        df.withColumn("__parts", F.split(F.trim(F.col(column)), " +"))
        .withColumn("__label", _number(F.get(parts, F.lit(0)), "int"))
        .withColumn("__pairs", pairs)
        .withColumn("valid", F.coalesce(sound, F.lit(False)))
    )
    return staged.select(
        *df.columns,
        F.when(F.col("valid"), F.col("__label")).alias("label"),
        F.when(F.col("valid"), F.map_from_entries("__pairs")).cast(FEATURE_MAP).alias("features"),
        "valid",
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("valid").drop("valid")


def rejected(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """What did not parse, for a table of rejects."""
    return parsed.where(~F.col("valid")).select(*keep)


def libsvm_line(label: str = "label", features: str = "features") -> Column:
    """``label idx:value ...`` in ascending order of the index."""
    entries = F.transform(
        F.array_sort(F.map_entries(features)),
        lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")),
    )
    return F.concat_ws(" ", F.col(label).cast("string"), entries)


def write_libsvm(examples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    examples.select(libsvm_line().alias("value")).write.mode(mode).text(path)


def score_line(example_id: str = "example_id", prob: str = "prob") -> Column:
    """``id,prob`` with eight decimals."""
    return F.format_string("%s,%.8f", F.col(example_id).cast("string"), F.col(prob))


def write_scores(scored: DataFrame, path: str, header: bool = False, mode: str = "errorifexists"):
    """Score lines as text, or as CSV files that start with ``id,click``."""
    if not header:
        scored.select(score_line().alias("value")).write.mode(mode).text(path)
        return
    scored.select(
        F.col("example_id").cast("string").alias("id"),
        F.format_string("%.8f", F.col("prob")).alias("click"),
    ).write.mode(mode).csv(path, header=True)
