"""A pipeline over ``documents``: classify, drop recurring lines, drop near-duplicates, decontaminate, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickengine.llm import decontaminate, importance, minmax, templates
from clickengine.llm.common import table
from clickengine.llm.queries import piece_digests, piece_model
from clickengine.session import configure, new_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# Importance resampling, templates, latent retrieval and tokens are beyond SQL; tests check the stages.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws."""
    return importance.resample(docs.select(*COLUMNS), table(configure(spark), sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs; ``n_chars`` follows the text."""
    configure(spark)
    out = templates.drop_recurring_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each component of near-duplicates."""
    configure(spark)
    found = minmax.near_duplicates(docs, size=5)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.select(*COLUMNS).join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_benchmark(docs.select(*COLUMNS), table(configure(spark), sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    configure(spark)
    return piece_digests(docs, piece_model())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
