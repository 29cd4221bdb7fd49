"""Topic features of users from the bags of what they visited."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.hashing import text_hash
from ..session import new_folder
from .bags import bag_runs
from .skew import attach

TOPICS = 10
_SPARSE = 0  # how a stored vector says that it is sparse


def term_counts(
    runs: DataFrame, key: str, item: str, num_features: int = 1 << 18, method: str = "xxhash64"
) -> DataFrame:
    """(key, bucket, n): the lower-case items of each bag (key, item, n) hashed to buckets.

    At most ``num_features`` rows per key, whatever the size of its bag.
    """
    bucket = F.pmod(text_hash(F.lower(F.col(item)), method), F.lit(num_features).cast("bigint"))
    return runs.groupBy(key, bucket.alias("bucket")).agg(F.sum("n").alias("n"))


def term_vectors(counts: DataFrame, key: str, num_features: int = 1 << 18) -> DataFrame:
    """(key, features): one sparse vector per key, stored.

    A vector's fields are put together as columns and written; read back, they are the vector.
    """
    spark = counts.sparkSession
    entries = F.array_sort(F.collect_list(F.struct(F.col("bucket").cast("int").alias("bucket"), F.col("n").cast("double").alias("n"))))
    vector = F.struct(
        F.lit(_SPARSE).cast("tinyint").alias("type"), F.lit(num_features).alias("size"),
        F.col("__e.bucket").alias("indices"), F.col("__e.n").alias("values"))
    path = new_folder(spark, "terms")
    counts.groupBy(key).agg(entries.alias("__e")).select(key, vector.alias("features")).write.parquet(path)
    schema = StructType([counts.schema[key], StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path)


def fit_topics(tf: DataFrame, k: int = TOPICS, iterations: int = 10, seed: int = 1) -> LDAModel:
    return LDA(k=k, maxIter=iterations, optimizer="online", seed=seed).fit(tf)


def topic_shares(model: LDAModel, tf: DataFrame, key: str) -> DataFrame:
    """(key, topics): the shares of the topics in each key's vector."""
    return model.transform(tf).select(key, vector_to_array("topicDistribution").alias("topics"))


def save_topics(model: LDAModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_topics(path: str) -> LDAModel:
    return LocalLDAModel.load(path)


def user_topics(
    log: DataFrame, key: str = "user_id", item: str = "pub_id", num_features: int = 1 << 18,
    iterations: int = 10, seed: int = 1, k: int = TOPICS, method: str = "xxhash64", model_path: str | None = None,
) -> DataFrame:
    """(key, topics) from the bag of each key's items, duplicates kept.

    The vectors are stored, as fitting reads them once per iteration. With ``model_path`` the fitted model is stored there, for
    users to come.
    """
    tf = term_vectors(term_counts(bag_runs(log, key, item), key, item, num_features, method), key, num_features)
    model = fit_topics(tf, k, iterations, seed)
    if model_path is not None:
        save_topics(model, model_path)
    return topic_shares(model, tf, key)


def topics_of(
    log: DataFrame, model_path: str, key: str = "user_id", item: str = "pub_id", method: str = "xxhash64"
) -> DataFrame:
    """(key, topics) under a stored model; its buckets are those it was fitted with."""
    model = load_topics(model_path)
    size = model.vocabSize()
    return topic_shares(model, term_vectors(term_counts(bag_runs(log, key, item), key, item, size, method), key, size), key)


def with_topics(log: DataFrame, topics: DataFrame, spread: list[str], key: str = "user_id",
                **heavy) -> DataFrame:
    """Rows of users that have topics."""
    return attach(log, topics, [key], spread, "inner", **heavy)


def with_default_topics(log: DataFrame, topics: DataFrame, spread: list[str], key: str = "user_id",
                        size: int = TOPICS, **heavy) -> DataFrame:
    """All rows; users without topics get zeros."""
    return attach(log, topics, [key], spread, **heavy).withColumn(
        "topics", F.coalesce("topics", F.array_repeat(F.lit(0.0), size))
    )
