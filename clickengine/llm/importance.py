"""Quality classifier by importance resampling.

Two generative models of hashed word 1-grams and 2-grams, one of the raw text (all documents)
and one of the target text (good labelled documents), give every document the log of its importance
weight, the sum over its n-grams of log p_target - log p_raw. Counts that the target's size
explains by chance (less than ``DEVIATIONS`` standard deviations from what the raw model expects) give a ratio
of 1. A Gumbel number drawn from the document's id is added, and the documents with the k
largest sums are the sample: drawing k without replacement in proportion to the weights.
k is the share of target rows among labelled rows times the number of documents.

The model has ``BUCKETS`` entries, a fixed size; raw counts cover all documents, target counts
about ``LABELLED`` labelled documents at most, chosen by a hash of the id. The k-th largest sum is found by
counting over ever finer ranges, without a global sort.

Null and empty texts have no n-grams and a weight of 0 before the Gumbel number. Rows of equal sum are taken by
id, then by their place; repeated rows get the same number and stay or go together as far as k allows. Without
labels all rows are kept. An empty table gives an empty result. Texts are read whole; columns other than those
named are kept by ``resample`` and ignored by ``weigh``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_text, map_batches, offsets_of, texts_of, unused
from .components import stored

BUCKETS = 1 << 20
DEVIATIONS = 3.0
SMOOTHING = 0.5
LABELLED = 100_000
RANGES = 4096

_PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1-grams and 2-grams: buckets, one text after another, and the number of each text's."""
    index: dict[bytes, int] = {}
    codes: list[int] = []
    n_words = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "replace").lower().split()
        n_words[k] = len(words)
        for w in words:
            c = index.get(w)
            if c is None:
                c = index[w] = len(index)
            codes.append(c)
    if not codes:
        return []
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in index], np.uint64)[np.array(codes, np.int64)]
    text_no = np.repeat(np.arange(len(texts)), n_words)
    pair = ((h[:-1] * _PAIR) ^ (h[1:] >> np.uint64(7))) * _PAIR
    inner = text_no[:-1] == text_no[1:]
    shift = np.uint64(64 - int(math.log2(BUCKETS)))
    return [
        (((h * _PAIR) >> shift).astype(np.int64), n_words),
        ((pair[inner] >> shift).astype(np.int64), np.maximum(n_words - 1, 0)),
    ]


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all documents. Partitions send a row per bucket they saw."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for buckets, _ in features(texts_of(batch.column("text"))):
                total += np.bincount(buckets, minlength=BUCKETS)
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 1 << 16):
            part = seen[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bucket", "n"])

    counts = docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    out = np.zeros(BUCKETS)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per bucket, 0 where chance explains the difference."""
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    sure = np.abs(target - expected) >= DEVIATIONS * np.sqrt(expected + 1)
    return np.where(sure, np.log((target + SMOOTHING) / (expected + SMOOTHING)), 0.0)


def gumbel(doc_id: Column) -> Column:
    """A Gumbel number that depends on the id only."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit("gumbel")), 12) + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def weigh(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[DataFrame, float]:
    """(doc_id, place, log_weight, key) of every document, and the share of target rows among labels."""
    rows = id_text(docs).withColumn("place", F.monotonically_increasing_id())
    marks = labels.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.col("quality") == 1, F.lit(False)) & F.coalesce(F.col("toxic") == 0, F.lit(False))).alias("good"),
    ).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("good").alias("good"))
    n, good = marks.agg(F.count(F.lit(1)), F.count(F.when(F.col("good"), 1))).first()
    share = good / n if n else 1.0
    # A choice by a hash of the id, of about ``labelled`` ids at most.
    part = int(min(1.0, labelled / max(good, 1)) * (1 << 20))
    chosen = marks.where("good").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part).select("doc_id")
    raw = bucket_counts(rows)
    # About ``labelled`` ids of eight bytes at most, so texts stay where they are.
    target = bucket_counts(rows.join(F.broadcast(chosen), "doc_id", "left_semi"))
    table = docs.sparkSession.sparkContext.broadcast(log_ratios(raw, target).astype(np.float32))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        weight = np.zeros(batch.num_rows)
        for buckets, counts in features(texts_of(batch.column("text"))):
            total = offsets_of(counts)
            sums = np.concatenate([[0.0], np.cumsum(table.value[buckets], dtype=np.float64)])
            weight += sums[total[1:]] - sums[total[:-1]]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("place"), pa.array(weight, pa.float64())],
            names=["doc_id", "place", "log_weight"])

    weights = map_batches(rows, run, "doc_id bigint, place bigint, log_weight double")
    weights = weights.withColumn("log_weight", F.round("log_weight", 6))
    return weights.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"))), share


def top_k(keyed: DataFrame, k: int) -> DataFrame:
    """``keyed`` with ``kept``: true for the k rows of the largest key (ties: smallest id, then place)."""
    n, low, high = keyed.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    if k >= n:
        return keyed.withColumn("kept", F.lit(True))
    if k <= 0:
        return keyed.withColumn("kept", F.lit(False))
    above = 0
    while high > low:
        step = (high - low) / RANGES
        inside = keyed.where((F.col("key") >= low) & (F.col("key") <= high))
        slot = F.least(F.floor((F.col("key") - low) / F.lit(step)).cast("int"), F.lit(RANGES - 1))
        counts = inside.groupBy(slot.alias("slot")).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for row in sorted(counts.collect(), key=lambda r: -r["slot"]):  # RANGES rows at most
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    # All keys above ``low`` are in; of those equal to it, the first k - above by id and place.
    tied = keyed.where(F.col("key") == low).select("doc_id", "place")
    last = tied.orderBy(F.col("doc_id").asc_nulls_last(), "place").limit(k - above).agg(
        F.max(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "place")).alias("m")).first()["m"]
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("place"))
    limit = F.struct(F.lit(last[0]).cast("bigint"), F.lit(last[1]).cast("bigint"))
    return keyed.withColumn("kept", (F.col("key") > low) | ((F.col("key") == low) & (order <= limit)))


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, log_weight, key and kept for every document."""
    weights, share = weigh(docs, labels, labelled)
    weights = stored(weights, "weights")
    k = round(share * weights.count())
    return top_k(weights, k).select("doc_id", "log_weight", "key", "kept")


def resample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """The sampled documents, all their columns. Rows that share an id stay if one of them does."""
    own = unused(docs, "__id")
    kept = classify(docs, labels, labelled).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").cast("bigint").eqNullSafe(F.col(own)), "left_semi")
