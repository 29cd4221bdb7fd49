"""Benchmark decontamination by latent semantic retrieval.

Words are hashed into ``FEATURES`` features, weighted by the IDF that all documents give. The passages of the
benchmark (items of up to ``PASSAGE`` words, longer ones in overlapping passages) form a TF-IDF
matrix A, whose leading ``RANK`` right singular vectors come from a distributed randomised SVD: partitions
add up A'(AZ) for a random Z, ``POWER`` times, and the driver only orthonormalises the features x rank
basis. The passages of a document (``PASSAGE`` words, half overlapping) are projected on the space; those with a cosine of at least
``COSINE`` to one of an item's passages are tried with the item, by falling cosine. Documents that hold too few of the item's answer words
(below) anywhere are passed over first, which an index of those words tells. What the space keeps of an item shrinks as the items grow in number: items
of which it keeps too little (``PLANTED``), and short ones, are tried at every passage around which enough of their answer words stand. An item counts
when its words and the document's words around a passage have a longest common subsequence of at least ``LCS_SHARE`` of the item
within a stretch of ``STRETCH`` times its length, whichever word that begins at, and the answer check holds: at least ``ANSWER_SHARE`` of
the rarer half of the item's words, which carry its answer, stand there too. So changed, left out or added words do not hide an item.

Benchmark items are taken in blocks of ``ITEMS_PER_PASS``, so any number of them is
held against all documents; documents are never moved. Null and empty texts, and items without words,
match nothing; items of fewer than ``SHORT`` words must occur word for word. Texts are read
whole. Repeated rows and ids are searched one by one, with one result row per (doc_id, item_id), the best.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_text, map_batches, offsets_of, spread_rows, texts_of, unused
from .components import stored

FEATURES = 1 << 16
RANK = 128
OVERSAMPLE = 8
POWER = 2
PASSAGE = 48
HALF = PASSAGE // 2
LCS_SHARE = 0.7
STRETCH = 1.5
ANSWER_SHARE = 0.5
# A passage is tried with the items of at least this cosine. An item is left to the space if that keeps so much of it that a passage
# with ``PLANTED`` of the item's weight reaches the cosine.
COSINE = 0.15
PLANTED = 0.3
SHORT = 6
ITEMS_PER_PASS = 10_000
CHUNK = 1 << 14

# ASCII other than letters and digits separates words.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split()


class Features(dict):
    """Feature numbers of words; remembers the words of a batch."""

    def __missing__(self, word: bytes) -> int:
        self[word] = feature = xxhash.xxh3_64_intdigest(word) >> 48
        return feature

    def __call__(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def passages(words: list[bytes]) -> list[list[bytes]]:
    """An item's words, in overlapping passages if there are many."""
    if len(words) <= PASSAGE + HALF:
        return [words] if words else []
    return [words[i:i + PASSAGE] for i in range(0, len(words) - HALF, HALF)]


def idf_of(docs: DataFrame) -> np.ndarray:
    """IDF of every feature over all documents."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            features = Features()
            for text in texts_of(batch.column("text")):
                df[features(set(words_of(text)))] += 1  # once per feature
                n += 1
        df[FEATURES] = n
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(df[seen])], names=["feature", "n"])

    counts = docs.select("text").mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # FEATURES + 1 rows at most
    df = np.zeros(FEATURES + 1)
    df[found.column("feature").to_numpy()] = found.column("n").to_numpy()
    return np.log((df[FEATURES] + 1) / (df[:FEATURES] + 1)) + 0.1


def tfidf(words: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights of a passage, of unit length."""
    features, counts = np.unique(Features()(words), return_counts=True)
    weights = counts * idf[features]
    return features, weights / max(np.linalg.norm(weights), 1e-12)


def latent_basis(items: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Orthonormal basis (features x rank) of the leading right singular vectors of the items' passages.

    Features that no item has keep a row of zeros, and take no room on the way.
    """
    spark = items.sparkSession
    bound_batches(spark)
    rng = np.random.default_rng(7)
    used = np.zeros(0, np.int64)
    basis = np.zeros((0, 0), np.float32)
    for turn in range(POWER + 1):
        shared = spark.sparkContext.broadcast((idf.astype(np.float32), used, basis))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            weight, used, basis = shared.value
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for text in texts_of(batch.column("text")):
                    for p in passages(words_of(text)):
                        f, w = tfidf(p, weight)
                        z = start_rows(f) if turn == 0 else basis[np.searchsorted(used, f)]
                        for name, row in zip(f.tolist(), np.outer(w, w @ z)):
                            total[name] = total[name] + row if name in total else row
            names = sorted(total)
            for at in range(0, len(names), 2048):
                part = names[at:at + 2048]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array([total[n].astype(np.float64).tobytes() for n in part], pa.binary())],
                    names=["feature", "row"])

        def add(key, group):
            rows = np.frombuffer(b"".join(group.column("row").to_pylist()), np.float64)
            feature = group.column("feature").to_numpy()
            rows = rows.reshape(len(feature), -1)
            names, inverse = np.unique(feature, return_inverse=True)
            total = np.zeros((len(names), rows.shape[1]))
            np.add.at(total, inverse, rows)
            return pa.table({"feature": pa.array(names, pa.int32()), "row": pa.array([r.tobytes() for r in total], pa.binary())})

        partial = items.select("text").mapInArrow(run, "feature int, row binary")
        summed = partial.withColumn("part", F.pmod("feature", F.lit(64))).groupBy("part").applyInArrow(
            add, "feature int, row binary").toArrow()  # FEATURES rows of RANK + OVERSAMPLE numbers at most
        if not summed.num_rows:
            break
        found = summed.column("feature").to_numpy()
        order = np.argsort(found)
        rows = np.frombuffer(b"".join(summed.column("row").to_pylist()), np.float64).reshape(len(found), -1)[order]
        used = found[order].astype(np.int64)
        left, sizes, _ = np.linalg.svd(rows, full_matrices=False)
        basis = (left * (sizes > 1e-6 * max(sizes[0], 1e-12))).astype(np.float32)
    out = np.zeros((FEATURES, RANK), np.float32)
    out[used, :min(RANK, basis.shape[1])] = basis[:, :RANK]
    return out


def start_rows(features: np.ndarray) -> np.ndarray:
    """The random start of the power iteration, the same for a feature wherever it is drawn."""
    return np.stack([np.random.default_rng(int(f)).standard_normal(RANK + OVERSAMPLE) for f in features])


class Projection:
    """Features to latent space; only features that the items have take part, others go to the last, empty row."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray):
        used = np.flatnonzero(basis.any(axis=1))
        self.row = np.full(FEATURES, len(used), np.int32)
        self.row[used] = np.arange(len(used))
        self.matrix = np.zeros((len(used) + 1, basis.shape[1]), np.float32)
        self.matrix[:-1] = idf[used, None] * basis[used]
        self.square = (idf ** 2).astype(np.float32)


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a word of ``b`` at a time over the bits of ``a``."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for w in b:
        hit = state & places.get(w, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def best_stretch(item: list[bytes], region: list[bytes]) -> int:
    """Largest LCS of the item with a stretch of the region of at most ``STRETCH`` times its length, of all stretches."""
    n = len(item)
    if n < SHORT:
        return n if any(region[i:i + n] == item for i in range(len(region) - n + 1)) else 0
    width = math.ceil(n * STRETCH)
    own = set(item)
    # Words that the item lacks add nothing, so a stretch is as good as the one that begins at its first word of the item, and
    # no better than its number of such words.
    known = [0]
    for w in region:
        known.append(known[-1] + (w in own))
    best = math.ceil(LCS_SHARE * n - 1e-9) - 1
    found = 0
    for i in range(len(region)):
        if known[i + 1] > known[i] and known[min(i + width, len(region))] - known[i] > best:
            common = lcs(item, region[i:i + width])
            if common > best:
                best = found = common
                if best == n:
                    break
    return found


class Items:
    """A block of benchmark items, ready to be compared with."""

    def __init__(self, rows: list[tuple[int, str]], idf: np.ndarray, basis: np.ndarray, exact: bool = False):
        self.ids, self.words, self.answers, self.owner, self.in_space = [], [], [], [], []
        vectors = []
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append(words)
            rare = sorted(set(words), key=lambda w: (-idf[xxhash.xxh3_64_intdigest(w) >> 48], w))
            self.answers.append(frozenset(rare[:(len(rare) + 1) // 2]))
            kept = 1.0
            for p in passages(words):
                f, w = tfidf(p, idf)
                v = (w[:, None] * basis[f]).sum(axis=0)
                kept = min(kept, float(np.linalg.norm(v)))
                vectors.append(v / max(np.linalg.norm(v), 1e-12))
                self.owner.append(k)
            self.in_space.append(not exact and len(words) >= SHORT and PLANTED * kept >= COSINE)
        self.owner = np.array(self.owner, np.int64)
        self.vectors = np.array(vectors, np.float32).reshape(len(vectors), basis.shape[1])
        self.first = np.searchsorted(self.owner, np.arange(len(self.ids) + 1))
        # Items by the features of their answers; words of one item that share a feature count one each.
        self.needed = np.array([ANSWER_SHARE * len(a) for a in self.answers])
        self.sought = [np.unique(Features()(a), return_counts=True) for a in self.answers]
        holders = [np.full(len(f), k) for k, (f, _) in enumerate(self.sought)]
        postings = [np.concatenate(c) if c else np.zeros(0, np.int64)
                    for c in ([f for f, _ in self.sought], holders, [n for _, n in self.sought])]
        by = np.argsort(postings[0], kind="stable")
        self.holder, self.weight = postings[1][by], postings[2][by]
        self.postings = np.bincount(postings[0], minlength=FEATURES)
        self.start = offsets_of(self.postings)[:-1]

    def possible(self, features: np.ndarray) -> np.ndarray:
        """The items of which the features of a document hold enough of the answer."""
        here = np.unique(features[self.postings[features] > 0])
        if not len(here):
            return here
        at = spread_rows(self.start[here], self.postings[here])
        return np.flatnonzero(np.bincount(self.holder[at], self.weight[at], len(self.ids)) >= self.needed)

    def holds(self, k: int, region: list[bytes]) -> int:
        """Length of the common subsequence if the item is there, else 0."""
        item, answer = self.words[k], self.answers[k]
        if len(answer.intersection(region)) < ANSWER_SHARE * len(answer):
            return 0
        found = best_stretch(item, region)
        return found if found >= LCS_SHARE * len(item) else 0


def search(words: list[bytes], features: np.ndarray, space: Projection, items: Items) -> dict[int, tuple[float, int]]:
    """Items found in one document: (cosine, common words) by item."""
    found: dict[int, tuple[float, int]] = {}
    possible = items.possible(features)
    if not len(possible):
        return found
    by = np.argsort(features, kind="stable")
    ordered = features[by]
    sums = project(features, space)
    for k in possible.tolist():
        length = len(items.words[k])
        cosine = (sums @ items.vectors[items.first[k]:items.first[k + 1]].T).max(axis=1)
        if items.in_space[k]:
            near = np.flatnonzero(cosine >= COSINE)
        else:
            left, right = (np.searchsorted(ordered, items.sought[k][0], side) for side in ("left", "right"))
            hits = np.sort(by[spread_rows(left, right - left)])
            starts = np.arange(len(sums)) * HALF
            there = np.searchsorted(hits, starts + PASSAGE + length) - np.searchsorted(hits, starts - length)
            near = np.flatnonzero(there * items.sought[k][1].max() >= items.needed[k])
        for i in near[np.argsort(-cosine[near], kind="stable")].tolist():
            start = i * HALF
            common = items.holds(k, words[max(0, start - length):start + PASSAGE + length])
            if common and (k not in found or common > found[k][1]):
                found[k] = (float(cosine[i]), common)
                if common == length:
                    break
    return found


def project(features: np.ndarray, space: Projection) -> np.ndarray:
    """The passages of a document in latent space."""
    halves = np.arange(0, len(features), HALF)
    sums = np.zeros((len(halves), space.matrix.shape[1]), np.float32)
    norms = np.add.reduceat(space.square[features], halves)
    rows = space.row[features]
    known = np.flatnonzero(rows < len(space.matrix) - 1)
    for at in range(0, len(known), CHUNK):
        part = known[at:at + CHUNK]
        half = part // HALF
        first = np.flatnonzero(np.diff(half, prepend=-1))
        sums[half[first]] += np.add.reduceat(space.matrix[rows[part]], first, axis=0)
    if len(halves) > 1:
        sums, norms = sums[:-1] + sums[1:], norms[:-1] + norms[1:]
    return sums / np.sqrt(np.maximum(norms, 1e-12))[:, None]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", exact: bool = False) -> DataFrame:
    """(doc_id, item_id, cosine, common_words, item_words) for every item found in a document.

    ``exact`` tries all passages that the index names, for all items, and asks for no cosine.
    """
    spark = docs.sparkSession
    rows = id_text(docs)
    items = id_text(benchmark, id_col).withColumnRenamed("doc_id", "item_id")
    idf = idf_of(rows)
    basis = latent_basis(items, idf)
    shared = spark.sparkContext.broadcast(Projection(idf, basis))
    blocks = max(1, math.ceil(items.count() / ITEMS_PER_PASS))
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        listed = [(r["item_id"], r["text"]) for r in mine.collect()]  # one block
        held = spark.sparkContext.broadcast(Items(listed, idf, basis, exact))
        part = _found(rows, shared, held)
        if blocks > 1:
            # One block after another, so that the driver and the tasks hold one at a time.
            part = stored(part, "found")
            held.destroy()
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("common_words", "cosine", "item_words")).alias("m")).select(
        "doc_id", "item_id", F.round("m.cosine", 4).alias("cosine"), "m.common_words", "m.item_words")


def _found(rows: DataFrame, shared, held) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        space, items = shared.value, held.value
        features = Features()
        out: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
            words = words_of(text)
            if words and len(items.ids):
                hits = search(words, features(words), space, items)
                out += [(doc_id, items.ids[k], c, n, len(items.words[k])) for k, (c, n) in hits.items()]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        columns = zip(*out) if out else [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)],
            names=["doc_id", "item_id", "cosine", "common_words", "item_words"])

    return map_batches(rows, run, "doc_id bigint, item_id bigint, cosine double, common_words bigint, item_words bigint")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no item was found. Rows that share an id go together; null ids too."""
    own = unused(docs, "__id")
    hit = contaminated(docs, benchmark).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(hit, F.col("doc_id").cast("bigint").eqNullSafe(F.col(own)), "left_anti")
