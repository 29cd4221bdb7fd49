"""Near-duplicates by min-max hashing.

A document's set holds its distinct shingles of ``size`` words. Under each of ``PERMUTATIONS`` permutations
both the smallest and the largest shingle are kept, so a signature of twice as many values
costs half the hash evaluations. Bands of ``BAND`` values give the buckets: at similarity 0.8
two sets share none of the 32 buckets once in twenty million pairs.

1. Documents with the same set form a class at once (equal 64-bit set digests); only classes go on.
2. ``STARS`` times, each bucket's classes are compared with one class of the bucket, another each time:
   candidate links are checked on signatures (60 % of the values, 5 deviations below 0.8), then on the
   full shingle sets, and linked classes become components. Buckets of one component are done.
3. In buckets that still hold several components, every class outside the largest is compared with all
   others inside the task, in blocks of ``BLOCK`` classes: first by signature, which leaves the classes that agree
   with one of another component, then these on full sets. Only the few links that join components leave a task. So no link found by the buckets is left out, and no group's pairs are listed.

Null and empty texts have the empty set, link with nothing and are components of their own. Texts
with fewer words than a shingle have their whole sequence as one shingle. Texts are read whole.
Repeated rows fall in one class; a null id counts as larger than all others.
An empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_text, map_batches, offsets_of, spread_rows, texts_of
from .components import components, stored

PERMUTATIONS = 64
BAND = 4
AGREE = 0.6
BLOCK = 512
STARS = 3
SIMILAR = (80, 100)

_SEED = np.random.default_rng(20_240_607)
_FACTORS = _SEED.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _SEED.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_MIX = _SEED.integers(0, 2**63, 2 * PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Runs of anything but white space (\\x20, \\x09-\\x0D), A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted, one after another; and their numbers."""
    index: dict[bytes, int] = {}
    codes: list[int] = []
    n_words = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = words_of(text)
        n_words[k] = len(found)
        for w in found:
            c = index.get(w)
            if c is None:
                c = index[w] = len(index)
            codes.append(c)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in index], np.uint64)
    flat = hashes[np.array(codes, np.int64)] if codes else np.zeros(0, np.uint64)
    out, counts = [], np.zeros(len(texts), np.int64)
    at = offsets_of(n_words)
    for k in range(len(texts)):
        h = flat[at[k]:at[k + 1]]
        if not len(h):
            continue
        width = min(size, len(h))
        total = np.zeros(len(h) - width + 1, np.uint64)
        for j in range(width):
            total = (total + h[j:j + len(total)]) * _BASE
        got = np.unique(mixed(total + np.uint64(width)))
        counts[k] = len(got)
        out.append(got)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, for texts with at least one shingle."""
    starts = offsets_of(counts)[:-1]
    out = np.empty((len(counts), 2 * PERMUTATIONS), np.uint64)
    for p in range(PERMUTATIONS):
        x = hashes * _FACTORS[p] + _SHIFTS[p]
        out[:, 2 * p] = np.minimum.reduceat(x, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(x, starts)
    return out


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set), bands and the signature's low bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, counts = shingle_hashes(texts_of(batch.column("text")), size)
        full = np.flatnonzero(counts)
        n = len(counts)
        node, bands, low = [None] * n, [None] * n, [None] * n
        if len(full):
            sig = signatures(hashes, counts[full])
            keys = mixed(sig * _MIX)
            keys = keys.reshape(len(full), -1, BAND).sum(axis=2, dtype=np.uint64)
            keys = mixed(keys + np.arange(keys.shape[1], dtype=np.uint64)).view(np.int64)
            short = mixed(sig).astype(np.uint8)
            at = offsets_of(counts)
            for k, row in enumerate(full):
                own = hashes[at[row]:at[row + 1]]
                node[row] = digest(own)
                bands[row] = keys[k]
                low[row] = short[k].tobytes()
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(node, pa.int64()),
             pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())],
            names=["doc_id", "n_shingles", "node", "bands", "low"])

    return map_batches(id_text(docs), run, "doc_id bigint, n_shingles bigint, node bigint, bands array<bigint>, low binary")


def _close_sizes(a: Column, b: Column, similar: tuple[int, int]) -> Column:
    return F.least(a, b) * similar[1] >= F.greatest(a, b) * similar[0]


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in enough values."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for c in ("low_a", "low_b"))
        keep = pa.array((a == b).mean(axis=1) >= AGREE)
        return batch.select(["a", "b"]).filter(keep)

    return map_batches(pairs.select("a", "b", "low_a", "low_b"), run, "a bigint, b bigint")


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, hashes): the full shingle set of each class in ``nodes``, as sorted 64-bit hashes."""
    wanted = nodes.join(classes.select("node", "key"), "node")
    keyed = id_text(docs).select(_key(F.col("doc_id")).alias("key"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, counts = shingle_hashes(texts_of(batch.column("text")), size)
        at = offsets_of(counts)
        own = [hashes[at[k]:at[k + 1]] for k in range(batch.num_rows)]
        # An id may be that of several texts; the right one is told by its digest.
        keep = [digest(h) == node for h, node in zip(own, batch.column("node").to_pylist())]
        out = pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array([h.tobytes() for h in own], pa.binary())], names=["node", "hashes"])
        return out.filter(pa.array(keep, pa.bool_()))

    found = map_batches(keyed.join(wanted, "key").select("node", "text"), run, "node bigint, hashes binary")
    return found.dropDuplicates(["node"])


def digest(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def confirmed(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough."""
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b")), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for raw_a, raw_b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
            a, b = np.frombuffer(raw_a, np.uint64), np.frombuffer(raw_b, np.uint64)
            common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            keep.append(common * similar[1] >= (len(a) + len(b) - common) * similar[0])
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(rows, run, "a bigint, b bigint")


def _key(doc_id: Column) -> Column:
    """Ids as sortable keys without null."""
    return F.coalesce(doc_id, F.lit((1 << 63) - 1).cast("bigint"))


def _links_within(group: list[tuple], similar: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between the components of one group (two blocks of a bucket), as few as join them.

    Every class outside the largest component is compared with all classes of other components
    on full sets, by counting common shingles over an index of the group.
    """
    label = np.array([g[5] for g in group])
    if (label == label[0]).all():
        return []
    across = group[0][1] != group[0][2]
    side = np.array([g[3] for g in group])
    sets = [np.frombuffer(g[6], np.uint64) for g in group]
    sizes = np.array([len(x) for x in sets])
    at = offsets_of(sizes)
    _, entry = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(entry, kind="stable")
    owner = np.repeat(np.arange(len(group)), sizes)[by]
    starts = offsets_of(np.bincount(entry))
    names, n = np.unique(label, return_counts=True)
    largest = names[n.argmax()]
    out = []
    for i in np.flatnonzero(label != largest):
        mine = entry[at[i]:at[i + 1]]
        lists = owner[spread_rows(starts[mine], starts[mine + 1] - starts[mine])]
        common = np.bincount(lists, minlength=len(group))
        link = common * similar[1] >= (sizes + sizes[i] - common) * similar[0]
        link &= label != label[i]
        if across:
            link &= side != side[i]
        for j in np.flatnonzero(link):
            if label[j] != label[i]:
                out.append((group[i][4], group[j][4]))
                label[label == label[i]] = label[j]
    return out


def _block_pairs(rows: DataFrame, carry: str) -> DataFrame:
    """(bucket, lo, hi, own, node, component, carry) by bucket and pair of blocks.

    A bucket of more than ``BLOCK`` classes is cut into blocks, every two of which meet in a
    task, so a task holds two blocks at a time.
    """
    counted = rows.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket")
    dealt = counted.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        "own", "node", "component", carry,
    )
    bound_batches(rows.sparkSession)
    return dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def _by_group(batches: Iterator[pa.RecordBatch], work, names: list[str]) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of each (bucket, lo, hi) that streams by, all of whose results are bigint."""
    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    group: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and row[:3] != group[0][:3]:
                out += work(group)
                group = []
            group.append(row)
        yield made(out)
    if group:
        yield made(work(group))


def _agreeing_across(group: list[tuple]) -> list[tuple[int, int, int]]:
    """(bucket, node, component) of the classes whose signature agrees with one of another component."""
    label = np.array([g[5] for g in group])
    if (label == label[0]).all():
        return []
    low = np.frombuffer(b"".join(g[6] for g in group), np.uint8).reshape(len(group), -1)
    names, n = np.unique(label, return_counts=True)
    found = np.zeros(len(group), bool)
    for i in np.flatnonzero(label != names[n.argmax()]):
        others = label != label[i]
        others[others] = (low[others] == low[i]).mean(axis=1) >= AGREE
        found |= others
        found[i] |= others.any()
    return [(group[i][0], group[i][4], group[i][5]) for i in np.flatnonzero(found)]


def likely_rows(rows: DataFrame) -> DataFrame:
    """The rows (bucket, node, component, low) that may have a link to another component in their bucket."""
    names = ["bucket", "node", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_group(batches, _agreeing_across, names)

    return _block_pairs(rows, "low").mapInArrow(run, "bucket bigint, node bigint, component bigint").distinct()


def exhaustive_links(rows: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(a, b): links between different components within buckets, from rows (bucket, node, component, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_group(batches, lambda group: _links_within(group, similar), ["a", "b"])

    return _block_pairs(rows, "hashes").mapInArrow(run, "a bigint, b bigint")


def star_pairs(rows: DataFrame, classes: DataFrame, turn: int, similar: tuple[int, int]) -> DataFrame:
    """(a, b): each bucket's classes with its centre, another one each turn, where signatures agree."""
    order = F.xxhash64("node", F.lit(turn))
    centres = rows.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "node", "component")).alias("m")).select(
        "bucket", F.col("m.node").alias("b"), F.col("m.component").alias("own"))
    stars = rows.join(centres, "bucket").where(F.col("component") != F.col("own")).select(
        F.col("node").alias("a"), "b").distinct()
    facts = classes.select("node", "size", "low")
    stars = stars.join(facts.toDF("a", "size_a", "low_a"), "a").join(facts.toDF("b", "size_b", "low_b"), "b")
    return _agreeing(stars.where(_close_sizes(F.col("size_a"), F.col("size_b"), similar)))


def still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with the components of now."""
    named = rows.select("bucket", "node").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    several = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(
        F.col("x") < F.col("y")).select("bucket")
    return named.join(several, "bucket").select("bucket", "node", "component")


def near_duplicates(docs: DataFrame, size: int = 5, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept, per document."""
    sketched = stored(sketch(docs, size), "sketches")
    classes = stored(
        sketched.where(F.col("n_shingles") > 0).withColumn("key", _key(F.col("doc_id"))).groupBy("node").agg(
            F.min(F.struct("key", "n_shingles", "bands", "low")).alias("m")
        ).select("node", "m.key", F.col("m.n_shingles").alias("size"), "m.bands", "m.low"), "classes",
    )
    members = classes.select(F.posexplode("bands").alias("band", "value"), "node").select(
        F.xxhash64("band", "value").alias("bucket"), "node")
    several = members.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where(
        F.col("x") < F.col("y")).select("bucket")
    open_rows = stored(members.join(several, "bucket").withColumn("component", F.col("node")), "buckets")
    # Texts are read and moved once more, for the classes that share a bucket with another one.
    sets = stored(sets_of(open_rows.select("node").distinct(), classes, docs, size), "sets")
    links = None
    for turn in range(STARS):
        pairs = stored(star_pairs(open_rows, classes, turn, similar), "stars")
        found = stored(confirmed(pairs, sets, similar), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        open_rows = stored(still_open(open_rows, labels), "buckets")
    likely = likely_rows(open_rows.join(classes.select("node", "low"), "node"))
    more = stored(exhaustive_links(likely.join(sets, "node").select(
        "bucket", "node", "component", "hashes"), similar), "links")
    labels = components(links.unionByName(more))
    named = classes.select("node", "key").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("key").alias("first"))
    label = named.join(first, "component").select("node", "first")
    out = sketched.select("doc_id", "n_shingles", "node").join(label, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
        F.when(F.col("first") < (1 << 63) - 1, F.col("first")))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def sql(size: int = 4, similar: tuple[int, int] = SIMILAR) -> str:
    """The same components in SQL, from all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {size} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {size - 2}), lambda i: array_to_string(words[i:i + {size - 1}], ' ')) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE {similar[1]} * c >= {similar[0]} * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a),
least_of AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM w JOIN least_of USING (doc_id) LEFT JOIN sizes USING (doc_id)"""
