"""The best documents for each item by weighted terms: branch and bound over trees of restricted term vectors.

Of every document only the terms that some item has are kept, with their counts (its restricted vector), the document's m and its id. They are
stored once per pass; document frequencies, N and L come from the same table. In a task, blocks of at most
``BLOCK_DOCUMENTS`` vectors become a tree: terms ordered by falling frequency, so that vectors share paths from the root; a chain with
one child is one node, and at most ``BUCKET`` documents (or equal vectors, however many) are a leaf. Every node knows the largest
tf of each term and the smallest m below it, which bound the score of all its documents, for every item at once as a product of
matrices. Each item then searches depth first, the child of the highest bound first, and leaves a node alone when its bound is
below the score of the item's last place. Places found in earlier blocks of the task carry on, and the places of all
tasks are ranked in two steps, so no task gets more than the places of a share of the others.

All numbers are integers; products of them are exact in doubles below 2^53, which ``BLOCK_TERMS`` and int64 sums keep.

Items are taken ``ITEMS_PER_PASS`` (or ``PASS_CHARACTERS``) at a time, one pass after another, and in a task ``ITEMS_PER_TREE`` (or
``TERMS_PER_TREE``) at a time, so neither the driver nor a task ever holds more. Rows of equal item_id and text are one item, of equal id and other text one item each. Documents
are ranked row by row, repeated rows too; equal scores by doc_id, null ids last. Null and empty texts have no terms; items without terms have
no rows. Texts are read whole. Empty tables give an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, id_text, map_batches, offsets_of, texts_of
from .components import stored

PLACES = 20
ITEMS_PER_PASS = 4096
ITEMS_PER_TREE = 256
TERMS_PER_TREE = 8192
PASS_CHARACTERS = 16 << 20
BLOCK_DOCUMENTS = 4096
BLOCK_TERMS = 1 << 20
BUCKET = 16
SHARES = 64

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM)
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text: str) -> list[str]:
    """Runs of digits, letters and non-ASCII characters; only A-Z are lower-cased."""
    # Only A-Z change in lower() of an ASCII text.
    return _TERM.findall(text.lower() if text.isascii() else text.translate(_LOWER))


@dataclass
class Queries:
    """Some items with numbers for their terms."""

    item_ids: list[int | None]
    counts: list[dict[int, int]]  # per item: term number, repeats
    terms: list[str]


def queries_of(rows: list[tuple[int | None, str]]) -> Queries:
    numbers: dict[str, int] = {}
    counts = [Counter(numbers.setdefault(t, len(numbers)) for t in terms_of(text)) for _, text in rows]
    return Queries([k for k, _ in rows], counts, list(numbers))


def passes(items: DataFrame, size: int = ITEMS_PER_PASS) -> Iterator[Queries]:
    """Different items, about ``size`` or ``PASS_CHARACTERS`` at a time."""
    rows = id_text(items, "item_id").where(F.length("text") > 0).distinct()
    count, characters = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    share = max(count / size, characters / PASS_CHARACTERS)
    if share <= 1:
        if count:
            yield queries_of([tuple(r) for r in rows.orderBy("doc_id", "text").collect()])
        return
    # Dealt by hash into passes of half the size on average, so that none is far above it.
    n = math.ceil(2 * share)
    dealt = stored(rows.withColumn("pass", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))), "items")
    for k in range(n):
        some = dealt.where(F.col("pass") == k).select("doc_id", "text").orderBy("doc_id", "text").collect()
        if some:
            yield queries_of([tuple(r) for r in some])


def vectors(docs: DataFrame, queries: Queries) -> DataFrame:
    """Restricted vector of every document: doc_id, n (all its terms with repeats), terms and tfs."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(queries.terms)})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        ns, lengths, terms, tfs = [], [], [], []
        for text in texts_of(batch.column("text")):
            found = terms_of(text)
            counted = Counter(map(known.get, found))
            counted.pop(None, None)
            ns.append(len(found))
            lengths.append(len(counted))
            terms += counted.keys()
            tfs += counted.values()
        at = pa.array(offsets_of(np.array(lengths, np.int64)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
             pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    return map_batches(id_text(docs), run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


# --- the tree -------------------------------------------------------------------------------


@dataclass
class Block:
    """Vectors of some documents, sorted; term numbers in order of falling frequency."""

    doc_ids: np.ndarray
    missing: np.ndarray  # documents without an id
    m: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    tfs: np.ndarray


def shares_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count is worth, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def sorted_block(doc_ids, missing, m, at, terms, tfs) -> Block:
    """Documents in the order of their vectors, terms within one ascending."""
    n = len(m)
    owner = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((terms, owner))
    terms, tfs = terms[order], tfs[order]
    big = terms.astype(">u4")
    by = sorted(range(n), key=lambda k: big[at[k]:at[k + 1]].tobytes())
    by = np.array(by, np.int64)
    lengths = np.diff(at)[by]
    new_at = offsets_of(lengths)
    places = np.repeat(at[by] - new_at[:-1], lengths) + np.arange(len(terms))
    return Block(doc_ids[by], missing[by], m[by], new_at, terms[places], tfs[places])


@dataclass
class Node:
    first: int
    last: int  # documents first .. last - 1
    children: list[int] = field(default_factory=list)


def tree_of(block: Block, bucket: int = BUCKET) -> list[Node]:
    """Nodes of the radix tree over the sorted vectors, parents before children; node 0 is the root."""
    at, terms = block.at.tolist(), block.terms
    nodes = [Node(0, len(at) - 1)]
    waiting = [0]
    while waiting:
        k = waiting.pop()
        first, last = nodes[k].first, nodes[k].last
        if last - first <= bucket:
            continue
        # What the first and the last share, all between share.
        a, b = terms[at[first]:at[first + 1]], terms[at[last - 1]:at[last]]
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[:short] != b[:short])
        depth = int(differ[0]) if len(differ) else short
        lengths = block.at[first + 1:last + 1] - block.at[first:last]
        longer = lengths > depth
        if not longer.any():
            continue  # equal vectors
        step = np.where(longer, terms[np.minimum(block.at[first:last] + depth, len(terms) - 1)], -1)
        borders = np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, [last - first]])
        # Neighbouring branches that fit into one bucket make up one leaf.
        cuts = [0]
        for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist()):
            if hi - cuts[-1] > bucket and lo > cuts[-1]:
                cuts.append(lo)
        cuts.append(last - first)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            nodes[k].children.append(len(nodes))
            if hi - lo > bucket:
                waiting.append(len(nodes))
            nodes.append(Node(first + lo, first + hi))
    return nodes


def bounds_of(block: Block, nodes: list[Node], weights: np.ndarray) -> np.ndarray:
    """(nodes, items): no document below a node scores more. ``weights`` are (terms, items)."""
    width = len(weights)
    worth = np.zeros((len(nodes), width))
    least = np.zeros(len(nodes), np.int64)
    most = np.zeros((len(nodes), width), np.int32)
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        if node.children:
            most[k] = most[node.children].max(axis=0)
            least[k] = least[node.children].min()
        else:
            own = slice(block.at[node.first], block.at[node.last])
            np.maximum.at(most[k], block.terms[own], block.tfs[own])
            least[k] = block.m[node.first:node.last].min()
    rows, columns = np.nonzero(most)
    worth[rows, columns] = shares_of(most[rows, columns].astype(np.int64), least[rows])
    return worth @ weights


class Places:
    """The best (score, doc_id) of an item so far; a null id comes last among equal scores."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.rows: list[tuple[int, bool, int]] = []  # (-score, no id, id), ascending

    def least(self) -> int:
        """A score below this has no place."""
        return -self.rows[-1][0] if len(self.rows) == self.most else 1

    def add(self, scores: np.ndarray, missing: np.ndarray, doc_ids: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.least())
        if len(good) > self.most:
            good = good[np.lexsort((doc_ids[good], missing[good], -scores[good]))[:self.most]]
        if len(good):
            new = zip((-scores[good]).tolist(), missing[good].tolist(), doc_ids[good].tolist())
            self.rows = sorted([*self.rows, *new])[:self.most]


def search(block: Block, items: list[int], weights: np.ndarray, places: list[Places], bucket: int = BUCKET) -> int:
    """Put the block's documents into the places of the items (columns of ``weights``); the number of leaves scored."""
    nodes = tree_of(block, bucket)
    bounds = bounds_of(block, nodes, weights)
    lengths = np.diff(block.at)
    value = shares_of(block.tfs.astype(np.int64), np.repeat(block.m, lengths))
    scored = 0
    for column, item in enumerate(items):
        own, bound, best = weights[:, column], bounds[:, column], places[item]
        stack = [0]
        while stack:
            k = stack.pop()
            if bound[k] < best.least():
                continue
            node = nodes[k]
            if node.children:
                # The last of the stack is next.
                stack += sorted(node.children, key=bound.__getitem__)
                continue
            scored += 1
            a, b = block.at[node.first], block.at[node.last]
            gains = np.concatenate([[0], np.cumsum(value[a:b] * own[block.terms[a:b]].astype(np.int64))])
            at = block.at[node.first:node.last + 1] - a
            best.add(gains[at[1:]] - gains[at[:-1]], block.missing[node.first:node.last], block.doc_ids[node.first:node.last])
    return scored


@dataclass
class Group:
    """Items that share a tree: their numbers, the order of their terms and the weights (terms, items)."""

    items: list[int]
    number: np.ndarray  # of a term of the pass in this group's order, or -1
    entries: np.ndarray  # (term, column, weight) of all that are not zero

    def weights(self) -> np.ndarray:
        out = np.zeros((int(self.number.max()) + 1, len(self.items)))
        out[self.entries[:, 0], self.entries[:, 1]] = self.entries[:, 2]
        return out


def groups_of(queries: Queries, weights: np.ndarray, df: np.ndarray, size: int = ITEMS_PER_TREE,
              terms: int = TERMS_PER_TREE) -> list[Group]:
    """Runs of at most ``size`` items with about ``terms`` different terms, or one item."""
    runs: list[tuple[list[int], set[int]]] = []
    for i, counts in enumerate(queries.counts):
        if not counts:
            continue
        if not runs or len(runs[-1][0]) == size or len(runs[-1][1] | counts.keys()) > terms:
            runs.append(([], set()))
        runs[-1][0].append(i)
        runs[-1][1].update(counts)
    out = []
    for items, held in runs:
        used = np.array(sorted(held, key=lambda t: (-df[t], t)), np.int64)
        number = np.full(len(queries.terms), -1, np.int64)
        number[used] = np.arange(len(used))
        entries = [(number[t], column, repeats * weights[t]) for column, i in enumerate(items)
                   for t, repeats in queries.counts[i].items()]
        out.append(Group(items, number, np.array(entries, np.int64)))
    return out


def restricted(group: Group, doc_ids, missing, m, at, terms, tfs) -> Block:
    """The vectors in the group's terms; documents without any are left out, as they score nothing."""
    number = group.number[terms]
    keep = number >= 0
    kept_at = np.concatenate([[0], np.cumsum(keep)])[at]
    some = np.diff(kept_at) > 0
    return sorted_block(
        doc_ids[some], missing[some], m[some], np.append(kept_at[:-1][some], kept_at[-1]), number[keep], tfs[keep])


def best_of_tasks(rows: DataFrame, queries: Queries, weights: np.ndarray, df: np.ndarray, n_docs: int, n_terms: int,
                  most: int = PLACES) -> DataFrame:
    """(item, doc_id, score): the places of every task, from stored ``vectors``."""
    spark = rows.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((groups_of(queries, weights, df), len(queries.item_ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, n_items = shared.value
        places = [Places(most) for _ in range(n_items)]

        def work(some: list[pa.RecordBatch]) -> None:
            doc_ids = pa.concat_arrays([b.column("doc_id") for b in some])
            missing = doc_ids.is_null().to_numpy(zero_copy_only=False)
            n = np.concatenate([b.column("n").to_numpy() for b in some])
            lists = {name: pa.concat_arrays([b.column(name) for b in some]) for name in ("terms", "tfs")}
            at = offsets_of(lists["terms"].value_lengths().to_numpy().astype(np.int64))
            terms, tfs = (x.flatten().to_numpy() for x in lists.values())
            m = 75 + (25 * n * n_docs) // n_terms
            for group in groups:
                block = restricted(group, doc_ids.fill_null(0).to_numpy(), missing, m, at, terms, tfs)
                if len(block.m):
                    search(block, group.items, group.weights(), places)

        waiting: list[pa.RecordBatch] = []
        documents = terms = 0
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_DOCUMENTS):
                part = batch.slice(first, BLOCK_DOCUMENTS)
                own = len(part.column("terms").flatten())
                if waiting and (documents + part.num_rows > BLOCK_DOCUMENTS or terms + own > BLOCK_TERMS):
                    work(waiting)
                    waiting, documents, terms = [], 0, 0
                waiting.append(part)
                documents, terms = documents + part.num_rows, terms + own
        if waiting:
            work(waiting)
        for i, best in enumerate(places):
            if best.rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(best.rows), pa.int32()), pa.array([None if none else k for _, none, k in best.rows], pa.int64()),
                     pa.array([-s for s, _, _ in best.rows], pa.int64())], names=["item", "doc_id", "score"])

    # Documents without a term of any item score nothing.
    return rows.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(
        run, "item int, doc_id bigint, score bigint")


def ranked(places: DataFrame, most: int = PLACES) -> DataFrame:
    """The best places of every item, ranked in shares first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    share = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SHARES))
    first = places.withColumn("share", share).withColumn(
        "rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).where(F.col("rank") <= most)
    return first.drop("share").withColumn(
        "rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)


def statistics(rows: DataFrame, n_query_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L, and the document frequency of each term."""
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_query_terms, np.int64)
    counts = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # terms of one pass at most
    df[counts.column("term").to_numpy()] = counts.column("count").to_numpy()
    return n_docs, n_terms, df


def rank(docs: DataFrame, items: DataFrame, most: int = PLACES, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """item_id, rank, doc_id, score of the best documents of each item."""
    spark = docs.sparkSession
    out = []
    for queries in passes(items, items_per_pass):
        if not queries.terms:
            continue
        rows = stored(vectors(docs, queries), "vectors")
        n_docs, n_terms, df = statistics(rows, len(queries.terms))
        if not n_docs:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        places = ranked(best_of_tasks(rows, queries, weights, df, n_docs, n_terms, most), most)
        names = spark.createDataFrame(list(enumerate(queries.item_ids)), "item int, item_id bigint")
        out.append(stored(places.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "places"))
    if not out:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, out)


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS repeats FROM q GROUP BY ALL),
totals AS (SELECT count(*) FILTER (len(words) > 0) AS nn, sum(len(words)) AS ll FROM d),
held AS (SELECT doc_id, len(words) AS n, term, count(*) AS tf FROM (SELECT doc_id, words, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM held JOIN weights USING (term) JOIN asked USING (term), totals GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
