"""Which tokens of two tokenizers overlap, by products of sparse incidence matrices.

A text is encoded by a byte-level vocabulary (A, a space before the text) and by a sentencepiece model (B, which adds the
space itself). Both cut the same bytes, so tokens and bytes form two incidence matrices in compressed rows (``Csr``).
``product`` multiplies such matrices row by row (Gustavson): A x bytes times the transpose of B x bytes has an entry for every
pair of overlapping tokens, the number of bytes they share. Offsets where tokens of both end cut the tokens into groups; the
product of the group incidences has an entry for every pair of one group. Its rows are counted first and worked out in
blocks of at most ``LINKS_AT_ONCE`` entries, since a group can be as long as its text.

``align`` gives tokens, groups and the different linked id pairs of every text. ``with_pair_counts`` adds up the links of every
id pair over all texts. At most ``HELD`` pairs, those of highest counts, are looked up where the texts are; all others
are joined by pair, so no frequent pair is ever a join key.

Null and empty texts, and those which tokens of either side do not spell byte for byte (such as a text with U+2581), have no
tokens: zeros and an empty string. Control strings inside texts are plain text. Texts are read whole, a few megabytes at a time. Repeated
rows, equal and null ids are counted row by row. An empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_batches, offsets_of, spread_rows, texts_of
from .components import stored

CHUNK_BYTES = 1 << 20
LINKS_AT_ONCE = 1 << 22
HELD = 1 << 20


# --- sparse matrices ------------------------------------------------------------------------


@dataclass
class Csr:
    """Rows of column numbers, ascending within a row; every entry is 1."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.starts) - 1

    def transpose(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        row_of = np.repeat(np.arange(self.rows), np.diff(self.starts))
        return Csr(offsets_of(np.bincount(self.columns, minlength=self.width)), row_of[order], self.rows)

    def slice(self, first: int, last: int) -> Csr:
        a, b = self.starts[first], self.starts[last]
        return Csr(self.starts[first:last + 1] - a, self.columns[a:b], self.width)


def row_work(left: Csr, right: Csr) -> np.ndarray:
    """How many entries of ``right`` each row of the product gathers."""
    gathered = np.concatenate([[0], np.cumsum(np.diff(right.starts)[left.columns])])
    return gathered[left.starts[1:]] - gathered[left.starts[:-1]]


def product(left: Csr, right: Csr) -> tuple[Csr, np.ndarray]:
    """``left`` times ``right`` and its values: a row gathers the rows of ``right`` its columns name, equal columns added up."""
    lengths = np.diff(right.starts)[left.columns]
    columns = right.columns[spread_rows(right.starts[left.columns], lengths)]
    row_of = np.repeat(np.arange(left.rows), row_work(left, right))
    key = row_of * right.width + columns
    if np.any(key[1:] < key[:-1]):
        key = np.sort(key)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    values = np.diff(np.append(first, len(key)))
    key = key[first]
    rows = key // max(right.width, 1)
    return Csr(np.searchsorted(rows, np.arange(left.rows + 1)), key - rows * right.width, right.width), values


def product_blocks(left: Csr, right: Csr, at_once: int = LINKS_AT_ONCE):
    """(first row, product of some rows) so that each gathers at most ``at_once`` entries, or is one row."""
    done = np.cumsum(row_work(left, right))
    first = 0
    while first < left.rows:
        before = done[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(done, before + at_once, side="right")))
        yield first, product(left.slice(first, last), right)
        first = last


# --- the tokenizers -------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {**{chr(b): b for b in visible}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        letters = byte_letters()
        with open(byte_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = [model["vocab"][a + b] for a, b in merges]
        if ranks != sorted(ranks):
            raise ValueError("the ids of a byte-level vocabulary have to follow its merges")
        special = max(ranks, default=255) + 1
        spelt = {bytes(letters[c] for c in token): k for token, k in model["vocab"].items() if k < special}
        self.a = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=spelt, special_tokens={})
        self.a_bytes = [b""] * special
        for token, k in spelt.items():
            self.a_bytes[k] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
            for k, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none for texts that either side does not spell."""
        a = [self.a.encode_ordinary(" " + t) if t else [] for t in texts]
        b = self.b.encode(texts, num_threads=1) if texts else []
        for k, t in enumerate(texts):
            want = (" " + t).encode()
            if not t or b"".join(map(self.a_bytes.__getitem__, a[k])) != want or \
                    b"".join(map(self.b_bytes.__getitem__, b[k])) != want:
                a[k], b[k] = [], []
        return a, b


@lru_cache(maxsize=2)
def pair(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


# --- texts ----------------------------------------------------------------------------------


@dataclass
class Aligned:
    """Tokens of some texts, one text after another, with their groups and links."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_at: np.ndarray  # first token of each text, and the end
    b_at: np.ndarray
    a_groups: Csr  # token x group
    b_groups: Csr
    links: Csr  # A token x B token
    shared: np.ndarray  # bytes of each link


def aligned(tokenizers: Pair, texts: list[str]) -> Aligned:
    a, b = tokenizers.encode(texts)
    a_at, b_at = (offsets_of(np.array([len(t) for t in side], np.int64)) for side in (a, b))
    a_ids, b_ids = (np.fromiter((k for t in side for k in t), np.int64, int(at[-1])) for side, at in ((a, a_at), (b, b_at)))
    del a, b
    a_ends, b_ends = offsets_of(tokenizers.a_sizes[a_ids]), offsets_of(tokenizers.b_sizes[b_ids])
    size = int(a_ends[-1])
    a_bytes, b_bytes = Csr(a_ends, np.arange(size), size), Csr(b_ends, np.arange(size), size)
    links, shared = product(a_bytes, b_bytes.transpose())
    ends = np.zeros(size + 1, np.int8)
    ends[a_ends[1:]] += 1
    ends[b_ends[1:]] += 1
    groups_before = np.cumsum(ends == 2)
    n = int(groups_before[-1]) if size else 0
    a_groups = Csr(np.arange(len(a_ids) + 1), groups_before[a_ends[:-1]], n)
    b_groups = Csr(np.arange(len(b_ids) + 1), groups_before[b_ends[:-1]], n)
    return Aligned(a_ids, b_ids, a_at, b_at, a_groups, b_groups, links, shared)


@lru_cache(maxsize=4)
def _digits(limit: int) -> np.ndarray:
    width = len(str(limit - 1))
    return np.array([str(k) for k in range(limit)], f"S{width}").view(np.uint8).reshape(limit, width)


def decimal_digits(limit: int) -> np.ndarray:
    """Digits of the numbers below ``limit`` or a bit more, padded with zero bytes."""
    return _digits(1 << max(limit - 1, 1).bit_length())


def group_texts(found: Aligned) -> tuple[pa.Array, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of each text, and its number of groups."""
    a_first, b_first = found.a_groups.transpose().starts, found.b_groups.transpose().starts
    a_group, b_group = found.a_groups.columns, found.b_groups.columns
    n = len(a_group) + len(b_group)
    # Tokens by group, those of A before those of B, each as its digits and what follows them.
    a_place = np.arange(len(a_group)) + b_first[a_group]
    b_place = np.arange(len(b_group)) + a_first[b_group + 1]
    ids = np.empty(n, np.int64)
    ids[a_place], ids[b_place] = found.a_ids, found.b_ids
    after = np.full(n, ord(","), np.uint8)
    after[a_place[a_first[1:] - 1]] = ord("|")
    after[b_place[b_first[1:] - 1]] = ord(";")
    at = found.a_at + found.b_at
    after[at[1:][np.diff(at) > 0] - 1] = 0
    table = decimal_digits(int(ids.max(initial=0)) + 1)
    digits = table.shape[1]
    letters = np.empty((n, digits + 1), np.uint8)
    letters[:, :digits] = table[ids]
    letters[:, digits] = after
    used = letters > 0
    ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[at]
    texts = pa.StringArray.from_buffers(
        len(at) - 1, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(letters[used].tobytes()))
    return texts, np.diff(np.searchsorted(a_first, found.a_at))


def chunks(texts: list[str], most: int = CHUNK_BYTES):
    """Runs of texts of about ``most`` characters, or of one text."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > most:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def id_pairs(found: Aligned, b_vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First pair of each text (and the end), its different id pairs (as a * vocabulary + b) and their links."""
    a_token = np.repeat(np.arange(found.links.rows), np.diff(found.links.starts))
    text = np.searchsorted(found.a_at[1:], a_token, side="right")
    key = found.a_ids[a_token] * b_vocabulary + found.b_ids[found.links.columns]
    order = np.lexsort((key, text)) if len(found.a_at) > 2 else np.argsort(key)
    key, text = key[order], text[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (text[1:] != text[:-1])]))
    return (np.searchsorted(text[first], np.arange(len(found.a_at))), key[first],
            np.diff(np.append(first, len(key))))


SCHEMA = ("row bigint, doc_id bigint, a_ids array<int>, b_ids array<int>, groups string, n_groups bigint, n_links bigint, "
          "n_group_links bigint, pairs array<struct<pair: bigint, n: int>>")


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per text: ids of both sides, groups as text, numbers of groups and links, different linked id pairs and how often."""
    rows = id_text(docs).withColumn("row", F.monotonically_increasing_id())
    pair_type = pa.struct([("pair", pa.int64()), ("n", pa.int32())])

    def listed(values: pa.Array, at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizers = pair(byte_path, piece_path)
        parts: list[list] = [[] for _ in range(7)]
        for some in chunks(texts_of(batch.column("text"))):
            found = aligned(tokenizers, some)
            groups, n_groups = group_texts(found)
            in_group = np.concatenate([[0], np.cumsum(row_work(found.a_groups, found.b_groups.transpose()))])[found.a_at]
            at, key, n = id_pairs(found, len(tokenizers.b_bytes))
            values = (
                listed(pa.array(found.a_ids, pa.int32()), found.a_at), listed(pa.array(found.b_ids, pa.int32()), found.b_at),
                groups, pa.array(n_groups, pa.int64()),
                pa.array(np.diff(found.links.starts[found.a_at]), pa.int64()), pa.array(np.diff(in_group), pa.int64()),
                listed(pa.StructArray.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int32())], fields=list(pair_type)), at))
            for part, value in zip(parts, values):
                part.append(value)
        columns = [pa.concat_arrays(part) for part in parts]
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), *columns],
            names=["row", "doc_id", "a_ids", "b_ids", "groups", "n_groups", "n_links", "n_group_links", "pairs"])

    return map_batches(rows, run, SCHEMA)


def links_of(tokenizers: Pair, text: str, same_group: bool = False):
    """(A token, B token, n) arrays of one text, block by block: shared bytes of overlapping tokens, or 1 for tokens of one group."""
    found = aligned(tokenizers, [text])
    if not same_group:
        yield np.repeat(np.arange(found.links.rows), np.diff(found.links.starts)), found.links.columns, found.shared
        return
    for first, (block, n) in product_blocks(found.a_groups, found.b_groups.transpose()):
        yield first + np.repeat(np.arange(block.rows), np.diff(block.starts)), block.columns, n


# --- all texts ------------------------------------------------------------------------------


def _level():
    """Eighths of a doubling of the count."""
    return F.floor(F.log2(F.col("n")) * 8).cast("int")


def held_level(counts: DataFrame, most: int) -> int:
    """The lowest level of counts from which on there are at most ``most`` pairs."""
    found, lowest = 0, 8 * 64
    levels = counts.groupBy(_level().alias("level")).count().collect()  # a few hundred, whatever the counts
    for r in sorted(levels, key=lambda r: -r["level"]):
        found += r["count"]
        if found > most:
            break
        lowest = r["level"]
    return lowest


def pair_counts(texts: DataFrame, vocabulary: int) -> DataFrame:
    """(pair, n, best): the links of each id pair over all texts, and whether no other pair of its B id has more."""
    counts = stored(texts.select(F.inline("pairs")).groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy(F.pmod("pair", F.lit(vocabulary)).alias("b")).agg(F.max("n").alias("most"))
    keyed = counts.withColumn("b", F.pmod("pair", F.lit(vocabulary)))
    return keyed.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_pair_counts(texts: DataFrame, vocabulary: int, held: int = HELD) -> DataFrame:
    """``texts`` (stored rows of ``align``) with n_best and count_sum in place of their pairs."""
    spark = texts.sparkSession
    counts = stored(pair_counts(texts, vocabulary), "counts")
    high = counts.where(_level() >= held_level(counts, held)).toArrow()  # ``held`` rows at most
    key = high.column("pair").to_numpy()
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((
        key[order], high.column("n").to_numpy()[order], high.column("best").to_numpy()[order]))
    del high, key, order
    pair_type = pa.struct([("pair", pa.int64()), ("n", pa.int32())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, total, best = shared.value
        lists = batch.column("pairs")
        at = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(at[0], at[-1] - at[0])
        at = at - at[0]
        key, n = flat.field("pair").to_numpy(), flat.field("n").to_numpy().astype(np.int64)
        place = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
        hit = known[place] == key if len(known) else np.zeros(len(key), bool)
        sums = []
        for value in ((best, total) if len(known) else (np.zeros(1, bool), np.zeros(1, np.int64))):
            running = np.concatenate([[0], np.cumsum(np.where(hit, n * value[place], 0))])
            sums.append(running[at[1:]] - running[at[:-1]])
        rest_at = np.concatenate([[0], np.cumsum(~hit)])[at]
        rest = pa.StructArray.from_arrays([pa.array(key[~hit], pa.int64()), pa.array(n[~hit], pa.int32())], fields=list(pair_type))
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()),
             pa.ListArray.from_arrays(pa.array(rest_at, pa.int32()), rest)], names=["row", "n_best", "count_sum", "rest"])

    looked_up = stored(map_batches(
        texts.select("row", "pairs"), run,
        "row bigint, n_best bigint, count_sum bigint, rest array<struct<pair: bigint, n: int>>"), "found")
    low = looked_up.select("row", F.inline("rest").alias("pair", "k")).join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("low_best"), F.sum(F.col("k") * F.col("n")).alias("low_sum"))
    sums = looked_up.join(low, "row", "left").select(
        "row", (F.col("n_best") + F.coalesce("low_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("low_sum", F.lit(0))).alias("count_sum"))
    return texts.drop("pairs").join(sums, "row")


def digests(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row per text with its token, group and link counts and the digest of its groups."""
    vocabulary = len(pair(byte_path, piece_path).b_bytes)
    texts = stored(align(docs, byte_path, piece_path).select(
        "row", "doc_id", F.size("a_ids").cast("bigint").alias("n_a"), F.size("b_ids").cast("bigint").alias("n_b"), "n_groups",
        "n_links", "n_group_links",
        F.when(F.size("a_ids") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "pairs"), "aligned")
    return with_pair_counts(texts, vocabulary).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")
