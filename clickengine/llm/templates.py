"""Line dedup with a fixed-depth tree of line templates.

A line (between \n) goes down the tree by its number of tokens and its first ``LEADING`` tokens, where tokens with digits count as
the variable ``<*>``. In a leaf, a token is constant at its place if at least ``MIN_DOCUMENTS`` documents (two for lines of ``LONG``
tokens) hold it there, whatever their lines are otherwise; the other places of a line are variable. A line's template is its constant
tokens, if they are ``SIMILARITY`` of its places, else the line itself. So lines of one template are equal in that share of
their places, each with each. Lines of fewer than five tokens have no place to vary. Tokens are compared by 64 bits. Leaves
are tables of (leaf, place, token), counted and joined like any other, so that no leaf has to fit a task and its size changes nothing.

A template recurs when at least ``MIN_DOCUMENTS`` documents (two for lines of ``LONG`` tokens, which chance does not
repeat) hold it that are no copies. A document is a copy, a matter of document dedup, when it has other lines and one
and the same other document holds them too, at least ``COPY_SHARE`` of their tokens (sought among the documents
that are first or last, by their hash, to hold a line) or each in its place. Copies neither count nor lose lines; a
document with no other lines counts. Of a recurring template the first line (smallest
doc_id, then place) stays, all others are dropped.

Null and empty texts have no lines to drop. Rows with equal id and text count as one document and are treated alike.
Null ids come last. Texts of any length are read whole, line by line. Ties are broken by smallest number. An empty table
gives an empty result; all columns are kept, ``text`` is rewritten (null stays null).
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach, attach_stored
from .common import map_batches, texts_of, unused
from .components import stored

LEADING = 3
SIMILARITY = 0.8
MIN_DOCUMENTS = 3
LONG = 50
COPY_SHARE = 0.8  # as near-duplicates

_VARIABLE = re.compile(rb"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_LAST = (1 << 63) - 1
# Lines to parse again are broadcast up to this many, else joined to their documents.
BROADCAST_LINES = 500_000


def _hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def document_key() -> Column:
    """Tells documents apart that share an id but not the text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text"))


def can_vary(tokens: int) -> bool:
    """Whether a line of so many tokens may differ in one and still be of the same template."""
    return math.ceil(SIMILARITY * tokens - 1e-9) < tokens


def _tokens(line: bytes) -> list[bytes]:
    return _VARIABLE.sub(b"<*>", line).split()


def parsed_lines(docs: DataFrame) -> DataFrame:
    """A row per line with a token: doc, key, line_no, tokens, leaf (null where nothing can vary), line."""
    rows = docs.select(
        document_key().alias("doc"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("key"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc, key, text in zip(batch.column("doc").to_pylist(), batch.column("key").to_pylist(),
                                  texts_of(batch.column("text"))):
            for no, line in enumerate(text.encode("utf-8", "replace").split(b"\n")):
                tokens = _tokens(line)
                n = len(tokens)
                if n:
                    leaf = _hash(b"%d " % n + b" ".join(tokens[:LEADING])) if can_vary(n) else None
                    out.append((doc, key, no, n, leaf, _hash(b" ".join(tokens))))
        columns = zip(*out) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc", "key", "line_no", "tokens", "leaf", "line"])

    return map_batches(rows, run, "doc bigint, key bigint, line_no int, tokens int, leaf bigint, line bigint")


def needed(tokens: Column | str) -> Column:
    """Documents that make a token constant, or a template recurrent, in lines of so many tokens."""
    return F.when((F.col(tokens) if isinstance(tokens, str) else tokens) >= LONG, 2).otherwise(MIN_DOCUMENTS)


def leaf_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(leaf, line, holders, places) of the different lines of leaves that have several and enough of them: how many documents
    hold the line, and its tokens behind the leading ones."""
    leaves = lines.where(F.col("leaf").isNotNull()).groupBy("leaf").agg(
        F.min("line").alias("a"), F.max("line").alias("b"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("tokens"))
    # With fewer lines than that, no token of the leaf is constant.
    shared = stored(leaves.where((F.col("a") < F.col("b")) & (F.col("n") >= needed("tokens"))).select("leaf", "n"), "leaves")
    rows = attach_stored(lines.select("doc", "line_no", "leaf", "line"), shared.select("leaf"), ["leaf"], ["doc", "line_no"], "inner",
                         counts=shared)
    # Any holder will do to read the line's tokens from.
    one = stored(rows.groupBy("leaf", "line").agg(
        F.count_distinct("doc").alias("holders"), F.min(F.struct("doc", "line_no")).alias("at")), "different")
    wanted = one.groupBy(F.col("at.doc").alias("doc")).agg(
        F.collect_list(F.struct("at.line_no", "leaf", "line", "holders")).alias("wanted"))
    if one.count() <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    found = docs.select(document_key().alias("doc"), "text").join(wanted, "doc").select("text", "wanted")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for text, some in zip(texts_of(batch.column("text")), batch.column("wanted").to_pylist()):
            own = text.encode("utf-8", "replace").split(b"\n")
            out += [(w["leaf"], w["line"], w["holders"], [_hash(t) for t in _tokens(own[w["line_no"]])[LEADING:]]) for w in some]
        columns = zip(*out) if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=["leaf", "line", "holders", "places"])

    read = map_batches(found, run, "leaf bigint, line bigint, holders bigint, places array<bigint>")
    # Repeated rows of a document give its lines several times.
    return read.dropDuplicates(["leaf", "line"])


def templates_of(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, template) for the lines that have a template of constant tokens; all others are their own."""
    cells = stored(leaf_lines(docs, lines).select(
        "leaf", "line", "holders", F.size("places").alias("rest"), F.posexplode("places").alias("place", "token")), "cells")
    held = cells.groupBy("leaf", "place", "token").agg(
        F.sum("holders").alias("documents"), F.max("rest").alias("rest"), F.count(F.lit(1)).alias("n"))
    constant = stored(held.where(F.col("documents") >= needed(F.col("rest") + LEADING)).select("leaf", "place", "token", "n"), "constant")
    kept = attach(cells, constant.drop("n"), ["leaf", "place", "token"], ["line"], "inner", counts=constant)
    shapes = kept.groupBy("leaf", "line").agg(
        F.max("rest").alias("rest"), F.count(F.lit(1)).alias("constants"), F.bit_xor(F.xxhash64("place", "token")).alias("shape"))
    alike = F.col("constants") + LEADING >= SIMILARITY * (F.col("rest") + LEADING) - 1e-9
    return shapes.where(alike).select("line", F.xxhash64("leaf", "constants", "shape").alias("template"))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(doc, line_no) of the lines to drop."""
    lines = stored(parsed_lines(docs), "lines")
    named = stored(templates_of(docs, lines), "named")
    rows = attach_stored(lines.select("doc", "key", "line_no", "tokens", "line"), named, ["line"], ["doc", "line_no"]).select(
        "doc", "key", "line_no", "tokens", F.coalesce("template", "line").alias("template"))
    rows = stored(rows, "templates")
    # Only templates of several documents are of interest from here on.
    spread = rows.groupBy("template").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where(
        F.col("a") != F.col("b"))
    shared = stored(rows.join(spread, "template"), "shared")
    # The same for any number of repeated rows.
    line = F.xxhash64("template", "line_no")
    total = F.floor(F.sum(F.shiftright(line, 32)) / F.count(line))
    totals = stored(rows.groupBy("doc").agg(
        F.sum("tokens").alias("all"), F.xxhash64(F.min(line), F.max(line), total).alias("digest")), "totals")
    twins = totals.groupBy("digest").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where(
        F.col("a") != F.col("b")).select("digest", F.lit(True).alias("twin"))
    partners = shared.select("doc", "tokens", F.explode(F.array("a", "b")).alias("partner")).where(
        F.col("doc") != F.col("partner")).groupBy("doc", "partner").agg(F.sum("tokens").alias("common"))
    partners = partners.groupBy("doc").agg(F.max(F.struct("common", "partner")).alias("most")).select("doc", "most.*")
    facts = partners.join(totals, "doc").join(twins, "digest", "left").drop("digest")
    held = shared.groupBy("doc", "template").agg(
        F.sum("tokens").alias("own"), F.max("tokens").alias("length"),
        F.min(F.struct("key", "doc", "line_no")).alias("first"), F.min("a").alias("a"), F.min("b").alias("b"))
    # Repeated rows count their tokens several times over on both sides of the ratio.
    others = F.col("all") - F.col("own")
    common = F.col("common") - F.when(F.col("partner").isin(F.col("a"), F.col("b")), F.col("own")).otherwise(0)
    held = held.join(facts, "doc").withColumn("free", (others == 0) | (
        F.col("twin").isNull() & (common < COPY_SHARE * others - 1e-9)))
    recurring = held.groupBy("template").agg(
        F.count(F.when(F.col("free"), 1)).alias("n"), F.max("length").alias("length"), F.min("first").alias("first")
    ).where(F.col("n") >= needed("length"))
    losing = held.where("free").select("doc", "template").join(recurring.select("template", "first"), "template")
    return shared.select("doc", "key", "line_no", "template").join(losing, ["doc", "template"]).where(
        F.struct("key", "doc", "line_no") != F.col("first")).select("doc", "line_no")


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without recurring lines, and with ``n_lines`` and ``n_dropped``."""
    doc, dropped = unused(docs, "__doc"), unused(docs, "__drops")
    drops = recurring_lines(docs).groupBy("doc").agg(F.collect_set("line_no").alias(dropped))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], document_key().alias(doc))
    joined = keyed.join(drops.withColumnRenamed("doc", doc), doc, "left")
    lines = F.split("text", "\n")
    gone = F.coalesce(dropped, F.array().cast("array<int>"))
    kept = F.filter(lines, lambda x, i: ~F.array_contains(gone, i))
    columns = {c: F.col(f"`{c}`") for c in names}
    columns["text"] = F.when(F.col(dropped).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[c.alias(n) for n, c in columns.items()],
        F.when(F.length("text") > 0, F.size(lines)).otherwise(0).cast("bigint").alias("n_lines"),
        F.size(gone).cast("bigint").alias("n_dropped"),
    )
