"""Language-model scores by prediction by partial matching, beside a smoothed unigram base.

A trie of byte contexts up to ``order`` bytes (2 or 3) is counted over the training documents. The probability of a byte is found from the longest context down: a symbol seen
in a context with T occurrences of D different symbols has count / (T + D), else an escape costs
D / (T + D) and the next shorter context is used without the symbols of the longer one; after
the empty context, the bytes never seen share the rest evenly. Since a context's symbols are also symbols of
each shorter one, exclusion only subtracts: the counts left in the shorter context are T less the
counts it gives the excluded symbols. The finished trie thus gives each n-gram one code length, and a text's is the
sum over its bytes. A text starts after ``order`` zero bytes and ends without a symbol of its own.

Contexts of up to ``ORDER`` (2) bytes are a dense array of 256 ** 3 code lengths in every task. Contexts of three bytes are a
shuffled table of (context, symbol) counts that grows with the corpus. Of the most frequent ones, ``CELLS`` code lengths at
most are known to every task; the symbols that follow any other context seen in training go through a join
with the table and come back as a sum per document. What a task is sent does not depend on the corpus.

Word counts grow with the corpus and are never held whole by one task or the driver. The most frequent words, ``HOT`` at most, are
known to every task; all other words of a text go through a join with the table of counts and
come back as a sum per document.

Null and empty texts have one token, the end, and a model score of 0. Texts are read whole; repeated
rows, also of one doc_id, are learned from and scored each. Null ids count as not held out. An empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, id_text, map_batches, offsets_of, texts_of
from .components import stored

ORDER = 2
HOT = 1 << 18
# Code lengths after three bytes that every task knows.
CELLS = 1 << 24
# Words that a task gathers before it sends their counts on.
GATHER = 200_000
# Bytes whose n-grams are looked at together.
CHUNK = 1 << 20
# Different n-grams that a task gathers before it sends their counts on.
GATHER_GRAMS = 1 << 21


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _bytes_of(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def gram_codes(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The last ``order`` + 1 bytes up to each byte of each text as a number, and the texts' lengths."""
    pad = b"\0" * order
    lengths = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(pad.join([b"", *texts]), np.uint8)
    if not lengths.sum():
        return np.zeros(0, np.uint32), lengths
    raw = raw.astype(np.uint32)
    codes = raw[order:].copy()
    for k in range(1, order + 1):
        codes |= raw[order - k:len(raw) - k] << 8 * k
    keep = np.ones(len(raw), bool)
    starts = offsets_of(lengths + order)[:-1]
    for k in range(order):
        keep[starts + k] = False
    return codes[keep[order:]], lengths


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, some at a time."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def trie_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(word, gram, n): counts of the words and the n-grams of the rows that are not held out."""
    bound_batches(docs.sparkSession)

    def words_batch(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())],
            names=["word", "gram", "n"])

    def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        codes = np.concatenate([c for c, _ in found])
        by = np.argsort(codes, kind="stable")
        codes = codes[by]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return [(codes[first], np.add.reduceat(np.concatenate([n for _, n in found])[by], first))]

    def gram_batches(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for seen, n in found:
            for at in range(0, len(seen), 1 << 16):
                part = seen[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(part), pa.binary()), pa.array(part.astype(np.int64)), pa.array(n[at:at + (1 << 16)], pa.int64())],
                    names=["word", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            texts = [_bytes_of(t) for t in texts_of(batch.column("text"))]
            for t in texts:
                words.update(t.lower().split())
            for some in chunks(texts):
                codes = gram_codes(some, order)[0]
                if not len(codes):
                    continue
                grams.append(np.unique(codes, return_counts=True))
                held += len(grams[-1][0])
                if held > GATHER_GRAMS:
                    grams = summed(grams)
                    held = len(grams[0][0])
                    if held > GATHER_GRAMS // 2:
                        yield from gram_batches(grams)
                        grams, held = [], 0
            if len(words) > GATHER:
                yield words_batch(words)
                words = Counter()
        yield words_batch(words)
        if grams:
            yield from gram_batches(summed(grams))

    learned = docs.where(~F.col("held_out")).select("text")
    return learned.mapInArrow(run, "word binary, gram bigint, n bigint").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def code_lengths(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 of the model's probability for every possible n-gram (256 ** 3 numbers)."""
    trie = np.zeros((256, 256, 256), np.int64)
    trie.reshape(-1)[grams] = counts
    n1 = trie.sum(axis=0)
    n0 = n1.sum(axis=0)
    t1, d1, e1 = n1.sum(axis=1), (n1 > 0).sum(axis=1), ((n1 > 0) * n0).sum(axis=1)
    t0, d0 = n0.sum(), (n0 > 0).sum()
    never = -math.log10(256 - d0) if d0 < 256 else 0.0

    def step(n, total, different):
        """Value of a symbol here, and of the escape, where counts are left."""
        both = np.maximum(total + different, 1)
        with np.errstate(divide="ignore"):
            return np.log10(n / both), np.where(different > 0, np.log10(np.maximum(different, 1) / both), 0.0)

    symbol0, escape0 = step(n0[None, :], (t0 - e1)[:, None], (d0 - d1)[:, None])
    after1 = np.where(n0[None, :] > 0, symbol0, escape0 + never)
    out = np.empty((256, 256, 256), np.float32)
    for first in range(256):
        n2 = trie[first]
        seen = n2 > 0
        t2, d2, e2 = n2.sum(axis=1), seen.sum(axis=1), (seen * n1).sum(axis=1)
        symbol2, escape2 = step(n2, t2[:, None], d2[:, None])
        symbol1, escape1 = step(n1, (t1 - e2)[:, None], (d1 - d2)[:, None])
        out[first] = np.where(seen, symbol2, escape2 + np.where(n1 > 0, symbol1, escape1 + after1))
    return out.reshape(-1)


class Deep:
    """Code lengths after three bytes, as far as a task holds them.

    ``row`` has a number per context of three bytes: the row of ``cells`` of a frequent one, -1 if it was never seen, -2 - i for
    the i-th other one. A row has a column per symbol seen in training and one for all others. For the other contexts
    there is what an escape adds to the code length of the dense table, where the symbol was seen after
    two bytes (``known``) and where it was not (``new``).
    """

    def __init__(self, table: np.ndarray, grams: np.ndarray, counts: np.ndarray, contexts: pa.Table):
        self.table, self.seen = table, np.zeros(256 ** 3, bool)
        self.seen[grams] = True
        self.t2 = np.bincount(grams >> 8, weights=counts, minlength=1 << 16)
        self.d2 = np.bincount(grams >> 8, minlength=1 << 16)
        symbols = np.flatnonzero(np.bincount(grams & 255, minlength=256))
        self.width = len(symbols) + 1
        self.column = np.full(256, len(symbols), np.int32)
        self.column[symbols] = np.arange(len(symbols))
        context, t3, d3, e3 = (contexts.column(c).to_numpy() for c in ("context", "t", "d", "e"))
        # The least count from which on the rows fit.
        most = CELLS // self.width
        by = np.sort(t3)[::-1]
        self.least = int(by[0]) + 1 if len(by) and not most else int(by[most]) + 1 if len(by) > most else 0
        low = context & 0xFFFF
        both2, left = self.t2[low] + self.d2[low], self.d2[low] - d3
        rest = both2 - e3 - d3
        escape = np.log10(d3 / (t3 + d3))
        with np.errstate(divide="ignore", invalid="ignore"):
            known = escape + np.log10(both2 / rest)
            new = escape + np.where(left > 0, np.log10(both2 / rest * left / self.d2[low]), np.log10(both2 / self.d2[low]))
        hot = t3 >= self.least
        self.row = np.full(256 ** 3, -1, np.int32)
        self.row[context[hot]] = np.arange(hot.sum(), dtype=np.int32)
        self.row[context[~hot]] = -2 - np.arange((~hot).sum(), dtype=np.int32)
        self.known, self.new = known[~hot].astype(np.float32), new[~hot].astype(np.float32)
        # Escapes first; symbols seen after three bytes are put in by ``put``.
        self.cells = np.empty((int(hot.sum()), self.width), np.float32)
        other = int(np.argmax(self.column == len(symbols)))  # any symbol never seen; its column is not read if there is none
        codes = np.append(symbols, other)
        for at in range(0, len(self.cells), 1 << 14):
            part = slice(at, at + (1 << 14))
            grams2 = (low[hot][part, None] << 8) + codes
            self.cells[part] = table[grams2] + np.where(self.seen[grams2], known[hot][part, None], new[hot][part, None])

    def __getstate__(self) -> dict:
        """Arrays are mostly repeats, and sent compressed."""
        arrays = {k: v for k, v in vars(self).items() if isinstance(v, np.ndarray)}
        packed = {k: (v.dtype.str, v.shape, v.nbytes, pa.compress(np.ascontiguousarray(v).reshape(-1), codec="zstd", asbytes=True))
                  for k, v in arrays.items() if v.size}
        return {**vars(self), **packed}

    def __setstate__(self, state: dict) -> None:
        for k, v in state.items():
            if isinstance(v, tuple):
                kind, shape, size, raw = v
                v = np.frombuffer(pa.decompress(raw, size, codec="zstd"), kind).reshape(shape)
            setattr(self, k, v)

    def put(self, grams: np.ndarray, values: np.ndarray) -> None:
        self.cells[self.row[grams >> 8], self.column[grams & 255]] = values

    def lengths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each n-gram, and where it is only right if the table does not hold the n-gram."""
        row, low = self.row[codes >> 8], codes & 0xFFFFFF
        out = np.empty(len(codes), np.float32)
        hot = row >= 0
        out[hot] = self.cells.reshape(-1)[row[hot].astype(np.int64) * self.width + self.column[codes[hot] & 255]]
        out[~hot] = self.table[low[~hot]]
        cold = np.flatnonzero(row < -1)
        at = -2 - row[cold]
        out[cold] += np.where(self.seen[low[cold]], self.known[at], self.new[at])
        return out, cold


def deep_tables(counts: DataFrame, short: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context, t, d, e): occurrences, different symbols and their counts after one byte less; (gram, t, value) of all seen."""
    grams = counts.select("gram", "n", F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(0xFFFFFF).alias("low"))
    contexts = stored(grams.join(short.select(F.col("gram").alias("low"), F.col("n").alias("less")), "low").groupBy("context").agg(
        F.sum("n").alias("t"), F.count(F.lit(1)).alias("d"), F.sum("less").alias("e")), "contexts")
    values = grams.join(contexts, "context").select("gram", "t", F.log10(F.col("n") / (F.col("t") + F.col("d"))).alias("value"))
    return contexts, values


def _level() -> Column:
    """Eighths of a doubling of the count."""
    return F.floor(F.log2(F.col("n")) * 8).cast("int")


def hot_level(words: DataFrame, most: int = HOT) -> int:
    """The lowest level of counts from which on there are at most ``most`` words."""
    levels = words.groupBy(_level().alias("level")).count().collect()  # a few hundred, whatever the counts
    found, lowest = 0, 8 * 64
    for row in sorted(levels, key=lambda r: -r["level"]):
        found += row["count"]
        if found > most:
            break
        lowest = row["level"]
    return lowest


def score(docs: DataFrame, is_held_out: Column | None = None, order: int = ORDER) -> DataFrame:
    """Base and model score of every document, learned from the documents that are not held out."""
    spark: SparkSession = docs.sparkSession
    held = held_out(F.col("doc_id")) if is_held_out is None else is_held_out
    rows = id_text(docs).withColumn("held_out", held)
    counts = stored(trie_counts(rows, order), "counts")
    n_train = rows.where(~F.col("held_out")).count()
    seen = counts.where(F.col("gram").isNotNull()).select("gram", "n")
    short = seen if order == ORDER else stored(
        seen.groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.sum("n").alias("n")), "short")
    grams = short.toArrow()  # 256 ** 3 rows at most
    words = counts.where(F.col("word").isNotNull()).select("word", "n")
    n_words, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, kinds = n_words + n_train, n_kinds + (n_train > 0)
    floor = math.log10(tokens + 0.5 * (kinds + 1))
    hot = words.where(_level() >= hot_level(words)).toArrow()  # HOT rows at most
    known = dict(zip(hot.column("word").to_pylist(), np.log10(hot.column("n").to_numpy() + 0.5).tolist()))
    table, deep, values = code_lengths(grams.column("gram").to_numpy(), grams.column("n").to_numpy()), None, None
    if order > ORDER:
        contexts, values = deep_tables(seen, short)
        deep = Deep(table, grams.column("gram").to_numpy(), grams.column("n").to_numpy(), contexts.toArrow())  # 256 ** 3 rows at most
        hot_grams = values.where(F.col("t") >= deep.least).toArrow()  # CELLS rows at most
        deep.put(hot_grams.column("gram").to_numpy(), hot_grams.column("value").to_numpy())
        values = values.where(F.col("t") < deep.least)
        del hot_grams
    shared = spark.sparkContext.broadcast((known, table if deep is None else None, deep))
    del grams, table, deep
    end = math.log10(n_train + 0.5)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, table, deep = shared.value
        texts = [_bytes_of(t) for t in texts_of(batch.column("text"))]
        n_tokens, n_hot, hot_sum, cold = [], [], [], []
        for t in texts:
            found = t.lower().split()
            values = [v for v in map(known.get, found) if v is not None]
            n_tokens.append(len(found) + 1)
            n_hot.append(len(values))
            hot_sum.append(math.fsum(values))
            cold.append([w for w in found if w not in known] if len(values) < len(found) else [])
        scores, escapes = [], []
        for some in chunks(texts):
            codes, lengths = gram_codes(some, order)
            at = offsets_of(lengths)
            if deep is None:
                value = table[codes]
                escapes += [[]] * len(some)
            else:
                value, open_ = deep.lengths(codes)
                rows = list(zip(codes[open_].tolist(), value[open_].tolist()))
                value[open_] = 0
                ends = np.searchsorted(open_, at)
                escapes += [[{"gram": g, "value": v} for g, v in rows[a:b]] for a, b in zip(ends[:-1], ends[1:])]
            sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
            scores.append(sums[at[1:]] - sums[at[:-1]])
        return pa.RecordBatch.from_arrays(
            [batch.column("place"), batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens, pa.int64()),
             pa.array(n_hot, pa.int64()), pa.array(hot_sum, pa.float64()), pa.array(np.concatenate(scores), pa.float64()),
             pa.array(cold, pa.list_(pa.binary())),
             pa.array(escapes, pa.list_(pa.struct([("gram", pa.int64()), ("value", pa.float64())])))],
            names=["place", "doc_id", "held_out", "n_tokens", "n_hot", "hot_sum", "score", "cold", "escapes"])

    scored = stored(map_batches(
        rows.withColumn("place", F.monotonically_increasing_id()), run,
        "place bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_hot bigint, hot_sum double, score double, "
        "cold array<binary>, escapes array<struct<gram: bigint, value: double>>"), "scored")
    cold = scored.select("place", F.explode("cold").alias("word")).join(words, "word", "left")
    rest = cold.groupBy("place").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("cold_sum"), F.count("n").alias("n_cold"))
    known_end = F.lit(int(n_train > 0)).cast("bigint")
    out = scored.drop("cold", "escapes").join(rest, "place", "left")
    if values is not None:
        deeper = scored.select("place", F.inline("escapes").alias("gram", "escape")).join(
            values.select("gram", "value"), "gram", "left").groupBy("place").agg(
            F.sum(F.coalesce("value", "escape")).alias("deep_sum"))
        out = out.join(deeper, "place", "left").withColumn("score", F.col("score") + F.coalesce("deep_sum", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_hot") + F.coalesce("n_cold", F.lit(0)) + known_end).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("cold_sum", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )
