"""SentencePiece encoding and decoding by vectorised merge rounds.

A text becomes one word-boundary mark followed by the text with its spaces turned into marks. As
no vocabulary entry has a mark after another character (this is checked when a model is
loaded; a model for which it fails has each text as one segment), merges never leave a
segment of the form marks + rest, so each distinct segment is encoded once per task. All
segments of a batch lie in one flat array of symbols. A round takes, per segment, the
pair of lowest rank (equal ranks: the leftmost), merges it in all segments at once, closes
the gaps and looks up only the pairs that changed, until no segment has a pair left.

Segments of over ``LONG`` symbols would need as many rounds; they are merged one by one with a
heap in the same order, which gives the same result.

Nulls and empty texts have no tokens and decode to an empty text. Characters unknown to the
vocabulary become byte tokens. Repeated rows are encoded alike; other columns are kept as
they are, except that columns named like an output column are replaced.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, offsets_of, spread_rows, texts_of

MARK = "▁"
LONG = 512
CACHE = 200_000
NO_RANK = np.int64(1) << 30
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(raw: bytes):
    """(number, value) of a protobuf message's fields; length-delimited values as bytes."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 1:
            value, at = raw[at:at + 8], at + 8
        elif kind == 5:
            value, at = raw[at:at + 4], at + 4
        else:
            size, at = _varint(raw, at)
            value, at = raw[at:at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """A BPE model with byte fallback, read from the bytes of its file."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        normalizer: dict[int, object] = {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0" * 4), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a BPE model")
            elif number == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        if USER in self.kinds:
            raise ValueError("user-defined pieces are not supported")
        self._build()

    def _build(self) -> None:
        usable = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, UNUSED)}
        self.byte_id = np.zeros(256, np.int32)
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.byte_id[int(self.pieces[i][3:5], 16)] = i
        # Symbols are pieces, and behind them single characters that occur in pieces only.
        symbols = dict(usable)
        n = len(self.pieces)
        for p in usable:
            for c in p:
                if c not in symbols:
                    symbols[c] = n
                    n += 1
        self.unknown = n
        self.width = np.int64(n + 1)
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in usable.values()}, reverse=True))}
        left, right, merged, rank = [], [], [], []
        for p, i in usable.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
                    rank.append(order[self.scores[i]])
        keys = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        by = np.argsort(keys)
        self.keys = np.append(keys[by], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int32)[by], 0)
        self.ranks = np.append(np.array(rank, np.int64)[by], NO_RANK)
        self.character = {ord(c): s for c, s in symbols.items() if len(c) == 1}
        top = max(self.character) + 1
        self.char_symbol = np.full(top + 1, self.unknown, np.int32)
        for c, s in self.character.items():
            self.char_symbol[c] = s
        self.char_symbol[top] = self.unknown
        # Symbols behind the pieces and unknown ones end as bytes.
        self.n_pieces = len(self.pieces)
        self.splits = not any(
            a != MARK and b == MARK for p in usable for a, b in zip(p, p[1:])
        )
        surface = []
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == BYTE:
                surface.append(bytes([int(p[3:5], 16)]))
            elif self.kinds[i] == CONTROL:
                surface.append(b"")
            elif self.kinds[i] == UNKNOWN:
                surface.append(" ⁇ ".encode())
            else:
                surface.append(p.replace(MARK, " ").encode())
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = offsets_of(self.surface_len)[:-1]
        self.leading = np.array([p.startswith(MARK) for p in self.pieces])

    # --- encoding -----------------------------------------------------------------------

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NO_RANK``: none) and entry of pairs of symbols."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), at

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all segments in one array, and the number of each segment's."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.array([len(s) for s in segments], np.int64)
        symbols = self.char_symbol[np.minimum(codes, len(self.char_symbol) - 1)]
        counts = np.zeros(len(segments), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ends = np.cumsum(lengths)
        for k in np.flatnonzero(lengths > LONG):
            a, b = ends[k] - lengths[k], ends[k]
            s, c = self._heap(symbols[a:b], codes[a:b])
            parts.append((np.full(len(s), k), s, c))
        rows = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        if len(rows):
            take = spread_rows(ends[rows] - lengths[rows], lengths[rows])
            parts += self._rounds(rows, lengths[rows], symbols[take], codes[take])
        if not parts:
            return np.zeros(0, np.int32), counts
        row, sym, cp = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(row, kind="stable")
        row, sym, cp = row[by], sym[by], cp[by]
        loose = np.flatnonzero(sym >= self.n_pieces)
        if len(loose):
            raw = [chr(c).encode("utf-8", "replace") for c in cp[loose]]
            size = np.ones(len(sym), np.int64)
            size[loose] = [len(r) for r in raw]
            out = np.repeat(sym, size)
            at = offsets_of(size)[:-1][loose]
            out[spread_rows(at, size[loose])] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            sym, row = out, np.repeat(row, size)
        counts += np.bincount(row, minlength=len(segments))
        return sym.astype(np.int32), counts

    def _rounds(self, rows, lengths, sym, cp):
        """Merge the best pair of every segment at once, again and again."""
        parts = []
        starts = offsets_of(lengths)[:-1]
        seg = np.repeat(np.arange(len(rows)), lengths)
        rank = np.full(len(sym), NO_RANK)
        entry = np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(seg[:-1] == seg[1:])
        rank[inner], entry[inner] = self.pair(sym[inner], sym[inner + 1])
        while len(rows):
            best = np.minimum.reduceat((rank << 32) + np.arange(len(sym)), starts)
            live = best >> 32 < NO_RANK
            if not live.all():
                done = ~np.repeat(live, lengths)
                parts.append((rows[seg[done]], sym[done], cp[done]))
                keep = ~done
                best_at = best[live] & 0xFFFFFFFF
                moved = np.cumsum(keep) - 1
                sym, cp, rank, entry = sym[keep], cp[keep], rank[keep], entry[keep]
                rows, lengths = rows[live], lengths[live]
                at = moved[best_at]
                seg = np.repeat(np.arange(len(rows)), lengths)
                if not len(rows):
                    break
            else:
                at = best & 0xFFFFFFFF
            sym[at] = self.merged[entry[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, cp, rank, entry, seg = sym[keep], cp[keep], rank[keep], entry[keep], seg[keep]
            lengths = lengths - 1
            starts = offsets_of(lengths)[:-1]
            at = at - np.arange(len(at))
            for p in (at, at - 1):
                p = p[(p >= 0) & (p < len(sym) - 1)]
                same = seg[p] == seg[p + 1]
                rank[p[~same]] = NO_RANK
                p = p[same]
                rank[p], entry[p] = self.pair(sym[p], sym[p + 1])
            if len(sym):
                rank[-1] = NO_RANK
        return parts

    def _heap(self, sym, cp):
        """The same merges for one long segment, one by one."""
        sym = sym.tolist()
        n = len(sym)
        after, before, alive = list(range(1, n)) + [-1], list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []
        keys, ranks, merged, width = self.keys, self.ranks, self.merged, int(self.width)
        cache: dict[int, tuple[int, int] | None] = {}

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if i < 0 or j < 0:
                return
            key = sym[i] * width + sym[j]
            if key not in cache:
                at = int(np.searchsorted(keys, key))
                cache[key] = (int(ranks[at]), int(merged[at])) if keys[at] == key else None
            if cache[key]:
                heapq.heappush(heap, (cache[key][0], i, sym[i], sym[j], cache[key][1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, into = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = into, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        keep = np.flatnonzero(alive)
        return np.array(sym, np.int32)[keep], cp[keep]

    def segments_of(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.splits:
            return [marked]
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return [MARK + w for w in text.split(" ")]
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)

    # --- decoding -----------------------------------------------------------------------

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of several id sequences that lie one after another."""
        sizes = self.surface_len[ids]
        flat = self.surface[spread_rows(self.surface_at[ids], sizes)]
        at = offsets_of(counts)
        ends = offsets_of(sizes)[at]
        out = []
        for k in range(len(counts)):
            a = int(ends[k])
            if counts[k] and self.leading[ids[at[k]]]:
                a += 1  # the mark put in front of the text
            out.append(flat[a:int(ends[k + 1])].tobytes().decode("utf-8", "replace"))
        return out


class Encoder:
    """Encodes batches; remembers segments while there are few enough of them."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.size: list[np.ndarray] = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of each text's."""
        if len(self.index) > CACHE:
            self._forget()
        index = self.index
        known = len(index)
        codes: list[int] = []
        per_text = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            segments = self.model.segments_of(text)
            per_text[k] = len(segments)
            for s in segments:
                c = index.get(s)
                if c is None:
                    c = index[s] = len(index)
                codes.append(c)
        if len(index) > known:
            fresh = list(index)[known:]
            flat, size = self.model.encode_segments(fresh)
            self.flat = [np.concatenate([*self.flat, flat])]
            self.size = [np.concatenate([*self.size, size])]
        if not codes:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        code = np.array(codes, np.int64)
        size, flat = self.size[0], self.flat[0]
        lengths = size[code]
        ids = flat[spread_rows(offsets_of(size)[:-1][code], lengths)]
        bounds = offsets_of(per_text)
        total = offsets_of(lengths)
        return ids, total[bounds[1:]] - total[bounds[:-1]]


_LOADED: dict[int, PieceModel] = {}


def load(raw: bytes) -> PieceModel:
    """The model of a file's bytes, built once per Python process."""
    key = hash(raw)
    if key not in _LOADED:
        _LOADED[key] = PieceModel(raw)
    return _LOADED[key]


def _with_columns(batch: pa.RecordBatch, names: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = {n: batch.column(n) for n in names}
    return pa.RecordBatch.from_arrays([*columns.values(), *more.values()], names=[*columns, *more])


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """Add the token ids of every whole text as an array. The model file is read here, on the driver."""
    with open(model_path, "rb") as f:
        raw = f.read()
    PieceModel(raw)
    docs = docs.drop(ids_col)
    names = docs.columns
    state: dict[str, Encoder] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "encoder" not in state:
            state["encoder"] = Encoder(load(raw))
        ids, counts = state["encoder"].encode(texts_of(batch.column(text_col)))
        array = pa.ListArray.from_arrays(pa.array(offsets_of(counts), pa.int32()), pa.array(ids, pa.int32()))
        return _with_columns(batch, names, {ids_col: array})

    schema = docs.withColumn(ids_col, F.lit(None).cast("array<int>")).schema
    return map_batches(docs, run, schema)


def decode(tokens: DataFrame, model_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of every array of token ids (null: empty)."""
    with open(model_path, "rb") as f:
        raw = f.read()
    tokens = tokens.drop(text_col)
    names = tokens.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(ids_col)
        counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        ids = np.asarray(lists.flatten(), np.int64)
        return _with_columns(batch, names, {text_col: pa.array(load(raw).decode_flat(ids, counts), pa.string())})

    schema = tokens.withColumn(text_col, F.lit(None).cast("string")).schema
    return map_batches(tokens, run, schema)
