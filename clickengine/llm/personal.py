"""Personal data by fixed patterns and a character-level BiLSTM-CRF trained here.

Patterns give the base spans of four kinds: email, ip, card, phone. They are also the labels: a bounded sample of
places (``TRAIN_PLACES``, chosen by hash over all documents) with a span or without one trains a bidirectional LSTM
over characters with CRF transitions, in numpy, on the driver. Most labelled spans are shown to it in
a form that the patterns do not know, with the labels they had (``altered``): a spelt-out at or dot, other separators,
no plus sign. Places without a span get dates, versions, prices and the like, labelled as nothing.

Every character of every text is read by both directions, in pieces of ``PIECE`` characters that overlap. Windows of
``READ`` characters share ``STEP`` with the next, whose tag scores are the mean of both (weighted by the distance from
their edges), and the CRF decodes each piece as a whole, unless bounds say that only "none" can win in it (``none_wins``;
the tags are the same). A piece whose edge lies in a span grows until it
does not, so there is no limit of length. Found spans are widened to whole words and must pass the exact check of their kind
(``holds``: parts at most 255, Luhn, 8 to 15 digits, a local part, an at and a dot). Overlapping finds are reconciled over the
text: base spans come first, then the more probable (ties: the earlier, the longer). So the model only adds
spans, those with a mean probability per character of ``SURE``.

Null and empty texts have no spans. Texts are read whole. Repeated rows get the same spans. An empty table gives an
empty result; without any labelled span in the table the model adds nothing. Columns other than id and text are ignored.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_batches, texts_of
from .components import stored

KINDS = ("email", "ip", "card", "phone")
OTHER, PLAIN = -1, -2  # places without a span: around a trigger, around none
TRAIN_PLACES = 4000
AROUND = 40  # characters on both sides of a place
WINDOW = 64
STEP = WINDOW // 2
READ = 256  # a window in reading; two of them share STEP characters
COLUMNS, SIDE = 160, 3  # windows side by side
PIECE = 4096
EMBED, HIDDEN, TAGS = 12, 32, 1 + 2 * len(KINDS)
STEPS = 1200
SURE = 0.9
CELLS = 1 << 19  # characters read, or decoded, side by side

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits can only match from its first digit, which the look-behind says.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({]\x20?at\x20?[\])}]|\bat\x20[a-z0-9-]+(?:\x20?[\[({]?dot\b|\.[a-z0-9])", re.I | re.A)
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"@|\bat\b", re.I | re.A)
_DOT = re.compile(r"\.|\bdot\b", re.I | re.A)

Span = tuple[int, int, int]  # kind, start, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def char_ids(text: str) -> np.ndarray:
    """Characters as numbers: ASCII as it is, then other Latin letters, then anything else."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(codes < 128, codes, np.where(codes < 0x250, 128, 129))


N_CHARS, PAD = 131, 130


def regions_of(text: str) -> list[tuple[int, int]]:
    """The whole text in overlapping pieces, on the grid of half windows."""
    out, a = [], 0
    while len(text) - a > PIECE:
        out.append((a, a + PIECE))
        a += PIECE - 2 * WINDOW
    return [*out, (a, len(text))] if text else []


def _on_grid(start: int, end: int, n: int) -> tuple[int, int]:
    return max(0, start // STEP * STEP), min(n, -(-end // STEP) * STEP)


def tags_of(spans: list[Span], start: int, length: int) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        lo, hi = max(a, start), min(b, start + length)
        if lo < hi:
            tags[lo - start:hi - start] = 2 + 2 * kind
            if a >= start:
                tags[a - start] = 1 + 2 * kind
    return tags


# --- the model ------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def new_parameters(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape):
        return (rng.standard_normal(shape) * 0.2).astype(np.float32)

    p = {"embed": normal(N_CHARS, EMBED), "out": normal(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32),
         "move": normal(TAGS, TAGS)}
    for d in "fb":
        p[f"w{d}"] = normal(EMBED + HIDDEN, 4 * HIDDEN)
        p[f"b{d}"] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)
    return p


def _lstm(p: dict, d: str, x: np.ndarray, keep: bool):
    """Hidden states of one direction over (steps, windows, embed); input, forget, candidate, output gates."""
    w, b = p[f"w{d}"], p[f"b{d}"]
    steps, n, _ = x.shape
    given = x @ w[:EMBED] + b
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    saved = []
    for t in range(steps):
        z = given[t] + h @ w[EMBED:]
        gates = _sigmoid(z)
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 3 * HIDDEN:]
        g = np.tanh(z[:, 2 * HIDDEN:3 * HIDDEN])
        before = c
        c = f * c + i * g
        s = np.tanh(c)
        if keep:
            saved.append((h, before, i, f, g, o, s))
        h = o * s
        out[t] = h
    return out, saved


def _lstm_back(p: dict, d: str, x: np.ndarray, saved, grad: np.ndarray, grads: dict) -> np.ndarray:
    w = p[f"w{d}"]
    dx = np.empty_like(x)
    dh = np.zeros_like(grad[0])
    dc = np.zeros_like(grad[0])
    dw, db = np.zeros_like(w), np.zeros_like(p[f"b{d}"])
    for t in range(len(x) - 1, -1, -1):
        h, before, i, f, g, o, s = saved[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - s * s)
        dz = np.concatenate(
            [dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g * g), dh * s * o * (1 - o)], axis=1)
        both = np.concatenate([x[t], h], axis=1)
        dw += both.T @ dz
        db += dz.sum(axis=0)
        back = dz @ w.T
        dx[t], dh = back[:, :EMBED], back[:, EMBED:]
        dc = dc * f
    grads[f"w{d}"], grads[f"b{d}"] = dw, db
    return dx


def emissions(p: dict, chars: np.ndarray, keep: bool = False):
    """Tag scores (steps, windows, tags) of windows given as (windows, steps) of characters."""
    x = p["embed"][chars.T]
    forward, saved_f = _lstm(p, "f", x, keep)
    backward, saved_b = _lstm(p, "b", x[::-1], keep)
    hidden = np.concatenate([forward, backward[::-1]], axis=2)
    return hidden @ p["out"] + p["out_b"], (x, hidden, saved_f, saved_b)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def marginals(move: np.ndarray, scores: np.ndarray):
    """Forward and backward sums, log of the total, and the probability of each tag."""
    steps = len(scores)
    a, b = np.empty_like(scores), np.zeros_like(scores)
    a[0] = scores[0]
    for t in range(1, steps):
        a[t] = _log_sum(a[t - 1][:, :, None] + move, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        b[t] = _log_sum((b[t + 1] + scores[t + 1])[:, None, :] + move, 2)
    total = _log_sum(a[-1], 1)
    return a, b, total, np.exp(a + b - total[None, :, None])


def gradient(p: dict, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Loss (negative log-likelihood per window) and its gradient."""
    scores, (x, hidden, saved_f, saved_b) = emissions(p, chars, True)
    a, b, total, probability = marginals(p["move"], scores)
    steps, n, _ = scores.shape
    gold = tags.T
    rows = np.arange(n)
    said = scores[np.arange(steps)[:, None], rows, gold].sum(axis=0) + p["move"][gold[:-1], gold[1:]].sum(axis=0)
    ds = probability.copy()
    ds[np.arange(steps)[:, None], rows, gold] -= 1
    ds /= n
    moved = np.zeros_like(p["move"])
    for t in range(1, steps):
        joint = a[t - 1][:, :, None] + p["move"] + (scores[t] + b[t])[:, None, :] - total[:, None, None]
        moved += np.exp(joint).sum(axis=0)
    np.subtract.at(moved, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    grads = {"move": moved / n, "out": np.einsum("tnh,tnk->hk", hidden, ds), "out_b": ds.sum(axis=(0, 1))}
    dh = ds @ p["out"].T
    dx = _lstm_back(p, "f", x, saved_f, dh[:, :, :HIDDEN], grads)
    dx = dx + _lstm_back(p, "b", x[::-1], saved_b, dh[::-1, :, HIDDEN:], grads)[::-1]
    embed = np.zeros_like(p["embed"])
    np.add.at(embed, chars.T.ravel(), dx.reshape(-1, EMBED))
    grads["embed"] = embed
    return float((total - said).mean()), grads


def train(chars: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = 64) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of windows, the same number of steps for any sample."""
    p = new_parameters()
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    rng = np.random.default_rng(11)
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(chars))
        some, order = order[:batch], order[batch:]
        rate = 0.02 * (1 - step / steps) + 0.0005
        _, grads = gradient(p, chars[some], tags[some])
        shrink = min(1.0, 5 / np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        for k, g in grads.items():
            g = g * shrink
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            p[k] = (p[k] - rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return p


def window_scores(p: dict, chars: np.ndarray) -> np.ndarray:
    """The tag scores of ``emissions`` as (windows, steps, tags), only to read: both directions together, in place.

    Columns are windows, ``SIDE`` blocks of up to ``COLUMNS`` side by side: products that small stay on one core. A sigmoid is
    (1 + tanh(x / 2)) / 2; cells and hidden states are kept doubled, the factors are in the weights.
    """
    h, x = HIDDEN, HIDDEN + EMBED
    order = np.r_[:2 * h, 3 * h:4 * h, 2 * h:3 * h]  # input, forget, output, candidate
    factor = np.repeat(np.float32([0.5, 0.5, 0.5, 1]), h)[:, None]
    weights = np.stack([np.concatenate([p[f"w{d}"][EMBED:] / 2, p[f"w{d}"][:EMBED], p[f"b{d}"][None]]).T[order] * factor for d in "fb"])
    weights = weights[:, None].astype(np.float32)
    read = np.ascontiguousarray((p["out"] / 2).reshape(2, 1, h, TAGS).transpose(0, 1, 3, 2), np.float32)
    embed = np.ascontiguousarray(p["embed"].T, np.float32)
    many, steps = chars.shape
    out = np.empty((many, steps, TAGS), np.float32)
    for at in range(0, many, SIDE * COLUMNS):
        some = chars[at:at + SIDE * COLUMNS]
        n = len(some)
        blocks = -(-n // COLUMNS)
        per = -(-n // blocks)
        ids = np.full((steps, blocks * per), PAD)
        ids[:, :n] = some.T
        ids = ids.reshape(steps, blocks, per)
        given = np.ones((2, blocks, x + 1, per), np.float32)  # hidden, character, 1
        given[:, :, :h] = 0
        hidden, letter = given[:, :, :h], given[:, :, h:x]
        z = np.empty((2, blocks, 4 * h, per), np.float32)
        gates, (i, f, o, g) = z[:, :, :3 * h], (z[:, :, k * h:(k + 1) * h] for k in range(4))
        cell, squashed = np.zeros((2, blocks, h, per), np.float32), np.empty((2, blocks, h, per), np.float32)
        said = np.empty((steps, 2, blocks, TAGS, per), np.float32)
        for t in range(steps):
            for k in range(blocks):
                np.take(embed, ids[t, k], axis=1, out=letter[0, k], mode="clip")
                np.take(embed, ids[-1 - t, k], axis=1, out=letter[1, k], mode="clip")
            np.matmul(weights, given, out=z)
            np.tanh(z, out=z)
            gates += 1
            f *= 0.5
            cell *= f
            i *= g
            cell += i
            np.multiply(cell, 0.5, out=squashed)
            np.tanh(squashed, out=squashed)
            np.multiply(o, squashed, out=hidden)
            np.matmul(read, hidden, out=said[t])
        both = said[:, 0] + said[::-1, 1] + p["out_b"][:, None]
        out[at:at + n] = both.transpose(1, 3, 0, 2).reshape(blocks * per, steps, TAGS)[:n]
    return out


def windows_of(n: int, a: int, b: int) -> tuple[int, int]:
    """The first window that has a character of ``a`` to ``b`` of a text of n characters, and the one after the last."""
    first, r = divmod(a, READ - STEP)
    last = max(0, -(-(n - READ) // (READ - STEP)))
    return min(first - (first > 0 and r < STEP), last), min((b - 1) // (READ - STEP), last) + 1


def scores_of(p: dict, texts: list[str], parts: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """Tag scores (characters, tags) of parts (text, start, end): the mean over the windows of a character."""
    # A text of one window gets a shorter one where that holds it.
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for at, (k, a, b) in enumerate(parts):
        n = len(texts[k])
        by_length.setdefault(min(READ, -(-n // WINDOW) * WINDOW), []).append((at, *windows_of(n, a, b)))
    rise = ((np.arange(STEP, dtype=np.float32) + 1) / (STEP + 1))[:, None]
    out: list[np.ndarray] = [np.empty((0, TAGS), np.float32)] * len(parts)
    for length, rows in by_length.items():
        chars = np.full((sum(last - first for _, first, last in rows), length), PAD)
        line = 0
        for at, first, last in rows:
            lo = first * (READ - STEP)
            codes = char_ids(texts[parts[at][0]][lo:(last - 1) * (READ - STEP) + length])
            for w in range(last - first):
                own = codes[w * (READ - STEP):w * (READ - STEP) + length]
                chars[line, :len(own)] = own
                line += 1
        said = window_scores(p, chars)
        line = 0
        for at, first, last in rows:
            mine = said[line:line + last - first]
            line += last - first
            # Windows share their last and first characters, whose scores pass from the one's to the other's.
            if len(mine) > 1:
                mine[1:, :STEP] *= rise
                mine[1:, :STEP] += mine[:-1, READ - STEP:] * rise[::-1]
            whole = np.concatenate([mine[:, :READ - STEP].reshape(-1, TAGS), mine[-1, READ - STEP:]])
            _, a, b = parts[at]
            lo = first * (READ - STEP)
            out[at] = whole[a - lo:b - lo]
    return out


def detours(move: np.ndarray) -> tuple[float, float, float, float, float]:
    """Bounds of what other tags for some places in a row change in the sum of moves, against "none" at all of them.

    ``each`` per move within, ``enter`` and ``leave`` for those from and to none, ``first`` and ``last`` instead of these at the ends of
    a sequence. A height of each tag is added to the moves from it and taken from those to it, which leaves a way's sum as it is but for
    its ends, so that ``each`` is about the largest mean of moves in a circle.
    """
    change = move.astype(float) - float(move[0, 0])
    inner = change[1:, 1:]

    def heights(each: float) -> np.ndarray | None:
        """Heights that leave no move above ``each``, if there are any (with the largest move there are)."""
        u = np.zeros(len(inner))
        for _ in range(len(inner) + 1):
            higher = np.maximum(u, (inner - each + u[:, None]).max(axis=0))
            if np.array_equal(higher, u):
                return u
            u = higher
        return None

    low, each = float(inner.min()) - 1, float(inner.max())
    for _ in range(20):
        mid = (low + each) / 2
        low, each = (mid, each) if heights(mid) is None else (low, mid)
    u = heights(each)
    each = float((inner + u[:, None] - u).max())
    return each, float((change[0, 1:] - u).max()), float((change[1:, 0] + u).max()), float(-u.min()), float(u.max())


def none_wins(ways: tuple[float, float, float, float, float], scores: np.ndarray) -> bool:
    """Whether the best tags of a sequence are sure to be "none" from end to end, by the bounds of ``detours``."""
    each, enter, leave, first, last = ways
    columns = scores.T
    lead = columns[1].copy()
    for column in columns[2:]:
        np.maximum(lead, column, out=lead)
    lead -= columns[0]
    sums = np.zeros(len(lead) + 1)
    np.cumsum(lead + each, out=sums[1:])
    lowest = np.minimum.accumulate(sums[:-1])
    most = max((sums[1:] - lowest).max() + enter + leave, sums[1:].max() + first + leave,
               sums[-1] - lowest[-1] + enter + last, sums[-1] + first + last)
    return bool(most - each < -0.01)  # the rest is for rounding


def decode(move: np.ndarray, scores: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Best tags (Viterbi) and their probabilities for sequences of any lengths, the longest first."""
    lengths = np.array([len(s) for s in scores])
    steps, n = int(lengths[0]), len(scores)
    given = np.zeros((steps, TAGS, n), np.float32)
    for k, s in enumerate(scores):
        given[:len(s), :, k] = s
    # At step t the first live[t] sequences go on.
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")
    # Best sums less the largest, and forward sums as shares, so that neither grows with the length.
    best = given - given.max(axis=1, keepdims=True)
    ways = np.exp(move).astype(np.float32)
    forward = np.exp(best)
    scale = forward.copy()
    columns = np.ascontiguousarray(move)[:, :, None]
    forward[0] /= forward[0].sum(axis=0)
    for t in range(1, steps):
        m = live[t]
        now = best[t, :, :m]
        now += (best[t - 1, :, None, :m] + columns).max(axis=0)
        now -= now.max(axis=0)
        share = forward[t, :, :m]
        share *= ways.T @ forward[t - 1, :, :m]
        share /= share.sum(axis=0)
    rows = np.arange(n)
    tags = np.zeros((steps, n), np.int64)
    sure = np.zeros((steps, n), np.float32)
    backward = np.ones((TAGS, n), np.float32)
    into = np.ascontiguousarray(move.T)
    for t in range(steps - 1, -1, -1):
        m = live[t]
        on = live[t + 1] if t + 1 < steps else 0
        if on:
            back = ways @ (backward[:, :on] * scale[t + 1, :, :on])
            backward[:, :on] = back / back.max(axis=0)
            tags[t, :on] = (best[t, :, :on] + into[tags[t + 1, :on]].T).argmax(axis=0)
        if on < m:
            tags[t, on:m] = best[t, :, on:m].argmax(axis=0)
        both = forward[t, :, :m] * backward[:, :m]
        sure[t, :m] = both[tags[t, :m], rows[:m]] / both.sum(axis=0)
    return [(tags[:m, k], sure[:m, k]) for k, m in enumerate(lengths)]


# --- over texts -----------------------------------------------------------------------------


def tagged(tags: np.ndarray, sure: np.ndarray, start: int) -> list[tuple[float, Span]]:
    """Runs of one kind, each begun by its own begin tag or by a change of kind."""
    out = []
    spots = np.flatnonzero(tags)
    i = 0
    while i < len(spots):
        at = int(spots[i])
        kind, end = int(tags[at] - 1) // 2, at + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        out.append((float(sure[at:end].mean()), (kind, start + at, start + end)))
        i = int(np.searchsorted(spots, end))
    return out


def holds(kind: int, part: str) -> bool:
    """The exact check of a span that the model found."""
    if kind == 0:
        at = _AT.search(part, 1)
        return at is not None and part[0].isalnum() and _DOT.search(part, at.end() + 1) is not None and part[-1].isalnum()
    numbers = re.findall("[0-9]+", part)
    digits = "".join(numbers)
    if kind == 1:
        return len(numbers) == 4 and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in numbers)
    return 16 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 8 <= len(digits) <= 15


def whole_words(span: Span, text: str) -> Span:
    """The span widened to the ends of the ASCII letters and digits it cuts, without white space at its ends."""
    kind, a, b = span
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1

    def word(c: str) -> bool:
        return c.isascii() and c.isalnum()

    while a < b and a > 0 and word(text[a]) and word(text[a - 1]):
        a -= 1
    while a < b < len(text) and word(text[b - 1]) and word(text[b]):
        b += 1
    return kind, a, b


def _longer(found: list[tuple[float, Span]], a: int, b: int, text: str) -> tuple[int, int] | None:
    """A part twice as far on the sides where a span reaches the edge; not for one with more digits than any kind has."""
    n, lo, hi = len(text), a, b
    for _, (kind, x, y) in found[:1] + found[-1:]:
        if kind and len(_DIGIT.findall(text, x, y)) > 19:
            continue
        if x == a and a > 0:
            lo = a - (b - a)
        if y == b and b < n:
            hi = b + (b - a)
    return None if (lo, hi) == (a, b) else _on_grid(lo, hi, n)


def model_spans(p: dict, texts: list[str]) -> list[list[tuple[float, Span]]]:
    """What the model finds in each text, read from its first character to its last, with its mean probability."""
    out: list[list[tuple[float, Span]]] = [[] for _ in texts]
    ways = detours(p["move"])
    waiting = [(k, a, b) for k, t in enumerate(texts) for a, b in regions_of(t)]
    while waiting:
        waiting.sort(key=lambda x: (x[1] - x[2], x))
        grown: list[tuple[int, int, int]] = []
        at, undecided, said = 0, [], []
        while at < len(waiting):
            # Sequences of one block together take a bounded number of cells, unless a single one needs more.
            longest = waiting[at][2] - waiting[at][1]
            some = waiting[at:at + max(1, min(1024, CELLS // longest))]
            at += len(some)
            for part, scores in zip(some, scores_of(p, texts, some)):
                if not none_wins(ways, scores):
                    undecided.append(part)
                    said.append(scores)
            # Still the longest first, as the decoder wants them; few at a time would cost it as much as many.
            if at < len(waiting) and (not said or len(said) * len(said[0]) < CELLS):
                continue
            for (k, a, b), (tags, sure) in zip(undecided, decode(p["move"], said) if said else []):
                found = tagged(tags, sure, a)
                longer = _longer(found, a, b, texts[k])
                if longer:
                    grown.append((k, *longer))
                else:
                    out[k] += found
            undecided, said = [], []
        waiting = []
        for k, a, b in sorted(grown):
            if waiting and waiting[-1][0] == k and a <= waiting[-1][2]:
                waiting[-1] = (k, waiting[-1][1], max(b, waiting[-1][2]))
            else:
                waiting.append((k, a, b))
    for k, found in enumerate(out):
        wide = [(x, whole_words(span, texts[k])) for x, span in found if x >= SURE]
        out[k] = [(x, (kind, a, b)) for x, (kind, a, b) in wide if holds(kind, texts[k][a:b])]
    return out


def reconcile(base: list[Span], found: list[tuple[float, Span]], n: int) -> list[Span]:
    """Base spans, and the model's that overlap none of them, nor a more probable one, in a text of n characters."""
    if not found:
        return sorted(base)
    kept = list(base)
    taken = bytearray(n)
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    for _, span in sorted(set(found), key=lambda x: (-x[0], x[1][1], -x[1][2])):
        _, a, b = span
        if not any(taken[a:b]):
            kept.append(span)
            taken[a:b] = b"\1" * (b - a)
    return sorted(kept)


# --- labelled examples ----------------------------------------------------------------------

# How people write an at, a dot, and the separators of numbers.
ATS = (" at ", " (at) ", "(at)", " [at] ", "[at]", " AT ", " @ ", "{at}")
DOTS = (".", " dot ", "(dot)", " [dot] ", "[.]", " DOT ", " (dot) ")
CARD_GAPS = (".", "/", "  ", "_", " - ", ":")
IP_GAPS = ("[.]", "(.)", " . ", " dot ", "[dot]")
PHONE_GAPS = ("-", ".", "/", " ", " - ")
ENDINGS = ("com", "org", "net", "edu", "info", "io", "de", "fr", "es", "uk", "eu")


def other_digits(rng: random.Random, text: str) -> str:
    return re.sub("[0-9]", lambda _: rng.choice("0123456789"), text)


def other_address(rng: random.Random, span: str, words: list[str]) -> str:
    """A labelled address, or one of other words in its place."""
    local, domain = other_digits(rng, span).split("@", 1)
    if rng.random() < 0.8:
        number = rng.choice(("", "", str(rng.randrange(100)), str(rng.randrange(2030))))
        local = rng.choice(("", "", rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("._-"))) + rng.choice(words) + rng.choice(
            ("", "", rng.choice("._-") + rng.choice(words))) + number
    if rng.random() < 0.8:
        names = [rng.choice(words) + rng.choice(("", "", "", str(rng.randrange(10)))) for _ in range(rng.choice((1, 1, 2)))]
        domain = ".".join([*names, rng.choice(ENDINGS)])
    return f"{local}@{domain}"


def altered(rng: random.Random, kind: int, span: str, words: list[str]) -> str:
    """A labelled span in a form that the patterns do not know."""
    if kind == 0:
        local, domain = other_address(rng, span, words).split("@", 1)
        return local + rng.choice(ATS) + domain.replace(".", rng.choice(DOTS))
    if kind == 1:
        return rng.choice(IP_GAPS).join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        digits, gap = other_digits(rng, re.sub("[^0-9]", "", span)), rng.choice(CARD_GAPS)
        return gap.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    parts = re.findall("[0-9]+", other_digits(rng, span))
    if len(parts) > 2 and rng.random() < 0.7:
        parts = parts[1:]
        if sum(map(len, parts)) < 8:
            parts = [rng.choice("123456789"), *parts]
    elif rng.random() < 0.5:
        parts[0] = "00" + parts[0]
    gap = rng.choice(PHONE_GAPS)
    if rng.random() < 0.4:
        return "(" + parts[0] + ")" + rng.choice((" ", "")) + gap.join(parts[1:])
    return gap.join(parts)


def nothing(rng: random.Random, words: list[str]) -> str:
    """A number, or words with an at, that is no personal data."""
    n = rng.randrange
    if rng.random() < 0.25:
        a, b, c = (rng.choice(words) for _ in range(3))
        return rng.choice((f"{a} at {b}.{c}", f"{a} at {b}. {c}", f"{a} at {n(24)}", f"{a} at the dot", f"{a} (at {n(99)})", f"@{a}", f"@ {a}",
                           f"{a} at the {b}"))
    return rng.choice((
        f"{1900 + n(140)}-{1 + n(12):02d}-{1 + n(28):02d}", f"{1 + n(28):02d}.{1 + n(12):02d}.{1900 + n(140)}",
        f"{1 + n(12)}/{1 + n(28)}/{1900 + n(140)}", f"{n(24):02d}:{n(60):02d}:{n(60):02d}", f"v{n(20)}.{n(20)}.{n(90)}",
        f"{n(900)},{n(1000):03d}.{n(100):02d}", f"{1900 + n(100)}-{1950 + n(100)}", f"978-{n(10)}-{n(100):02d}-{n(10 ** 6):06d}-{n(10)}",
        f"section {n(20)}.{n(20)}", f"{n(10 ** 6)}", f"{rng.getrandbits(64):x}", f"{rng.getrandbits(128):032x}", f"{n(10 ** 10)}",
        f"{n(10 ** 16):016d}", f"{n(300)} x {n(300)}", f"page {n(900)} of {n(900)}", f"{n(100)}.{n(100)} %", f"#{n(10 ** 5)}",
        f"{n(90)}.{n(10 ** 4):04d}, {n(90)}.{n(10 ** 4):04d}", f"{n(9)}, {n(99)}, {n(999)}, {n(99)}", f"97{8 + n(2)}{n(10 ** 10):010d}",
        f"978 {n(10)} {n(10 ** 4):04d} {n(10 ** 4):04d} {n(10)}", f"{1900 + n(140)}{1 + n(12):02d}{1 + n(28):02d}",
    ))


def examples(places: list[tuple[int, str, str, str]], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from places (kind, before, span, after): one run of text, cut like any other text.

    Seven of ten spans are put into plain text of other documents, so that their own surroundings are not what is learned.
    """
    rng = random.Random(seed)
    by_kind: dict[int, list] = {}
    for kind, *rest in places:
        by_kind.setdefault(kind, []).append(rest)
    each = TRAIN_PLACES // (len(KINDS) + 1)
    plain = by_kind.get(PLAIN, [])
    # Words of the places themselves stand for names and hosts.
    words = sorted({w for _, before, _, after in places for w in re.findall("[a-z]{2,12}", (before + " " + after).lower(), re.A)}) or ["a"]
    parts: list[tuple[int, str, str, str]] = []
    for kind, rows in sorted(by_kind.items()):
        # As many of every kind, whatever the table has; most of them altered.
        if kind == PLAIN:
            continue
        for i in range(each * (4 if kind < 0 else 2 if kind == 0 else 1)):
            before, span, after = rows[i % len(rows)]
            form = rng.random()
            if plain and rng.random() < 0.7:
                before, _, after = rng.choice(plain)
                before, after = before + rng.choice((" ", " ", ": ", "(", "\n")), rng.choice((" ", " ", ". ", ", ", ")", "\n")) + after
            if kind < 0:
                span = nothing(rng, words) if form < 0.7 else span
            elif form < 0.8:
                span = altered(rng, kind, span, words)
            elif kind == 0:
                span = other_address(rng, span, words)
            parts.append((kind, before, span, after))
    rng.shuffle(parts)
    text, spans, at = [], [], 0
    for kind, before, span, after in parts:
        if kind >= 0:
            spans.append((kind, at + len(before), at + len(before) + len(span)))
        text.append(before + span + after + "\n")
        at += len(text[-1])
    whole = "".join(text)
    chars = char_ids(whole)
    tags = tags_of(spans, 0, len(whole))
    starts = np.arange(0, len(whole) - WINDOW + 1, WINDOW * 3 // 4)
    cut = starts[:, None] + np.arange(WINDOW)
    return chars[cut], tags[cut]


def places_of(text: str) -> list[tuple[int, str, str, str]]:
    """Every base span with what stands around it up to the next one, every other trigger, and a piece of plain text."""
    out = []
    if text:
        mid = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) % len(text)
        a = text.find(" ", mid, mid + AROUND)
        before, after = text[max(0, a - AROUND):a], text[a + 1:a + AROUND]
        if a > 0 and not _TRIGGER.search(before + " " + after):
            out.append((PLAIN, before, "", after))
    spans = sorted(base_spans(text), key=lambda s: s[1:])
    free: list[tuple[int, int]] = []
    end = 0
    for i, (kind, a, b) in enumerate(spans):
        after = spans[i + 1][1] if i + 1 < len(spans) else len(text)
        if end <= a and b <= after and b - a <= WINDOW:
            out.append((kind, text[max(end, a - AROUND):a], text[a:b], text[b:min(after, b + AROUND)]))
        free.append((end, a))
        end = max(end, b)
    free.append((end, len(text)))
    for lo, hi in free:
        at = lo
        while m := _TRIGGER.search(text, at, hi):
            a, b = max(lo, m.start() - AROUND), min(hi, m.end() + AROUND)
            out.append((OTHER, text[a:m.start()], text[m.start():m.end()], text[m.end():b]))
            at = b
    return out


def training_places(docs: DataFrame, places: int = TRAIN_PLACES) -> list[tuple[int, str, str, str]]:
    """A bounded sample of different places, as many of each kind and without any."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(xxhash.xxh3_64_intdigest("\0".join(map(str, x)).encode("utf-8", "replace")) - (1 << 63), *x)
               for text in texts_of(batch.column("text")) for x in places_of(text)]
        types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)], names=["h", "kind", "before", "span", "after"])

    rows = map_batches(docs.select("text"), run, "h bigint, kind int, before string, span string, after string")
    rows = stored(rows.dropDuplicates(["h"]), "places")
    counts = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    # By hash, so that the choice is the same for the same texts, and about as many as asked for.
    wanted = F.lit(0)
    for kind, n in counts.items():
        wanted = F.when(F.col("kind") == kind, int(min(1.0, places // (len(KINDS) + 1) / n) * (1 << 30))).otherwise(wanted)
    mine = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < wanted)
    return [(r["kind"], r["before"], r["span"], r["after"]) for r in mine.orderBy("h").collect()]


def find(docs: DataFrame, places: int = TRAIN_PLACES, steps: int = STEPS) -> DataFrame:
    """doc_id, base and spans of every document, each an array of (kind, start, end)."""
    rows = id_text(docs)
    sample = training_places(rows, places)
    model = train(*examples(sample), steps) if any(kind >= 0 for kind, *_ in sample) else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def listed(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column("text"))
        base = [base_spans(t) for t in texts]
        found = model_spans(shared.value, texts) if shared.value is not None else [[]] * len(texts)
        spans = [reconcile(b, f, len(t)) for b, f, t in zip(base, found, texts)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([listed(b) for b in base], span_type), pa.array([listed(s) for s in spans], span_type)],
            names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return map_batches(rows, run, f"doc_id bigint, base {kind}, spans {kind}")
