"""Secrets by fixed patterns and a linear-chain conditional random field over tokens, trained here.

Patterns give the base spans of three kinds: ``assign``, ``access``, ``hex``. The model adds spans of the kind ``tagged`` that
overlap none of them. It tags every token of every text as begin, inside or outside of a secret. A token is a run of letters,
digits and _ (non-ASCII characters count as letters), or any other visible character by itself. What a tag scores comes
from the token's shape (length, kinds of characters, how often they change, whether it touches its neighbours), its word, shapes and
words of its neighbours, the nearest word before it, and features of the whole text (how many = and digits it has), plus a weight for the step from tag to tag.

The weights are fitted in numpy on at most about ``TRAIN_TEXTS`` texts, chosen by hash: windows of about ``WINDOW`` tokens, labelled by
the patterns (without runs of digits only), and the same windows with a made-up secret or a harmless lookalike put in, introduced in
ways the patterns do not know ("the passphrase is ..."). So the model is trained on whatever texts there are.

Viterbi decoding is exact and whole: a token whose score for outside leads by more than any two steps can make good is outside on
every best path; the runs of tokens between such tokens are decoded side by side.

Null and empty texts have no spans. Texts are read whole, in linear time. Repeated rows and equal or null ids get the same spans.
An empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_batches, texts_of

KINDS = ("assign", "access", "hex", "tagged")
TRAIN_TEXTS = 6000
WINDOW = 40
STEPS = 500
WORDS = 1 << 13
CHUNK = 1 << 20
O, B, I = 0, 1, 2

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and kind."""
    out: list[Span] = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# --- tokens and features --------------------------------------------------------------------

_SPACE, _WORD, _MARK = 0, 1, 2


def _ascii_table(default: int, **sets: str) -> np.ndarray:
    out = np.full(129, default, np.uint8)  # the last for all other characters
    for value, letters in sets.items():
        for c in letters:
            out[ord(c)] = int(value[1:])
    return out


_KIND = np.full(129, _MARK, np.uint8)
_KIND[[ord(c) for c in string.ascii_letters + string.digits + "_"] + [128]] = _WORD
_KIND[[*range(0x21), 0x7F]] = _SPACE
# 1 digit, 2 lower a-f, 3 other lower, 4 upper, 5 anything else
_CHAR = _ascii_table(5, v1=string.digits, v2="abcdef", v3="ghijklmnopqrstuvwxyz", v4=string.ascii_uppercase)
_LOWER = np.arange(129, dtype=np.uint64)
_LOWER[65:91] += 32
_LENGTHS = np.array([2, 4, 8, 12, 16, 24, 40])  # where a new length class begins
_ROOT = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    inverse = pow(_ROOT, -1, 1 << 64)
    out = []
    for root in (_ROOT, inverse):
        factors = np.full(n, root, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return out[0], out[1]


N_FILE = 16
SHAPES = 10 * 8 * 4
SIZES = (SHAPES, WORDS, SHAPES, SHAPES, WORDS, WORDS, WORDS, WORDS, 8 * WORDS, N_FILE, 4 * SHAPES)
_OFFSETS = np.cumsum([0, *SIZES])


class Tokens:
    """Tokens of some texts: place in their text, which text, and the numbers of their features (tokens x features)."""

    def __init__(self, texts: list[str], files: list[int] | None = None) -> None:
        joined = "\n".join(texts) + "\n"
        codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), 128)
        ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
        kind = _KIND[codes]
        word = kind == _WORD
        after = np.append(word[1:], False)
        before = np.concatenate([[False], word[:-1]])
        starts = np.flatnonzero((kind == _MARK) | (word & ~before))
        ends = np.flatnonzero((kind == _MARK) | (word & ~after)) + 1
        self.text = np.searchsorted(ends_of_texts, starts, side="right")
        char = _CHAR[codes]
        begins = ends_of_texts - np.array([len(t) + 1 for t in texts])
        self.files = self._files(codes, char, begins, ends_of_texts) if files is None else np.array(files, np.int64)
        shape, size = self._shapes(char, starts, ends)
        # Words with digits count by their shape only, so that no secret is learned by heart.
        digits = np.concatenate([[0], np.cumsum(char == 1, dtype=np.int32)])
        words = np.where(digits[ends] == digits[starts], self._words(codes, starts, ends), 0)
        self.starts, self.ends = starts - begins[self.text], ends - begins[self.text]
        self.features = self._features(shape, size, words, word[starts])

    @staticmethod
    def _files(codes, char, begins, ends) -> np.ndarray:
        def share(flags: np.ndarray, levels: list[float]) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return np.searchsorted(levels, (total[ends] - total[begins]) / (ends - begins), side="right")

        return share(codes == ord("="), [1e-9, 0.002, 0.01]) * 4 + share(char == 1, [1e-9, 0.01, 0.05])

    @staticmethod
    def _shapes(char, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        length = ends - starts
        held = []
        for value in (1, 2, 3, 4, 5):
            total = np.concatenate([[0], np.cumsum(char == value, dtype=np.int32)])
            held.append(total[ends] - total[starts])
        digit, low_hex, low, upper, other = (h > 0 for h in held)
        turns = np.concatenate([[0], np.cumsum(char[1:] // 2 != char[:-1] // 2, dtype=np.int32), [0]])
        turns = np.searchsorted([1, 3, 6], turns[ends - 1] - turns[starts], side="right")
        letters = low_hex | low
        first_upper = char[starts] == 4
        # Fixed classes, the first that holds.
        classes = [other, digit & ~letters & ~upper, digit & low_hex & ~low & ~upper, digit & letters & ~upper, digit & upper & ~letters,
                   digit & upper & letters, upper & ~letters, letters & ~upper, first_upper & (held[3] == 1)]
        kind = np.select(classes, range(len(classes)), len(classes))
        size = np.searchsorted(_LENGTHS, length, side="right")
        return (kind * 8 + size) * 4 + turns, size

    @staticmethod
    def _words(codes, starts, ends) -> np.ndarray:
        power, inverse = _powers(1 << max(len(codes) - 1, CHUNK).bit_length())
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((_LOWER[codes] + np.uint64(1)) * power[:len(codes)], dtype=np.uint64, out=total[1:])
        mixed = (total[ends] - total[starts]) * inverse[starts]
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 13)).astype(np.int64)

    def _features(self, shape, size, words, is_word) -> np.ndarray:
        n = len(shape)
        at = np.arange(n)

        def beside(values: np.ndarray, step: int, none: int = 0) -> np.ndarray:
            place = np.clip(at + step, 0, max(n - 1, 0))
            same = (at + step >= 0) & (at + step < n)
            same[same] = self.text[place[same]] == self.text[same]
            return np.where(same, values[place], none) if n else values

        last_word = np.maximum.accumulate(np.where(is_word, at, -1)) if n else at
        nearest = np.concatenate([[-1], last_word[:-1]]) if n else at
        known = nearest >= 0
        known[known] = self.text[nearest[known]] == self.text[known]
        named = np.where(known, words[nearest], 0) if n else words
        gap = self.starts[1:] > self.ends[:-1]
        gap |= self.text[1:] != self.text[:-1]
        touches = 2 * np.append(~gap, False)[:n] + np.concatenate([[False], ~gap])[:n]
        columns = [shape, words, beside(shape, -1), beside(shape, 1), beside(words, -1), beside(words, -2), beside(words, 1),
                   named, named * 8 + size, self.files[self.text] if n else shape, shape * 4 + touches]
        return np.stack([c + o for c, o in zip(columns, _OFFSETS)], axis=1)


# --- the model ------------------------------------------------------------------------------


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def gradient(weights: np.ndarray, move: np.ndarray, features: np.ndarray, tags: np.ndarray, used: np.ndarray):
    """Loss per window, and what it gives for the scores (windows, steps, tags) and the steps between tags.

    A window is preceded and followed by outside; ``used`` marks its tokens, which come first.
    """
    n, steps, _ = features.shape
    scores = weights[features].sum(axis=2) * used[:, :, None]
    forward, backward = np.empty((steps, n, 3)), np.empty((steps, n, 3))
    forward[0] = scores[:, 0] + move[O]
    for t in range(1, steps):
        step = _log_sum(forward[t - 1][:, :, None] + move, 1) + scores[:, t]
        forward[t] = np.where(used[:, t, None], step, forward[t - 1])
    total = _log_sum(forward[-1] + move[:, O], 1)
    backward[-1] = move[:, O]
    for t in range(steps - 2, -1, -1):
        step = _log_sum((backward[t + 1] + scores[:, t + 1])[:, None, :] + move, 2)
        backward[t] = np.where(used[:, t + 1, None], step, move[:, O])
    likely = np.exp(forward + backward - total[None, :, None])
    ds = likely.transpose(1, 0, 2).copy()
    np.put_along_axis(ds, tags[:, :, None], np.take_along_axis(ds, tags[:, :, None], 2) - 1, 2)
    ds *= used[:, :, None]
    moved = np.zeros((3, 3))
    moved[O] += likely[0].sum(axis=0)
    last = used.sum(axis=1) - 1
    rows = np.arange(n)
    moved[:, O] += likely[last, rows].sum(axis=0)
    for t in range(1, steps):
        joint = forward[t - 1][:, :, None] + move + (scores[:, t] + backward[t])[:, None, :] - total[:, None, None]
        moved += (np.exp(joint) * used[:, t, None, None]).sum(axis=0)
    np.subtract.at(moved, (np.full(n, O), tags[:, 0]), 1)
    np.subtract.at(moved, (tags[rows, last], np.full(n, O)), 1)
    pairs = used[:, 1:]
    np.subtract.at(moved, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
    said = (np.take_along_axis(scores, tags[:, :, None], 2)[:, :, 0] * used).sum(axis=1) + move[O, tags[:, 0]] + move[tags[rows, last], O]
    said = said + (move[tags[:, :-1], tags[:, 1:]] * pairs).sum(axis=1)
    return float((total - said).mean()), ds / n, moved / n


def train(features: np.ndarray, tags: np.ndarray, used: np.ndarray, steps: int = STEPS, batch: int = 128):
    """Adam over shuffled batches of windows, the same number of steps for any sample; (weights, move) in single precision."""
    parameters = [np.zeros((int(_OFFSETS[-1]), 3)), np.zeros((3, 3))]
    mean, square = ([np.zeros_like(p) for p in parameters] for _ in range(2))
    rng = np.random.default_rng(7)
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(features))
        some, order = order[:batch], order[batch:]
        _, ds, moved = gradient(*parameters, features[some], tags[some], used[some])
        flat = features[some].reshape(-1)
        wide = np.repeat(ds.reshape(-1, 3), features.shape[2], axis=0)
        grad = np.stack([np.bincount(flat, wide[:, k], len(parameters[0])) for k in range(3)], axis=1)
        rate = 0.1 * (1 - step / steps) + 0.002
        for k, g in enumerate((grad, moved)):
            g = g + 1e-4 * parameters[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            parameters[k] -= rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    return parameters[0].astype(np.float32), parameters[1].astype(np.float32)


def slack(move: np.ndarray) -> np.ndarray:
    """By how much the steps to and from a tag can at most outdo those to and from outside, for begin and inside."""
    ways = move[:, :, None] + move[None, :, :]  # from, tag, to
    return np.array([(ways[:, t] - ways[:, O]).max() for t in (B, I)])


def decode(scores: np.ndarray, move: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Best tags (Viterbi) of the tokens of each text, outside before and after it."""
    scores, move = scores.astype(np.float64), move.astype(np.float64)
    tags = np.zeros(len(scores), np.int8)
    open_ = (scores[:, O, None] - scores[:, 1:] <= slack(move) + 1e-6).any(axis=1)
    places = np.flatnonzero(open_)
    if not len(places):
        return tags
    new = np.concatenate([[True], (np.diff(places) > 1) | (np.diff(text[places]) > 0)])
    first = np.flatnonzero(new)
    lengths = np.diff(np.append(first, len(places)))
    order = np.argsort(-lengths, kind="stable")
    first, lengths = first[order], lengths[order]
    own = scores[places]
    back = np.zeros((len(places), 3), np.int8)
    best = own[first] + move[O]
    for step in range(1, int(lengths[0])):
        live = int(np.searchsorted(-lengths, -step))  # runs longer than ``step``
        ways = best[:live, :, None] + move
        back[first[:live] + step] = ways.argmax(axis=1)
        best[:live] = ways.max(axis=1) + own[first[:live] + step]
    now = (best + move[:, O]).argmax(axis=1)
    found = np.zeros(len(places), np.int8)
    for step in range(int(lengths[0]) - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -step))
        found[first[:live] + step] = now[:live]
        now[:live] = back[first[:live] + step, now[:live]]
    tags[places] = found
    return tags


def tagged(model: tuple[np.ndarray, np.ndarray], texts: list[str]) -> list[list[tuple[int, int]]]:
    """(start, end) of the secrets that the model finds in each text."""
    weights, move = model
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    tokens = Tokens(texts)
    scores = weights[tokens.features[:, 0]]
    for k in range(1, tokens.features.shape[1]):
        scores = scores + weights[tokens.features[:, k]]
    tags = decode(scores, move, tokens.text)
    inside = np.flatnonzero(tags)
    if not len(inside):
        return out
    new = np.concatenate([[True], (np.diff(inside) > 1) | (np.diff(tokens.text[inside]) > 0)]) | (tags[inside] == B)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    for a, b in zip(inside[first], inside[last]):
        out[tokens.text[a]].append((int(tokens.starts[a]), int(tokens.ends[b])))
    return out


# --- training windows -----------------------------------------------------------------------

# Ways to introduce a secret, harmless phrases of the same look, and what secrets are called.
SAYINGS = ("{name} is {v}", "{name} : {v}", '{name} => "{v}"', "Bearer {v}", "export {NAME}={v}", "<{name}>{v}</{name}>",
           "--{name} {v}", "my {name} , {v} ,", "{name} {v}", "{v}", "'{name}' -> '{v}'", "use {v} as {name}")
CALLED = ("password", "passwd", "pwd", "passphrase", "secret", "client secret", "token", "access token", "api key", "key",
         "private key", "credential", "auth", "login")
HARMLESS = ("{name} is required", "{name} : none", "the {name} expires", "order {d}", "call {d}", "on {date}", "at {ip}", "see {url}",
            "write to {mail}", "card {d}", "page {d} of {d}", "{name} count = {d}", "version {ip}", "{word}", "{word} : {word}")


def made_secret(rng: random.Random) -> str:
    digits, lower, upper = string.digits, string.ascii_lowercase, string.ascii_uppercase

    def drawn(letters: str, least: int, most: int) -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))

    kind = rng.randrange(8)
    if kind == 0:
        return drawn("0123456789abcdef", 12, 48)
    if kind == 1:
        return drawn(digits + lower + upper + "+/", 16, 48) + "=" * rng.randrange(3)
    if kind == 2:
        return drawn(digits + lower + upper, 14, 40)
    if kind == 3:
        return rng.choice(("sk-", "ghp_", "xoxb-", "pk_live_", "glpat-")) + drawn(digits + lower + upper, 16, 40)
    if kind == 4:
        return drawn(digits + lower + upper + "-_", 16, 40)
    if kind == 5:
        return drawn(digits + upper, 16, 24)
    if kind == 6:
        return "-".join(drawn("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12))
    return drawn(lower, 3, 7) + drawn(digits, 2, 4) + rng.choice("_-.") + drawn(upper, 2, 5) + drawn(digits + lower, 2, 6)


def planted(text: str, rng: random.Random, words: list[str], harmless: bool) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with a secret or a lookalike put in at a word's border, and where the secret stands."""
    borders = [0] + [m.end() for m in re.finditer(r"\s", text)]
    at = rng.choice(borders)
    saying, value = rng.choice(HARMLESS if harmless else SAYINGS), made_secret(rng)
    name = rng.choice(CALLED)
    if "{v}" in saying and "{name}" not in saying.lower() and saying != "Bearer {v}":
        while len(value) < 20 or not any(c.isdigit() for c in value):
            value = made_secret(rng)
    number = "".join(rng.choice(string.digits) for _ in range(rng.choice((2, 4, 8, 11, 16, 19))))
    facts = {
        "name": name, "NAME": name.upper().replace(" ", "_"), "v": "\0", "d": number,
        "date": f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        "ip": ".".join(str(rng.randrange(256)) for _ in range(4)), "word": "".join(rng.sample(words, min(3, len(words))))[:40],
        "url": f"https://{rng.choice(words)}.org/{rng.choice(words)}/{rng.choice(words)}{rng.randrange(99)}",
        "mail": f"{rng.choice(words)}@{rng.choice(words)}.com",
    }
    said = saying.format(**facts)
    head, hole, tail = said.partition("\0")
    out = f"{text[:at]}{head}{value if hole else ''}{tail} {text[at:]}"
    spans = [(at + len(head), at + len(head) + len(value))] if hole else []
    return out, spans


def secret_values(text: str) -> list[tuple[int, int]]:
    """What of the base spans is the secret: without its name, and no run of digits only."""
    out = []
    for start, kind, end in base_spans(text):
        if kind == 0:
            start = end - len(_ASSIGN.match(text, start).group(2))
        if not text[start:end].isdigit():
            out.append((start, end))
    return out


def window_of(text: str, place: int) -> tuple[str, list[tuple[int, int]]]:
    """About ``WINDOW`` tokens around a place, and the secrets in them; text with no space is cut at 8 characters a word."""
    borders = [m.start() for m in re.finditer(r"\s", text[max(0, place - 8 * WINDOW):place + 8 * WINDOW])]
    base = max(0, place - 8 * WINDOW)
    before = [base + b + 1 for b in borders if base + b < place][-(WINDOW // 3):]
    after = [base + b for b in borders if base + b >= place][:WINDOW // 3]
    start = before[0] if before else base
    end = after[-1] if after else min(len(text), place + 8 * WINDOW)
    return text[start:end], [(max(a, start) - start, min(b, end) - start) for a, b in secret_values(text) if a < end and b > start]


def labelled(windows: list[tuple[str, int, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, tags and used places of windows given as (text, file feature, secrets)."""
    steps = 3 * WINDOW
    tokens = Tokens([w[0] for w in windows], [w[1] for w in windows])
    at = np.searchsorted(tokens.text, np.arange(len(windows) + 1))
    features = np.zeros((len(windows), steps, len(SIZES)), np.int64)
    tags = np.zeros((len(windows), steps), np.int64)
    used = np.zeros((len(windows), steps), bool)
    for k, (_, _, spans) in enumerate(windows):
        own = slice(at[k], min(at[k + 1], at[k] + steps))
        n = own.stop - own.start
        features[k, :n], used[k, :n] = tokens.features[own], True
        for a, b in spans:
            hit = np.flatnonzero((tokens.starts[own] < b) & (tokens.ends[own] > a))
            tags[k, hit] = I
            tags[k, hit[:1]] = B
    some = used.any(axis=1)
    return features[some], tags[some], used[some]


def training_windows(docs: DataFrame, texts: int = TRAIN_TEXTS) -> list[tuple[str, int, list[tuple[int, int]]]]:
    """Windows of about ``texts`` texts, chosen by hash: as they are, with a secret put in, and with a lookalike."""
    share = min(1.0, texts / max(docs.count(), 1))
    key = F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64))
    some = docs.where(F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in texts_of(batch.column("text")):
            if not text.strip():
                continue
            rng = random.Random(len(text) * 1_000_003 + sum(map(ord, text[:64])))
            file = int(Tokens([text]).files[0])
            values = secret_values(text)
            places = {rng.randrange(len(text))} | {rng.choice(values)[0] for _ in values[:2]}
            out += [(file, *window_of(text, place)) for place in sorted(places)]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string()),
             pa.array([[y for z in x[2] for y in z] for x in out], pa.list_(pa.int32()))], names=["file", "text", "spans"])

    rows = map_batches(some.select("text"), run, "file int, text string, spans array<int>").dropDuplicates(["text"]).collect()
    rows.sort(key=lambda r: (r["text"], r["file"]))
    return with_plants([(r["text"], r["file"], list(zip(r["spans"][::2], r["spans"][1::2]))) for r in rows], seed=3)


def with_plants(windows: list[tuple[str, int, list[tuple[int, int]]]], seed: int) -> list[tuple[str, int, list[tuple[int, int]]]]:
    """The windows, those without a secret also with one put in, and with a lookalike."""
    rng = random.Random(seed)
    words = sorted({w for text, _, _ in windows for w in re.findall(r"[^\W\d_]{2,}", text)[:20]}) or ["word"]
    out = list(windows)
    for text, file, spans in windows:
        if not spans:
            for harmless in (False, True):
                # In other cases too, so that capitals alone say nothing.
                cased = rng.choice((str, str, str.title, str.upper, str.lower))(text)
                new, where = planted(cased, rng, words, harmless)
                out.append((new, file, where))
    return out


# --- over texts -----------------------------------------------------------------------------


def with_added(base: list[Span], found: list[tuple[int, int]]) -> list[Span]:
    """Base spans, and the model's that overlap none of them, by start and kind."""
    out = list(base)
    taken = sorted((a, b) for a, _, b in base)
    k = 0
    for a, b in found:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        # Base spans may overlap each other, so look at all that begin before the end.
        j = k
        while j < len(taken) and taken[j][0] < b and taken[j][1] <= a:
            j += 1
        if j == len(taken) or taken[j][0] >= b:
            out.append((a, 3, b))
    return sorted(out)


def find(docs: DataFrame, texts: int = TRAIN_TEXTS) -> DataFrame:
    """doc_id, base and spans of every document, each an array of (kind, start, end) by start."""
    rows = id_text(docs)
    windows = training_windows(rows, texts)
    model = train(*labelled(windows)) if windows else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def listed(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column("text"))
        base = [base_spans(t) for t in texts]
        spans = base
        if shared.value is not None:
            spans = []
            at = 0
            while at < len(texts):
                size, end = len(texts[at]), at + 1
                while end < len(texts) and size + len(texts[end]) <= CHUNK:
                    size += len(texts[end])
                    end += 1
                spans += [with_added(b, f) for b, f in zip(base[at:end], tagged(shared.value, texts[at:end]))]
                at = end
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([listed(b) for b in base], span_type), pa.array([listed(s) for s in spans], span_type)],
            names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return map_batches(rows, run, f"doc_id bigint, base {kind}, spans {kind}")
