"""Feature ids: text hashed into a bucket range of its own."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Namespace:
    """``size`` ids starting at ``offset``; disjoint namespaces cannot collide."""

    name: str
    size: int
    offset: int = 0


def text_hash(text: Column, method: str = "xxhash64") -> Column:
    """A long for a string; null for null. ``md5`` is slower but known to every engine."""
    if method == "xxhash64":
        return F.when(text.isNotNull(), F.xxhash64(text))
    if method == "md5":
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    raise ValueError(f"unknown hash method {method!r}")


def bucket(text: Column, space: Namespace, method: str = "xxhash64") -> Column:
    return F.pmod(text_hash(text, method), F.lit(space.size).cast("bigint")) + F.lit(
        space.offset
    ).cast("bigint")


# --- md5 of many texts at once -----------------------------------------------------------

_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_ADDED = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SIDE = 8192  # texts side by side: their words stay in the processor's cache
_FEW = 256  # so few are hashed one by one
_BLOCKS = 2  # and so are texts of more blocks of 64 bytes


def _md5_first(words: np.ndarray) -> np.ndarray:
    """The first word of the md5 of padded texts, given as (16 for each block, texts) of words."""
    state = [np.full(words.shape[1], x, np.uint32) for x in _START]
    for block in words.reshape(-1, 16, words.shape[1]):
        a, b, c, d = (x.copy() for x in state)
        empty = ~block.any(axis=1)
        f, low = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            f += _ADDED[i]
            if not empty[_WORDS[i]]:
                f += block[_WORDS[i]]
            np.right_shift(f, np.uint32(32 - _TURNS[i]), out=low)
            f <<= np.uint32(_TURNS[i])
            f |= low
            f += b
            a, f, d, c, b = d, a, c, b, f
        for x, y in zip(state, (a, b, c, d)):
            x += y
    return state[0]


def md5_numbers(texts: pa.Array) -> np.ndarray:
    """``text_hash(text, "md5")`` of each text of an Arrow array; a null has some number or other."""
    texts = texts.cast(pa.large_string())
    out = np.zeros(len(texts), np.int64)
    if not len(texts):
        return out
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    lengths = np.diff(ends)
    blocks = (lengths + 8) // 64 + 1
    for many in range(1, _BLOCKS + 1):
        own = np.flatnonzero(blocks == many)
        if len(own) < _FEW:
            continue
        blocks[own] = 0
        for at in range(0, len(own), _SIDE):
            some = own[at:at + _SIDE]
            n = lengths[some]
            rows = np.zeros((len(some), 64 * many), np.uint8)
            lines = np.arange(len(some))
            before = np.cumsum(n) - n
            within = np.arange(n.sum())
            rows.ravel()[np.repeat(lines * 64 * many - before, n) + within] = data[np.repeat(ends[some] - before, n) + within]
            rows[lines, n] = 128
            rows.view("<u4")[:, -2] = n * 8
            out[some] = _md5_first(np.ascontiguousarray(rows.view("<u4").T)).byteswap()
    for k in np.flatnonzero(blocks):
        digest = hashlib.md5(data[ends[k]:ends[k + 1]].tobytes(), usedforsecurity=False).digest()
        out[k] = int.from_bytes(digest[:4], "big")
    return out
