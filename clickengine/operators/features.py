"""Sparse features: groups of (hashed id, value) pairs built from columns.

A group is a Python list of ``Feature``; only ``as_map`` turns groups into a column, so
a whole feature set is one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import Namespace, bucket, md5_numbers, text_hash

FEATURE_MAP = "map<bigint,double>"


@dataclass(frozen=True)
class Feature:
    """A value under the hash of ``text`` within ``space``, or under a given ``number``."""

    value: Column
    text: Column | None = None
    space: Namespace | None = None
    method: str = "xxhash64"
    number: Column | None = None

    @property
    def key(self) -> Column:
        if self.number is not None:
            return self.number
        return bucket(self.text, self.space, self.method)


def prefixed(columns: dict[str, str]) -> list[Column]:
    """``{column: prefix}`` to texts such as ``c1-1005``."""
    return [F.concat(F.lit(p), F.col(c).cast("string")) for c, p in columns.items()]


def indicators(texts: list[Column], space: Namespace, method: str = "xxhash64") -> list[Feature]:
    """Each text as a feature of value 1."""
    return [Feature(F.lit(1.0), t, space, method) for t in texts]


def named_values(
    values: dict[str, Column], space: Namespace, method: str = "xxhash64"
) -> list[Feature]:
    """Numbers under the hash of their names."""
    return [Feature(v.cast("double"), F.lit(name), space, method) for name, v in values.items()]


def numbered(number: int, value: Column) -> Feature:
    """A value under an id of its own."""
    return Feature(value.cast("double"), number=F.lit(number).cast("bigint"))


def crossed_values(
    group: list[Feature], texts: list[Column], space: Namespace, method: str = "xxhash64"
) -> list[Feature]:
    """Every feature of ``group`` with every text, carrying the feature's value.

    The key is made of the feature id and the text, not of the value.
    """
    out = []
    for f in group:
        lead = F.concat(F.lit("t"), f.key.cast("string"))
        out += [Feature(f.value, F.concat(lead, t), space, method) for t in texts]
    return out


def crossed_tag(
    group: list[Feature], tag: Column, space: Namespace, method: str = "xxhash64"
) -> list[Feature]:
    """Every feature of ``group`` with one tag (such as the hour), of value 1."""
    tail = F.concat(F.lit("+"), tag.cast("string"))
    return [
        Feature(F.lit(1.0), F.concat(f.key.cast("string"), tail), space, method) for f in group
    ]


def vector_entries(
    vector: str | Column, size: int, space: Namespace, prefix: str = "t", method: str = "xxhash64"
) -> list[Feature]:
    """The entries of an array of ``size`` doubles as named features."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return named_values({f"{prefix}{i}": F.get(vector, F.lit(i)) for i in range(size)}, space, method)


def as_map(*groups: list[Feature]) -> Column:
    """Merge groups into one map; a later feature replaces an earlier one of the same id.

    Features with a null id or value are left out. The texts are hashed by one expression
    over the array of features: an expression per feature makes generated methods too
    large for the JVM to compile. Under md5 whole batches are hashed side by side.
    """
    features = [f for group in groups for f in group]
    methods = {f.method for f in features if f.number is None}
    if len(methods) > 1:
        raise ValueError("features of one map must share a hash method")
    given = any(f.number is not None for f in features)
    if methods == {"md5"} and not given:
        return _md5_map(features)
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def entry(f: Feature) -> Column:
        fields = [f.value.alias("v")]
        if methods:
            space = f.space or Namespace("given", 1)
            fields += [(no_text if f.text is None else f.text).alias("t"),
                       F.lit(space.size).cast("bigint").alias("size"),
                       F.lit(space.offset).cast("bigint").alias("offset")]
        if given:
            fields.append((no_number if f.number is None else f.number).alias("number"))
        return F.struct(*fields)

    def keyed(e: Column) -> Column:
        keys = [e["number"]] if given else []
        if methods:
            keys.append(F.pmod(text_hash(e["t"], next(iter(methods))), e["size"]) + e["offset"])
        return F.struct((F.coalesce(*keys) if len(keys) > 1 else keys[0]).alias("k"), e["v"].alias("v"))

    pairs = F.transform(F.array(*[entry(f) for f in features]), keyed)
    present = F.filter(pairs, lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    return F.map_from_entries(present).cast(FEATURE_MAP)


def _md5_map(features: list[Feature]) -> Column:
    """``as_map`` of texts under md5."""
    spaces = [(f.space.size, f.space.offset) for f in features]

    @F.arrow_udf(FEATURE_MAP)
    def hashed(texts: pa.Array, values: pa.Array) -> pa.Array:
        return last_wins(texts.flatten(), values.flatten(), spaces)

    return hashed(F.array(*[f.text for f in features]), F.array(*[f.value.cast("double") for f in features]))


def last_wins(texts: pa.Array, values: pa.Array, spaces: list[tuple[int, int]]) -> pa.Array:
    """Maps of rows of ``len(spaces)`` texts and values each, one row after another.

    An id stands where it came first, with the value that came last.
    """
    sizes, offsets = np.array(spaces, np.int64).T
    many = len(spaces)
    keys = md5_numbers(texts).reshape(-1, many) % sizes + offsets
    present = ~(np.asarray(texts.is_null()) | np.asarray(values.is_null())).reshape(-1, many)
    # Id and place in one number; of an id's places the first says where it stands, the last has the value.
    bits = many.bit_length()
    nowhere = np.int64(np.iinfo(np.int64).max)
    sorted_ = np.sort(np.where(present, (keys << bits) | np.arange(many), nowhere), axis=1)
    own, places = sorted_ >> bits, sorted_ & ((1 << bits) - 1)
    begins, ends = np.ones((2, *own.shape), bool)
    begins[:, 1:] = ends[:, :-1] = own[:, 1:] != own[:, :-1]
    begins &= sorted_ != nowhere
    ends &= sorted_ != nowhere
    lines, first, last = np.nonzero(begins)[0], places[begins], places[ends]
    spots = np.full(own.size, -1)
    spots[lines * many + first] = np.arange(len(lines))
    order = spots[spots >= 0]
    lengths = np.zeros(len(own) + 1, np.int32)
    np.cumsum(begins.sum(axis=1), out=lengths[1:])
    chosen = values.take(pa.array((lines * many + last)[order]))
    return pa.MapArray.from_arrays(pa.array(lengths), pa.array(own[begins][order]), chosen)


def merged(*maps: str | Column) -> Column:
    """Merge map columns; the later map wins. Needs the LAST_WIN map key policy."""
    return F.map_concat(*maps)


def exploded(examples: DataFrame, keys: list[str], features: str = "features") -> DataFrame:
    """(keys, feature, value), keeping an example without features as one row of nulls."""
    return examples.select(*keys, F.explode_outer(features).alias("feature", "value"))


def one_hot(df: DataFrame, keys: list[str], texts: list[Column]) -> DataFrame:
    """(keys, name, value=1) rows of unhashed categories."""
    pairs = F.array(*[F.struct(t.alias("name"), F.lit(1.0).alias("value")) for t in texts])
    return df.select(*keys, F.inline(pairs)).where(F.col("name").isNotNull())
