"""Vector columns: dot, cosine, distances. Empty or null vectors give null."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d)


def max_abs_diff(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def has_vector(v: Column) -> Column:
    return F.coalesce(F.size(v) > 0, F.lit(False))


def stable_u32(term: Column | str) -> Column:
    """Unsigned 32-bit BLAKE2b of a term, little-endian. Use it on distinct terms."""
    return F.arrow_udf(_u32, "long")(term)


def _u32(terms: pa.Array) -> pa.Array:
    return pa.array([None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "little") for t in terms.to_pylist()], pa.int64())


def hashed_dimension(term: Column, dims: int) -> Column:
    """Where the offline embedder counts a term."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(dims))
