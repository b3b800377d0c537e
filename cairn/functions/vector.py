"""Distances and embeddings as column expressions; sums are made in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "dot")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """A vector of length 0 is at distance 1 from all; null where an element or a place is missing."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - F.try_divide(dot(a, b), size))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Smaller is nearer; l2 is squared. Null for vectors that are null, of other sizes, or hold null."""
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    return squared_l2(a, b) if metric == "l2" else cosine_distance(a, b) if metric == "cosine" else 1 - dot(a, b)


def score(dist: Column) -> Column:
    return 1 - dist


def pad(v: Column, dims: int) -> Column:
    """v with zeros at its end up to dims; longer ones raise an error."""
    short = F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(dims) - F.size(v))))
    return F.when(F.size(v) <= dims, short).otherwise(F.raise_error(F.concat(F.lit(f"a vector has over {dims} dimensions: "), F.size(v).cast("string"))).cast("array<float>"))


def hash_vector(text: Column, dims: int) -> Column:
    """The offline embedding: bytes of the text's SHA-256 in turn, taken to -1..1, at length 1."""
    # Each step's value is bound by a lambda over an array of one, so that no element makes it anew.
    given = lambda value, then: F.transform(F.array(value), then)[0]
    byte = lambda h, i: F.conv(F.substring(h, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double")
    raw = given(F.sha2(text.cast("binary"), 256), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: byte(h, i) / 255 * 2 - 1))
    return given(raw, lambda r: given(F.sqrt(_sum(F.transform(r, lambda x: x * x))), lambda n: F.transform(r, lambda x: (x / n).cast("float"))))
