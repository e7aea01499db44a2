"""Vectors as columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null for a null or zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def hashed_words(text: Column, dimension: int = 64) -> Column:
    """A stand-in for an embedding model: word counts in hash buckets, of unit length. Buckets, counts and their length are each computed once."""
    buckets = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)))
    counted = lambda found: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(found, lambda b: b == i)).cast("double"))
    unit = lambda c: let(norm(c), lambda n: F.transform(c, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))
    return let(buckets, lambda found: let(counted(found), unit))
