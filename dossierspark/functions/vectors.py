"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where a vector is null or the lengths differ."""
    length = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length))


def best_cosine(query: Column, *vectors: Column) -> Column:
    """The larger similarity over several embeddings; -1 for one that is missing."""
    scores = [F.coalesce(cosine(query, v), F.lit(-1.0)) for v in vectors]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]
