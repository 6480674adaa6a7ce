"""Vector expressions in double precision, by higher-order functions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Clamped to [0, 1]; 0 for empty vectors, unequal lengths or no length to speak of."""
    denom = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    sound = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (denom >= 1.1920929e-07)
    return F.when(sound, F.least(F.greatest(dot(a, b) / denom, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
