"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def filled(a: Column | str, size: int) -> Column:
    """The vector, or one without length where there is none or one of another size, as for texts that weren't embedded;
    its cosine with anything is 0."""
    return F.when(F.coalesce(F.size(col(a)), F.lit(-1)) == size, col(a)).otherwise(F.array_repeat(F.lit(0.0).cast("float"), size))
