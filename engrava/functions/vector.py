"""Vector expressions on array columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sanitized(a: Column) -> Column:
    """NaN, infinities and nulls become 0."""
    return F.transform(a, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), F.lit(0.0)).otherwise(x.cast("double")))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def quantized(a: Column) -> Column:
    """(scale, values): int8 with one scale for the vector."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127.0).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(a, lambda x: F.rint(x.cast("double") / scale).cast("int")).alias("values"))


def well_formed(a: Column, width: int) -> Column:
    """True for ``width`` finite values that are not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return a.isNotNull() & (F.size(a) == width) & F.forall(a, fine) & F.exists(a, lambda x: x != 0)
