"""Vector expressions that stay inside the JVM; bulk search is in operators.vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is, one with a value that is not finite gives null."""
    norm = F.sqrt(inner_product(v, v))
    return F.when(finite(v), F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") / norm))).otherwise(F.transform(v, lambda x: x.cast("double"))))
