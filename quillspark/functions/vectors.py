"""Column functions over float vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """Divided by the norm, or by 1e-12 if that is smaller. The norm is computed once: it is bound, then used for each component."""
    bound = F.transform(F.array(F.greatest(norm(a), F.lit(1e-12))), lambda n: F.transform(a, lambda x: x.cast("double") / n))
    return F.get(bound, F.lit(0))
