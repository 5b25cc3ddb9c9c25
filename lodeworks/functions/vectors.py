"""Column functions on embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, summed in double, in [-1, 1]; 0 if either is zero; vectors of unequal length are an error."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    value = F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm)))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def cosine_to(vector: Column, probe: list[float]) -> Column:
    """Cosine to one probe whose norm is known before the scan.

    Higher-order functions beat an unrolled sum, which is too large for generated code. try_divide makes a zero norm
    null, so dot and norm are worked out once a row.
    """
    size = sum(x * x for x in probe) ** 0.5
    p = F.array(*[F.lit(float(x)) for x in probe])
    dot = F.aggregate(F.zip_with(vector, p, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) * size
    # least and greatest skip nulls, so null is told apart first
    value = F.aggregate(F.array(F.try_divide(dot, norm)), F.lit(0.0), lambda _, x: F.when(x.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))))
    return F.when(F.size(vector) == len(probe), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def rrf(rank: Column, k: int = 60) -> Column:
    """What a rank adds in reciprocal rank fusion; nothing where there is no rank."""
    return F.coalesce(F.lit(1.0) / (F.lit(k) + rank), F.lit(0.0))
