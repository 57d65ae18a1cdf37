"""Dense-vector column functions.

Spark 4.1 has no built-in vector math for ``array<float>``; these compose
higher-order functions so they run inside the JVM (no Python worker).
Arithmetic is in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a) -> Column:
    a = _c(a)
    sq = F.transform(a, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector has zero norm."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def has_vector(a) -> Column:
    """Python truthiness of the reference: missing or empty vector = no vector.
    A vector that holds a null, NaN or infinite component has no score with
    anything, so it counts as missing too."""
    a = _c(a)
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(a.isNotNull() & (F.size(a) > 0) & finite, F.lit(False))


def logistic_dot(a, b) -> Column:
    """sigmoid(dot) = 1 / (1 + e^-dot) when the candidate has a vector, else 0."""
    return F.when(has_vector(b), 1.0 / (1.0 + F.exp(-dot(a, b)))).otherwise(F.lit(0.0))
