"""Vector expressions over ``array<float>`` or ``array<double>``, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + _d(x) * _d(x))


def cosine(a: Column, b: Column) -> Column:
    """0 for a missing, empty or zero vector."""
    c = F.try_divide(dot(a, b), F.sqrt(squared_norm(a) * squared_norm(b)))
    return F.coalesce(c, F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: _d(x) - _d(y))
    return F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x * x)


def unit(a: Column) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""
    # The one-element array binds the norm, so it is computed once per vector.
    norm = F.array(F.sqrt(squared_norm(a)))
    return F.element_at(
        F.transform(norm, lambda n: F.transform(a, lambda x: F.when(n == 0.0, _d(x)).otherwise(_d(x) / n))), 1
    )


def has_dim(a: Column, dim: int) -> Column:
    return F.coalesce(F.size(a) == dim, F.lit(False))


def link_score(model_score: Column, cos: Column, model_weight: float, vector_weight: float) -> Column:
    return model_score * F.lit(model_weight) + cos * F.lit(10.0) * F.lit(vector_weight)


def rrf_term(rank: Column, k: int) -> Column:
    """Reciprocal-rank term of a one-based rank."""
    return F.lit(1.0) / (F.lit(k) + rank)


def pair_count(n: Column) -> Column:
    n = n.cast("long")
    return F.floor(n * (n - 1) / 2)


def linking_minutes(pairs: Column, seconds_per_call: float = 2.0, workers: int = 1) -> Column:
    return pairs * F.lit(seconds_per_call) / F.lit(60.0) / F.lit(float(workers))
