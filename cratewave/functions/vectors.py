"""Vector expressions on array columns. All arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    """A vector as array<double>."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product; null if a side is null or lengths differ by a missing element."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector at length one; zero vectors and vectors with NaN stay as they are."""
    n = norm(a)
    return F.when((n == 0) | F.isnan(n), a).otherwise(F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine."""
    return 1 - cosine(a, b)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def fix_length(a: Column, n: int) -> Column:
    """The first n elements, padded with zeros."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), n)), 1, n)


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has `dim` elements, all finite, not all zero; false for null."""
    inf = F.lit(float("inf"))
    high, low = F.array_max(v), F.array_min(v)
    good = (F.size(v) == dim) & (F.size(F.array_compact(v)) == dim) & (high < inf) & (low > -inf) & ((high != 0) | (low != 0))
    return F.coalesce(good, F.lit(False))


def contour_similarity(a: Column, b: Column, length: int, log: bool) -> Column:
    """exp(-distance / 2) of two contours, of logarithms (from 1 up) if `log`, padded to a length; null if one is empty."""
    form = lambda c: fix_length(F.transform(c, lambda x: F.log(F.greatest(x, F.lit(1.0)))) if log else c, length)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.exp(-euclidean(form(a), form(b)) / 2))


def blend(a: Column, b: Column, weight: float = 0.7) -> Column:
    """Weighted sum of two vectors; the second alone where lengths differ or the first is missing."""
    mixed = F.zip_with(a, b, lambda x, y: F.lit(weight) * x + F.lit(round(1 - weight, 12)) * y)
    return F.when(a.isNotNull() & (F.size(a) == F.size(b)), mixed).otherwise(b)
