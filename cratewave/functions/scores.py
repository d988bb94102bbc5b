"""Scores over sets and score lists: similarity, uncertainty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets; 0 if both or one are empty or null."""
    empty = F.array().cast("array<string>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def margin(scores: Column) -> Column:
    """Difference of the two highest scores; 1 if there are less than two."""
    s = F.sort_array(scores, asc=False)
    return F.when(F.size(s) < 2, F.lit(1.0)).otherwise(F.try_element_at(s, F.lit(1)) - F.try_element_at(s, F.lit(2)))


def entropy(scores: Column) -> Column:
    """Entropy of the scores as shares of their sum; 0 for none or a sum of 0, NaN where a share is too negative."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    share = lambda x: x / total + F.lit(1e-10)
    log = lambda x: F.when(share(x) > 0, F.log(share(x))).when(share(x) == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when((F.size(scores) == 0) | (total == 0), 0.0).otherwise(-F.aggregate(scores, F.lit(0.0), lambda s, x: s + x / total * log(x)))


def least_confidence(scores: Column) -> Column:
    """One minus the highest score; 1 if there is none."""
    return F.coalesce(1 - F.array_max(scores), F.lit(1.0))


def exact_mean(x: Column) -> Column:
    """Aggregate: the mean of numbers of up to nine decimals, rounded to six, halves upwards. It is taken over whole
    billionths, so it does not depend on the order of summing; null for no numbers."""
    n = F.count(x)
    total = F.sum(F.round(x * 1e9).cast("bigint").cast("decimal(28,0)")) + 500 * n
    return F.when(n > 0, ((total - F.pmod(total, 1000 * n)) / (1000 * n)).cast("bigint") / 1e6)
