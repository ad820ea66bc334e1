"""Measures of two arrays taken as sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def containment(a: Column, b: Column) -> Column:
    """Shared distinct elements over the smaller set; 1 if both are empty, 0 if one is."""
    n = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_empty, 1.0).when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def only_left(a: Column, b: Column) -> Column:
    """What only `a` holds, in order, as one text."""
    return F.array_join(F.sort_array(F.array_except(a, b)), ", ")
