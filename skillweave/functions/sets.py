"""Set arithmetic on array columns and the ratios built on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if either side is empty or null."""
    shared, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / both).otherwise(F.lit(0.0))


def jaccard_folded(a: Column, b: Column) -> Column:
    """Jaccard without regard to letter case."""
    return jaccard(F.transform(a, F.lower), F.transform(b, F.lower))


def coverage(owned: Column, required: Column) -> Column:
    """Share of required that is owned; 0 if nothing is required."""
    need = F.array_distinct(required)
    return F.when(F.size(need) > 0, F.size(F.array_intersect(owned, need)) / F.size(need)).otherwise(F.lit(0.0))


def saturating_coverage(found: Column, shared: Column) -> Column:
    """min(1, found/5) * min(1, shared/3)."""
    return F.least(F.lit(1.0), found / 5) * F.least(F.lit(1.0), shared / 3)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ordered_union(*arrays: Column) -> Column:
    """Arrays one after the other, each element at its first place only."""
    return F.array_distinct(F.concat(*arrays))
