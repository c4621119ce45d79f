"""Column functions for scores; all take "now" as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without length."""
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))).otherwise(0.0)


def hours_since(ts: Column, now: str) -> Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 3.6e9


def memory_recency(ts: Column, now: str) -> Column:
    """exp(-0.05 hours), 0.1 at least; 1 in the future; 0 without a time."""
    h = hours_since(ts, now)
    return F.when(ts.isNull(), 0.0).when(h < 0, 1.0).otherwise(F.greatest(F.lit(0.1), F.exp(-0.05 * h)))


def context_recency(ts: Column, now: str) -> Column:
    """exp(-0.01 days) within 0.1 and 1; 0.1 without a time."""
    return F.when(ts.isNull(), 0.1).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.exp(-0.01 * hours_since(ts, now) / 24))))


def episodic_score(cos: Column, recency: Column, importance: Column) -> Column:
    return (0.8 * cos + 0.2 * recency) * (0.8 + 0.4 * importance)


def semantic_score(cos: Column, graph: Column, importance: Column) -> Column:
    return (0.7 * cos + 0.3 * graph) * (0.8 + 0.4 * importance)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets of terms; 0 if b is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(b) == 0, 0.0).otherwise(F.coalesce(F.try_divide(common.cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0)))
