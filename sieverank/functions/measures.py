"""Numeric measures used by the checks, the ranking and the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


TINY = 1e-300


def is_number(value: Column) -> Column:
    """False for null and for NaN, which Spark otherwise sorts above every number."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def total_of(columns: Sequence[str]) -> Column:
    """Row-wise sum in which missing values count as nothing."""
    total = F.lit(0.0)
    for name in columns:
        value = F.col(name).cast("double")
        total = total + F.when(is_number(value), value).otherwise(F.lit(0.0))
    return total


def rule_holds(value: Column, op: Column, threshold: Column, eps: float = 1e-4) -> Column:
    """Numeric rule with a tolerance, which also lets ``>`` pass on equality."""
    known = F.coalesce(
        F.when(op == "==", F.abs(value - threshold) < eps)
        .when(op == ">", value > threshold - eps)
        .when(op == ">=", value >= threshold - eps)
        .when(op == "<", value < threshold + eps)
        .when(op == "<=", value <= threshold + eps),
        F.lit(False),
    )
    return known & is_number(value) & is_number(threshold)


def proximity(distance: Column) -> Column:
    """Display score: 100 at distance 0, 0 from distance 2 on."""
    return F.greatest(F.lit(0.0), 100.0 - distance * 50.0)


def rating_pct(score: Column) -> Column:
    """A 0-10 rating as a bar width between 0 and 100."""
    return F.least(F.greatest(score * 10.0, F.lit(0.0)), F.lit(100.0))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal; null for an empty whole."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 1)


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two array columns in DOUBLE; a zero vector is at distance 1 of everything."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    # a zero length comes with a zero product, so the tiny divisor leaves a distance of 1
    return 1.0 - dot / F.greatest(norm(a) * norm(b), F.lit(TINY))


def cosine_distance_to(vector: str, query: Sequence[float]) -> Column:
    """Distance of a vector column to one known vector; null for a vector of another width."""
    known = F.array(*[F.lit(float(x)) for x in query])
    return F.when(F.size(vector) == len(query), cosine_distance(F.col(vector), known))
