"""Comparisons and arithmetic with the IEEE meaning: comparisons with NaN are false, division by zero is defined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def nan() -> Column:
    return F.lit(float("nan"))


def gt(a: Column, b: Column) -> Column:
    return (a > b) & ~F.isnan(a) & ~F.isnan(b)


def lt(a: Column, b: Column) -> Column:
    return gt(b, a)


def divide(a: Column, b: Column) -> Column:
    """a / b with x / 0 = infinity of x's sign and 0 / 0 = NaN; Spark's ANSI mode would raise an error."""
    zero = F.when(F.isnan(a) | (a == 0), nan()).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def indicator(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def positive(x: Column) -> Column:
    """x * (x > 0): NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(x, F.lit(0.0)))


def negative(x: Column) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.least(x, F.lit(0.0)))
