"""Column functions on vectors and id sets; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_sq(a: Column, b: Column, dims: int | None = None) -> Column:
    """Squared Euclidean distance in double, added from left to right.

    With ``dims`` the sum is unrolled, so that it runs inside generated code.
    """
    if dims is None:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    total = None
    for i in range(dims):
        d = a[i].cast("double") - b[i].cast("double")
        total = d * d if total is None else total + d * d
    return total


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_expanded(a: Column, b: Column) -> Column:
    """|a|² + |b|² - 2ab, not below zero."""
    return F.greatest(F.lit(0.0), dot(a, a) + dot(b, b) - 2 * dot(a, b))


def adc(code: Column, table: Column, centroids: int) -> Column:
    """Sum over chunks of table[chunk * centroids + code[chunk]]."""
    at = F.transform(code, lambda c, i: F.element_at(table, (i * centroids + c + 1).cast("int")))
    return F.aggregate(at, F.lit(0.0), lambda s, x: s + x)


def overlap(a: Column, b: Column) -> Column:
    """Number of ids in both; duplicates count once."""
    return F.size(F.array_intersect(a, b))


def recall(found: Column, truth: Column) -> Column:
    """Share of ``truth`` (of its own width) that was found."""
    return overlap(found, truth) / F.size(truth)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def relative_error(decoded: Column, exact: Column) -> Column:
    norm = F.sqrt(dot(exact, exact))
    return F.sqrt(l2_sq(decoded, exact)) / F.greatest(norm, F.lit(1e-6))


def crossing(x0: Column, y0: Column, x1: Column, y1: Column, target: Column | float) -> Column:
    """x where the line from (x0, y0) to (x1, y1) reaches ``target``."""
    return x0 + (F.lit(target) - y0) / (y1 - y0) * (x1 - x0)
