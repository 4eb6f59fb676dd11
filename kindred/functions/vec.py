"""Similarity kernels of two numeric arrays, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def raw_cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    return clamp01(raw_cosine(a, b))


def bound(value: Column, body) -> Column:
    """body(value), the value worked out once a row even where body uses it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def centred(x: Column) -> Column:
    return bound(total(x) / F.size(x), lambda m: F.transform(x, lambda v: v - m))


def unit(x: Column) -> Column:
    """x at length 1; zero stays zero."""
    return bound(F.sqrt(dot(x, x)), lambda n: F.transform(x, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0))))


def centred_unit(x: Column) -> Column:
    return bound(centred(x), unit)


def centred_cosine(a: Column, b: Column) -> Column:
    """For arrays centred beforehand (once a row, not once a pair)."""
    return cosine(a, b)


def correlation01(a: Column, b: Column) -> Column:
    """Pearson's r of centred arrays, mapped to (r + 1) / 2; no variance gives 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, (dot(a, b) / norm + 1) / 2).otherwise(F.lit(0.0))


def exp_distance(a: Column, b: Column) -> Column:
    return F.exp(-F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))
