"""Column builders over arrays of doubles: they stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def total(u: Column) -> Column:
    return F.aggregate(u, F.lit(0.0), lambda s, x: s + x)


def axpy(u: Column, a: Column | float, g: Column) -> Column:
    """u + a * g."""
    a = a if isinstance(a, Column) else F.lit(a)
    return F.zip_with(u, g, lambda x, y: x + a * y)


def scale(u: Column, a: Column | float) -> Column:
    a = a if isinstance(a, Column) else F.lit(a)
    return F.transform(u, lambda x: x * a)


def add(*us: Column) -> Column:
    return reduce(lambda u, v: F.zip_with(u, v, lambda a, b: a + b), us)


def times(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: a * b)


def outer(u: Column, v: Column) -> Column:
    """Rows of u vᵀ, one after the other."""
    return F.flatten(F.transform(u, lambda a: F.transform(v, lambda b: a * b)))


def bilinear(fu: Column, b: Column, fv: Column) -> Column:
    """fuᵀ B fv, B flattened by rows."""
    return dot(outer(fu, fv), b)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def vsum(column: str, d: int) -> Column:
    """Element-wise sum as an aggregate: fixed width, so it is combined before the shuffle."""
    return F.array(*(F.sum(F.col(column)[k]) for k in range(d)))


def vavg(column: str, d: int) -> Column:
    return F.array(*(F.avg(F.col(column)[k]) for k in range(d)))


def init(key: str, seed: int, d: int, divide: bool = True) -> Column:
    """Deterministic start vector in [0, 1) / d, in the place of random numbers."""
    one = lambda k: ((F.col(key) * 7919 + (k * 104729 + seed * 1299709)) % 1000).cast("double") / F.lit(1000.0)
    return F.array(*(one(k) / F.lit(float(d)) if divide else one(k) for k in range(d)))


def trailing_zeros(h: Column) -> Column:
    return F.bit_count(h.bitwiseAND(-h) - 1)


def lowest_zero(mask: Column) -> Column:
    """Index of the lowest bit not set."""
    return trailing_zeros(F.bitwise_not(mask))


def rounded(x: Column, places: int = 8) -> Column:
    """For comparison across engines; adding 0 turns -0.0 into 0.0."""
    return F.round(x, places) + F.lit(0.0)
