"""Vector expressions over ARRAY<DOUBLE> columns, as Catalyst higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Vectors shorter than this are divided by it instead of their length when they are normalised.
EPS = 1e-12


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once a row: what a lambda body doesn't get from its arguments is computed again for every element."""
    return F.transform(F.array(value), then)[0]


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sq_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def l2_normalize(v: Column) -> Column:
    return let(F.greatest(F.sqrt(sq_norm(v)), F.lit(EPS)), lambda length: F.transform(v, lambda x: x / length))


def sq_dist(x: Column, x_sq: Column, c: Column, c_sq: Column) -> Column:
    """Squared Euclidean distance from the norms and the dot product, never below zero."""
    return F.greatest(F.lit(0.0), x_sq + c_sq - 2.0 * dot(x, c))


def movement(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
